"""Territory: registry lookup, flags, and aggregates by state and year under two time references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x


def geographic_projection(staged: DataFrame, dimension: DataFrame, ufs=model.UFS) -> DataFrame:
    """The fact with its state and flags. A unit without a state is an error."""
    place = dimension.select("UG_ID", "UF_UG")
    joined = staged.join(place, "UG_ID", "left")
    state = F.when(F.col("UF_UG").isNull(), F.raise_error("a unit has no state").cast("string")).otherwise(F.col("UF_UG"))
    positive = F.coalesce(F.col("VALOR_CENTAVOS") > 0, F.lit(False)) & ~x.true("EH_AJUSTE_CONTESTACAO")
    return joined.withColumn("UF_UG", state).withColumns(
        {
            "GEO_UF_BRASIL": F.col("UF_UG").isin(*ufs),
            "GEO_POSITIVA": positive,
            "GEO_COMPRA": positive & x.true("EH_COMPRA_EFETIVA"),
            "GEO_SAQUE": positive & x.true("EH_SAQUE_EFETIVO"),
            "GEO_COM_DATA": F.col("DATA_DT").isNotNull(),
        }
    )


def units_without_state(staged: DataFrame, dimension: DataFrame) -> DataFrame:
    return staged.select("UG_ID").distinct().join(dimension.select("UG_ID"), "UG_ID", "left_anti")


def by_transaction_year(geo: DataFrame) -> DataFrame:
    return _by_state(geo.filter("GEO_UF_BRASIL AND GEO_COM_DATA AND GEO_POSITIVA"), "ANO_TRANSACAO")


def by_statement_year(geo: DataFrame, year: str = "ANO_EXTRATO_GEO") -> DataFrame:
    return _by_state(geo.filter(F.col("GEO_UF_BRASIL") & F.col("GEO_POSITIVA") & F.col(year).isNotNull()), year)


def _by_state(rows: DataFrame, year: str) -> DataFrame:
    cents = lambda c: F.coalesce(F.sum(F.when(c, F.col("VALOR_CENTAVOS"))), F.lit(0))
    grouped = rows.groupBy(F.col(year).alias("ANO"), F.col("UF_UG").alias("UF")).agg(
        F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS"),
        F.count(F.lit(1)).alias("N_REGISTROS"),
        F.count_distinct("UG_ID").alias("N_UG"),
        cents(F.col("GEO_COMPRA")).alias("COMPRAS_CENTAVOS"),
        cents(F.col("GEO_SAQUE")).alias("SAQUES_CENTAVOS"),
        cents(x.true("EH_SIGILOSO")).alias("SIGILO_CENTAVOS"),
        cents(F.col("GEO_COM_DATA")).alias("COM_DATA_CENTAVOS"),
    )
    national = F.sum("TOTAL_CENTAVOS").over(Window.partitionBy("ANO"))
    total = F.col("TOTAL_CENTAVOS")
    return grouped.withColumns(
        {
            "MEDIA_POR_UG": x.ratio(total, F.col("N_UG")),
            "PARTICIPACAO_PCT": x.ratio(total, national) * 100,
            "SIGILO_PCT": x.ratio(F.col("SIGILO_CENTAVOS"), total) * 100,
            "OBSERVABILIDADE_PCT": x.ratio(F.col("COM_DATA_CENTAVOS"), total) * 100,
        }
    )


def long_metrics(wide: DataFrame, reference: str, metrics: list[str]) -> DataFrame:
    """One row per state, year and metric."""
    return wide.select(
        "ANO",
        "UF",
        F.lit(reference).alias("REFERENCIA_TEMPORAL"),
        F.explode(F.array(*(F.struct(F.lit(m).alias("METRICA"), F.col(m).cast("double").alias("VALOR_METRICA")) for m in metrics))).alias("m"),
    ).select("ANO", "UF", "REFERENCIA_TEMPORAL", "m.*")


def all_metrics(tables: dict[str, DataFrame], metrics: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, (long_metrics(df, name, metrics) for name, df in tables.items()))


def coverage(staged: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows and units with and without a state, in one pass."""
    marked = staged.join(dimension.select("UG_ID", F.lit(True).alias("_HIT")), "UG_ID", "left")
    hit = F.coalesce(F.col("_HIT"), F.lit(False))
    return marked.agg(
        F.count(F.lit(1)).alias("N_LINHAS"),
        F.count_if(hit).alias("N_COM_UF"),
        F.count_distinct("UG_ID").alias("N_UG"),
        F.count_distinct(F.when(hit, F.col("UG_ID"))).alias("N_UG_COM_UF"),
    )


REFERENCES = ("TRANSACAO", "EXTRATO")


def metric_catalogue(long: DataFrame, reference: str | None = None) -> DataFrame:
    """References and their metrics, in order."""
    kept = long if reference is None else long.filter(F.col("REFERENCIA_TEMPORAL") == _reference(reference))
    return kept.select("REFERENCIA_TEMPORAL", "METRICA").distinct().orderBy("REFERENCIA_TEMPORAL", "METRICA")


def metric_years(long: DataFrame, reference: str) -> DataFrame:
    return long.filter(F.col("REFERENCIA_TEMPORAL") == _reference(reference)).select("ANO").distinct().orderBy("ANO")


def state_metric(long: DataFrame, reference: str, year: int, metric: str) -> DataFrame:
    """One metric of one year by state, largest first; ties by state. A metric that the reference lacks gives no row."""
    picked = (F.col("REFERENCIA_TEMPORAL") == _reference(reference)) & (F.col("ANO") == int(year)) & (F.col("METRICA") == metric.strip().upper())
    return long.filter(picked).orderBy(F.desc("VALOR_METRICA"), "UF")


def units_of_state(matrix: DataFrame, dimension: DataFrame, uf: str, year: int, limit: int = 50) -> DataFrame:
    """Unit-years of a state with what governance counted for them: most rules first, then the largest total."""
    uf = uf.strip().upper()
    if uf not in model.UFS:
        raise ValueError(f"unknown state: {uf}")
    if not 1 <= int(limit) <= 500:
        raise ValueError("limit must be 1 to 500")
    place = dimension.filter(F.col("UF_UG") == uf).select("UG_ID", F.col("UF_UG").alias("UF"))
    columns = "UF ANO_TRANSACAO UG_ID N_OPERACOES_EFETIVAS COMPRAS_CENTAVOS SAQUES_CENTAVOS TOTAL_CENTAVOS N_TRILHAS N_FAMILIAS".split()
    rows = matrix.filter(F.col("ANO_TRANSACAO") == int(year)).join(place, "UG_ID")
    total = F.col("COMPRAS_CENTAVOS") + F.col("SAQUES_CENTAVOS")
    return rows.withColumn("TOTAL_CENTAVOS", total).select(*columns).orderBy(F.desc("N_TRILHAS"), F.desc("TOTAL_CENTAVOS"), "UG_ID").limit(int(limit))


def _reference(name: str) -> str:
    name = name.strip().upper()
    if name not in REFERENCES:
        raise ValueError(f"unknown time reference: {name}")
    return name
