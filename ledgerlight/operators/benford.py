"""First-digit diagnostics over integer cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import ranks
from ..sources import scratch
from .rules import UNIT_YEAR, _national

# Limits of the mean absolute deviation and their labels.
MAD_LIMITS = {
    1: ((0.006, "Conformidade próxima"), (0.012, "Conformidade aceitável"), (0.015, "Conformidade marginal")),
    2: ((0.0012, "Conformidade próxima"), (0.0018, "Conformidade aceitável"), (0.0022, "Conformidade marginal")),
}
LEAST = {1: 1, 2: 1000}


def digit_grid(spark: SparkSession, places: int) -> DataFrame:
    """(DIGITO, ESPERADO) for all first digits of one or two places."""
    low = 10 ** (places - 1)
    return spark.range(low, low * 10).select(
        F.col("id").cast("int").alias("DIGITO"), F.log10(1 + 1 / F.col("id")).alias("ESPERADO")
    )


def leading_digits(cents: Column, places: int) -> Column:
    """The first digits of a positive integer, null if it's too small."""
    return F.when(cents >= LEAST[places], F.substring(cents.cast("string"), 1, places).cast("int"))


def mad_class(mad: Column, places: int) -> Column:
    out = F.lit("Não conformidade")
    for limit, label in reversed(MAD_LIMITS[places]):
        out = F.when(mad <= limit, label).otherwise(out)
    return out


def sample_status(n: Column) -> Column:
    return (
        F.when(n < 300, "NAO_APLICAR")
        .when(n < 1000, "EXPLORATORIO")
        .when(n < 3000, "FORMAL")
        .otherwise("FORMAL_ROBUSTEZ_MAIOR")
    )


def digit_table(rows: DataFrame, places: int, by: list[str], value: str = "VALOR_CENTAVOS") -> DataFrame:
    """Observed and expected share of every digit in each group; digits that don't occur have 0."""
    digit = leading_digits(F.col(value), places)
    counted = rows.select(*by, digit.alias("DIGITO")).filter("DIGITO IS NOT NULL").groupBy(*by, "DIGITO").agg(
        F.count(F.lit(1)).alias("OBSERVADOS")
    )
    totals = counted.groupBy(*by).agg(F.sum("OBSERVADOS").alias("N"))
    grid = totals.crossJoin(F.broadcast(digit_grid(rows.sparkSession, places)))
    full = grid.join(counted, [*by, "DIGITO"], "left").na.fill(0, ["OBSERVADOS"])
    return full.withColumn("PROPORCAO", F.col("OBSERVADOS") / F.col("N"))


def z_statistic(table: DataFrame) -> DataFrame:
    """Z of each digit, with continuity correction where that is smaller than the difference."""
    gap = F.abs(F.col("PROPORCAO") - F.col("ESPERADO"))
    correction = 1 / (2 * F.col("N"))
    corrected = F.when(correction < gap, gap - correction).otherwise(gap)
    z = corrected / F.sqrt(F.col("ESPERADO") * (1 - F.col("ESPERADO")) / F.col("N"))
    return table.withColumn("Z", z).withColumn("Z_SIGNIFICATIVO", F.col("Z") > 1.96)


def conformity(table: DataFrame, places: int, by: list[str]) -> DataFrame:
    """Mean absolute deviation over all digits, its class, and chi-square."""
    expected = F.col("ESPERADO") * F.col("N")
    grouped = table.groupBy(*by).agg(
        F.max("N").alias(f"N_D{places}"),
        F.avg(F.abs(F.col("PROPORCAO") - F.col("ESPERADO"))).alias(f"MAD_D{places}"),
        F.sum((F.col("OBSERVADOS") - expected) * (F.col("OBSERVADOS") - expected) / expected).alias(f"QUI2_D{places}"),
    )
    return grouped.withColumn(f"CLASSE_D{places}", mad_class(F.col(f"MAD_D{places}"), places))


def unit_year_indicators(staged: DataFrame, least: int = 300) -> DataFrame:
    rows = _national(staged, *UNIT_YEAR)
    stats = rows.groupBy(*UNIT_YEAR).agg(
        F.count(F.lit(1)).alias("N"),
        F.count_distinct("VALOR_CENTAVOS").alias("VALORES_UNICOS"),
        F.min("VALOR_CENTAVOS").alias("MIN_CENTAVOS"),
        F.median(F.col("VALOR_CENTAVOS").cast("double")).alias("MEDIANA_CENTAVOS"),
        F.avg(F.col("VALOR_CENTAVOS").cast("double")).alias("MEDIA_CENTAVOS"),
        F.max("VALOR_CENTAVOS").alias("MAX_CENTAVOS"),
    )
    out = stats
    for places in (1, 2):
        found = conformity(digit_table(rows, places, UNIT_YEAR), places, UNIT_YEAR).filter(F.col(f"N_D{places}") >= least)
        out = out.join(found, UNIT_YEAR, "left")
    return out.withColumn("STATUS_AMOSTRA", sample_status(F.col("N")))


def _comparable_units(indicators: DataFrame, formal: int, years: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Units of formal size, and each year's number of them and P90."""
    rows = indicators.filter((F.col("N_D2") >= formal) & F.col("ANO_TRANSACAO").between(*years) & F.col("MAD_D2").isNotNull())
    return rows, rows.groupBy("ANO_TRANSACAO").agg(F.count(F.lit(1)).alias("N_COMPARAVEIS"), F.percentile("MAD_D2", 0.9).alias("P90_MAD"))


def benford_flags(staged: DataFrame, least: int, formal: int, years: tuple[int, int], comparable: int = 10) -> DataFrame:
    """The keys of ``benford_signals`` and the deviation: two first digits alone decide them. The unit-years' deviations, a row each, are written, since they meet their own percentile."""
    found = conformity(digit_table(_national(staged, *UNIT_YEAR), 2, UNIT_YEAR), 2, UNIT_YEAR).filter(F.col("N_D2") >= least)
    rows, limits = _comparable_units(scratch.written(found, "digits"), formal, years)
    return rows.join(limits, "ANO_TRANSACAO").filter((F.col("N_COMPARAVEIS") >= comparable) & (F.col("MAD_D2") >= F.col("P90_MAD"))).select(*UNIT_YEAR, "MAD_D2")


def rank_units(indicators: DataFrame, formal: int, years: tuple[int, int], comparable: int = 10) -> DataFrame:
    """Units of formal size with average-rank percentile and the year's P90."""
    rows, limits = _comparable_units(indicators, formal, years)
    ranked = ranks.with_average_rank(rows, "MAD_D2", ["ANO_TRANSACAO"], "PERCENTIL_MAD").join(limits, "ANO_TRANSACAO")
    valid = F.col("N_COMPARAVEIS") >= comparable
    return ranked.withColumns(
        {"ANO_VALIDO": valid, "TOP_DECIL": valid & (F.col("MAD_D2") >= F.col("P90_MAD")), "NAO_CONFORME": F.col("MAD_D2") > 0.0022}
    )


def deviation_id() -> Column:
    return x.short_signal_id("T08", "UG_ID", "ANO_TRANSACAO", x.number_text(F.col("MAD_D2")))


def benford_signals(ranked: DataFrame) -> DataFrame:
    return ranked.filter("TOP_DECIL").withColumn("ID_SINAL", deviation_id())


def persistence(ranked: DataFrame, years: int = 3, share: float = 0.5) -> DataFrame:
    grouped = (
        ranked.filter("ANO_VALIDO")
        .groupBy("UG_ID")
        .agg(
            F.count_distinct("ANO_TRANSACAO").alias("ANOS_COMPARAVEIS"),
            F.count_if("TOP_DECIL").alias("ANOS_TOP_DECIL"),
            F.min("ANO_TRANSACAO").alias("PRIMEIRO_ANO"),
            F.max("ANO_TRANSACAO").alias("ULTIMO_ANO"),
            F.avg("MAD_D2").alias("MAD_MEDIO"),
            F.max("MAD_D2").alias("MAD_MAX"),
        )
    )
    part = F.col("ANOS_TOP_DECIL") / F.col("ANOS_COMPARAVEIS")
    return grouped.withColumns(
        {"RATIO": part, "ELEVADA": (F.col("ANOS_COMPARAVEIS") >= years) & (part >= share)}
    )


def summation(staged: DataFrame) -> DataFrame:
    """Share of value per two first digits against 1/90; 90 rows always."""
    rows = _national(staged, "DATA_DT").select(
        leading_digits(F.col("VALOR_CENTAVOS"), 2).alias("DIGITO"), F.col("VALOR_CENTAVOS").alias("V")
    )
    sums = rows.filter("DIGITO IS NOT NULL").groupBy("DIGITO").agg(F.sum("V").alias("SOMA_CENTAVOS"))
    full = digit_grid(staged.sparkSession, 2).drop("ESPERADO").join(sums, "DIGITO", "left").na.fill(0, ["SOMA_CENTAVOS"])
    total = sums.agg(F.sum("SOMA_CENTAVOS").alias("_TOTAL"))
    share = F.coalesce(x.ratio(F.col("SOMA_CENTAVOS"), F.col("_TOTAL")), F.lit(0.0))
    return full.crossJoin(F.broadcast(total)).select(
        "DIGITO", "SOMA_CENTAVOS", share.alias("PROPORCAO"), (share - F.lit(1 / 90)).alias("DESVIO")
    )


def duplicated_values(rows: DataFrame, least: int = 2, top: int = 10_000) -> DataFrame:
    digit = leading_digits(F.col("VALOR_CENTAVOS"), 2).alias("DIGITO")
    counted = rows.groupBy("VALOR_CENTAVOS", digit).agg(F.count(F.lit(1)).alias("N")).filter(F.col("N") >= least)
    return counted.orderBy(F.desc("N"), "VALOR_CENTAVOS").limit(top)


def without_round_values(rows: DataFrame) -> DataFrame:
    """A row per scenario and purchase: all, and without multiples of 1, 10, 50 and 100 units."""
    v = F.col("VALOR_CENTAVOS")
    scenarios = F.array(
        F.lit("TODOS"), *(F.when(v % (100 * n) != 0, F.lit(f"SEM_MULTIPLOS_{n}")) for n in (1, 10, 50, 100))
    )
    return rows.withColumn("CENARIO", F.explode(F.filter(scenarios, lambda s: s.isNotNull())))
