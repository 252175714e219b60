"""Descriptive tables, identity diagnostics, calibration grids, master tables and set-based evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from . import rules


def sample_skewness(c: Column) -> Column:
    """Skewness with the small-sample factor; null under three values or without spread."""
    n = F.count(c).cast("double")
    spread = F.stddev_pop(c)
    return F.when((n > 2) & (spread > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def by_code(staged: DataFrame) -> DataFrame:
    return staged.groupBy(F.col("TRANSAÇÃO").alias("CODIGO")).agg(
        F.count(F.lit(1)).alias("N"), F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS")
    )


def value_distribution(rows: DataFrame, by: list[str]) -> DataFrame:
    """Moments, quantiles and shares of round amounts."""
    v = F.col("VALOR_CENTAVOS").cast("double")
    multiple = lambda m: F.avg((F.col("VALOR_CENTAVOS") % m == 0).cast("double"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("N"),
        F.avg(v).alias("MEDIA"),
        F.median(v).alias("MEDIANA"),
        F.stddev_pop(v).alias("DESVIO"),
        sample_skewness(v).alias("ASSIMETRIA"),
        F.min(v).alias("MINIMO"),
        F.max(v).alias("MAXIMO"),
        F.percentile(v, 0.99).alias("P99"),
        multiple(100).alias("SHARE_INTEIROS"),
        multiple(1000).alias("SHARE_DEZENAS"),
    )


def frequent_values(rows: DataFrame, top: int = 200) -> DataFrame:
    counted = rows.groupBy("VALOR_CENTAVOS").agg(F.count(F.lit(1)).alias("N"))
    return counted.orderBy(F.desc("N"), "VALOR_CENTAVOS").limit(top)


def benford_suitability(rows: DataFrame, top: int = 5) -> DataFrame:
    """Whether first digits can be tested: size, spread in orders of magnitude, share of the commonest values."""
    v = F.col("VALOR_CENTAVOS").cast("double")
    stats = rows.agg(
        F.count(F.lit(1)).alias("N"),
        F.count_distinct("VALOR_CENTAVOS").alias("UNICOS"),
        F.avg(v).alias("MEDIA"),
        F.median(v).alias("MEDIANA"),
        sample_skewness(v).alias("ASSIMETRIA"),
        F.log10(F.max(v) / F.min(v)).alias("ORDENS"),
    )
    most = frequent_values(rows, top).agg(F.sum("N").alias("N_TOP"))
    return stats.crossJoin(F.broadcast(most)).withColumn("SHARE_TOP", x.ratio(F.col("N_TOP"), F.col("N"))).drop("N_TOP")


def drill_down(rows: DataFrame, digits: list[int], values: int = 20) -> DataFrame:
    """The commonest values of given two first digits, with distinct units, suppliers and cardholders."""
    digit = F.substring(F.col("VALOR_CENTAVOS").cast("string"), 1, 2).cast("int")
    picked = rows.filter(F.col("VALOR_CENTAVOS") >= 1000).withColumn("DIGITO", digit).filter(F.col("DIGITO").isin(digits))
    grouped = picked.groupBy("DIGITO", "VALOR_CENTAVOS").agg(
        F.count(F.lit(1)).alias("N"),
        F.count_distinct("UG_ID").alias("N_UG"),
        F.count_distinct("FAVORECIDO_ID").alias("N_FORNECEDORES"),
        F.count_distinct("PORTADOR_ID").alias("N_PORTADORES"),
    )
    order = Window.partitionBy("DIGITO").orderBy(F.desc("N"), "VALOR_CENTAVOS")
    return grouped.withColumn("ORDEM", F.row_number().over(order)).filter(F.col("ORDEM") <= values)


def master_signals(tables: dict[str, tuple[DataFrame, str, dict[str, Column]]]) -> DataFrame:
    """All signals under one contract; the evidence is a JSON object of named columns."""
    parts = [
        df.select(
            F.col(key).alias("ID_SINAL"),
            F.lit(trail).alias("TRILHA"),
            x.optional(df, "NIVEL_TRIAGEM").alias("NIVEL"),
            "UG_ID",
            F.col("ANO_TRANSACAO").alias("ANO"),
            F.to_json(F.struct(*(c.alias(n) for n, c in evidence.items()))).alias("EVIDENCIA"),
        )
        for trail, (df, key, evidence) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def master_bridge(bridges: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(TRILHA, ID_SINAL, ID_TRANSACAO), distinct."""
    parts = [df.select(F.lit(t).alias("TRILHA"), F.col(key).alias("ID_SINAL"), "ID_TRANSACAO") for t, (df, key) in bridges.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def compare_counts(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison of two count tables."""
    a, b = actual.select(key, F.col(value).alias("ATUAL")), expected.select(key, F.col(value).alias("ESPERADO"))
    return a.join(b, key, "full_outer").withColumn("IGUAL", F.col("ATUAL").eqNullSafe(F.col("ESPERADO")))


def set_agreement(rows: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Exact match, precision and recall of two arrays per row; an empty prediction of an empty set is right."""
    common = F.size(F.array_intersect(predicted, expected)).cast("double")
    n, m = F.size(F.array_distinct(predicted)).cast("double"), F.size(F.array_distinct(expected)).cast("double")
    both_empty = (n == 0) & (m == 0)
    share = lambda k: F.when(both_empty, 1.0).when(k == 0, 0.0).otherwise(common / F.nullif(k, F.lit(0.0)))
    return rows.withColumns({"EXATO": (common == n) & (common == m), "PRECISAO": share(n), "COBERTURA": share(m)})


def modal_share(rows: DataFrame, case: str, answer: str) -> DataFrame:
    """Per case, the share of the commonest answer among repetitions."""
    counted = rows.groupBy(case, answer).agg(F.count(F.lit(1)).alias("_N"))
    return counted.groupBy(case).agg((F.max("_N") / F.sum("_N")).alias("ESTABILIDADE"), F.sum("_N").alias("N"))


def route(text: Column, cascade: list[tuple[str, list[str]]], default: str) -> Column:
    """First label whose pattern list has a match in the folded text."""
    folded = x.folded_lower(F.coalesce(text, F.lit("")))
    out = F.lit(default)
    for label, patterns in reversed(cascade):
        out = F.when(folded.rlike("|".join(f"(?:{p})" for p in patterns)), label).otherwise(out)
    return out


def question_problem(text: Column, most: int = 2000) -> Column:
    """Why a question isn't admitted, or null: empty, too long, control characters, or a statement that changes data."""
    mutation = r"(?i)\b(insert\s+into|update\s+\w+\s+set|delete\s+from|drop\s+(table|view)|alter\s+table|truncate\s+table)\b"
    return (
        F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "VAZIA")
        .when(F.length(text) > most, "LONGA")
        .when(text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"), "CONTROLE")
        .when(text.rlike(mutation), "MUTACAO")
    )
