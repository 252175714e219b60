"""Two identities of a cardholder: the masked id alone, and unit, masked id and name. Collisions, and a recount of what they touch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .windows import KEYS, recurring_purchases

MASKED, CANDIDATE, NAME = "PORTADOR_ID_BASELINE", "PORTADOR_ID", "NOME_PORTADOR_NORMALIZADO"


def identity_universe(staged: DataFrame, masked: str = MASKED, candidate: str = CANDIDATE, name: str = NAME) -> DataFrame:
    """One row of six figures over rows with a masked id. Null names and units aren't counted as one more."""
    known = staged.filter(F.col(masked).isNotNull())
    per_id = known.groupBy(masked).agg(F.count_distinct(name).alias("_NAMES"), F.count_distinct("UG_ID").alias("_UNITS"))
    per_pair = known.groupBy("UG_ID", masked).agg(F.count_distinct(name).alias("_NAMES"))
    one = [
        per_id.agg(
            F.count(F.lit(1)).alias("PORTADORES_BASELINE_GLOBAL"),
            F.count_if(F.col("_NAMES") > 1).alias("CPF_COM_MULTIPLOS_NOMES"),
            F.count_if(F.col("_UNITS") > 1).alias("CPF_EM_MULTIPLAS_UGS"),
        ),
        per_pair.agg(F.count(F.lit(1)).alias("PORTADORES_BASELINE_UG"), F.count_if(F.col("_NAMES") > 1).alias("PARES_UG_CPF_COM_MULTIPLOS_NOMES")),
        known.agg(F.count_distinct(candidate).alias("PORTADORES_CANDIDATOS")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each


def collision_pairs(staged: DataFrame, masked: str = MASKED, name: str = NAME) -> DataFrame:
    """(UG_ID, masked id, N_NOMES, N_LINHAS) of masked ids that stand for several names in a unit."""
    counted = staged.filter(F.col(masked).isNotNull() & F.col("UG_ID").isNotNull()).groupBy("UG_ID", masked)
    return counted.agg(F.count_distinct(name).alias("N_NOMES"), F.count(F.lit(1)).alias("N_LINHAS")).filter(F.col("N_NOMES") > 1)


def touched_supplier_years(staged: DataFrame, masked: str = MASKED, name: str = NAME) -> DataFrame:
    """Supplier-years with a purchase of a colliding card."""
    pairs = collision_pairs(staged, masked, name).select(F.col("UG_ID"), F.col(masked).alias("_CARD"))
    return recurring_purchases(staged, masked).join(pairs, ["UG_ID", "_CARD"], "left_semi").select(*KEYS).distinct()


def recount(staged: DataFrame, frozen: int | None = None, masked: str = MASKED, candidate: str = CANDIDATE, name: str = NAME, **windows) -> DataFrame:
    """One row: T05 under both identities, only for supplier-years that a collision touches, and what the whole count becomes.

    Elsewhere the identities are one to one within a unit, so episodes are the same. ``frozen`` is the known whole count
    under the masked id; without it, it is counted. ``windows``: thresholds of ``recurrence_windows``.
    """
    touched = touched_supplier_years(staged, masked, name)
    affected = staged.filter(F.col(masked).isNotNull()).join(touched, KEYS, "left_semi")

    def episodes(rows: DataFrame, card: str, column: str) -> DataFrame:
        return rules.strongest_windows(rules.recurrence_windows(rows, card, **windows)).agg(F.count(F.lit(1)).alias(column))

    whole = episodes(staged, masked, "BASELINE_TOTAL") if frozen is None else staged.sparkSession.range(1).select(F.lit(frozen).cast("bigint").alias("BASELINE_TOTAL"))
    one = [
        touched.agg(F.count(F.lit(1)).alias("GRUPOS_FORNECEDOR_ANO_AFETADOS")),
        episodes(affected, masked, "EPISODIOS_AFETADOS_BASELINE"),
        episodes(affected, candidate, "EPISODIOS_AFETADOS_CANDIDATO"),
        whole,
    ]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), one)  # one row each
    delta = F.col("EPISODIOS_AFETADOS_CANDIDATO") - F.col("EPISODIOS_AFETADOS_BASELINE")
    return row.withColumn("CANDIDATO_TOTAL_PROJETADO", F.col("BASELINE_TOTAL") + delta)


def compare_identities(staged: DataFrame, cards: dict[str, str], t05: dict | None = None, t07: dict | None = None) -> DataFrame:
    """(IDENTIDADE, TRILHA, N): signals of the rules that depend on the cardholder, T03, T04, T05 and T07 (days and cardholder-years), per identity."""

    def counted(df: DataFrame, label: str, trail: str, only: Column | None = None) -> DataFrame:
        df = df if only is None else df.filter(only)
        return df.agg(F.count(F.lit(1)).alias("N")).select(F.lit(label).alias("IDENTIDADE"), F.lit(trail).alias("TRILHA"), "N")

    parts = []
    for label, card in cards.items():
        daily = rules.daily_withdrawals(staged, card)
        parts += [
            counted(rules.exact_repetition(staged, card), label, "T03"),
            counted(rules.multi_cardholder(staged, card), label, "T04"),
            counted(rules.strongest_windows(rules.recurrence_windows(staged, card, **(t05 or {}))), label, "T05"),
            counted(daily, label, "T07_DIAS"),
            counted(rules.withdrawal_recurrence(daily, card, **(t07 or {})), label, "T07", F.col("PRIORITARIO")),
        ]
    return reduce(DataFrame.unionByName, parts)
