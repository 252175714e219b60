"""Parameterised queries over the unit-year and supplier-year matrices."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from . import geography


@dataclass(frozen=True)
class Scope:
    """Years from and to, and units; no units means all."""

    first: int
    last: int
    units: tuple[str, ...] = ()

    def __post_init__(self):
        if self.first > self.last:
            raise ValueError("years are out of order")

    def apply(self, df: DataFrame) -> DataFrame:
        kept = df.filter(F.col("ANO_TRANSACAO").between(self.first, self.last))
        units = sorted({u.strip() for u in self.units if u.strip()})
        return kept.filter(F.col("UG_ID").isin(units)) if units else kept


def overview(matrix: DataFrame, scope: Scope) -> DataFrame:
    signalled = F.col("N_TRILHAS") > 0
    return scope.apply(matrix).agg(
        F.count(F.lit(1)).alias("N_UG_ANO"),
        F.count_distinct("UG_ID").alias("N_UG"),
        F.coalesce(F.sum("COMPRAS_CENTAVOS"), F.lit(0)).alias("COMPRAS_CENTAVOS"),
        F.count_if(signalled).alias("N_SINALIZADAS"),
    )


def annual_overview(matrix: DataFrame, scope: Scope) -> DataFrame:
    return scope.apply(matrix).groupBy("ANO_TRANSACAO").agg(
        F.count(F.lit(1)).alias("N_UG_ANO"),
        F.sum("COMPRAS_CENTAVOS").alias("COMPRAS_CENTAVOS"),
        F.count_if(F.col("N_TRILHAS") > 0).alias("N_SINALIZADAS"),
    )


def trail_prevalence(matrix: DataFrame, scope: Scope, trails=model.TRAILS) -> DataFrame:
    pairs = F.explode(F.array(*(F.struct(F.lit(t).alias("TRILHA"), F.col(t).alias("V")) for t in trails)))
    return scope.apply(matrix).select(pairs.alias("p")).groupBy("p.TRILHA").agg(
        F.sum("p.V").alias("N"), F.avg(F.col("p.V").cast("double")).alias("PREVALENCIA")
    )


def top_units(matrix: DataFrame, scope: Scope, limit: int = 20) -> DataFrame:
    grouped = scope.apply(matrix).groupBy("UG_ID").agg(
        F.max("N_TRILHAS").alias("MAX_TRILHAS"), F.sum("N_TRILHAS").alias("SOMA_TRILHAS"), F.sum("COMPRAS_CENTAVOS").alias("COMPRAS_CENTAVOS")
    )
    return grouped.orderBy(F.desc("MAX_TRILHAS"), F.desc("SOMA_TRILHAS"), F.desc("COMPRAS_CENTAVOS"), "UG_ID").limit(limit)


def top_suppliers(matrix: DataFrame, scope: Scope, limit: int = 20) -> DataFrame:
    grouped = scope.apply(matrix).groupBy("FAVORECIDO_ID").agg(
        F.count_if(F.col("N_TRILHAS") > 0).alias("N_SINALIZADAS"), F.sum("N_TRILHAS").alias("SOMA_TRILHAS"), F.sum("TOTAL_CENTAVOS").alias("TOTAL_CENTAVOS")
    )
    kept = grouped.filter("N_SINALIZADAS > 0")
    return kept.orderBy(F.desc("N_SINALIZADAS"), F.desc("SOMA_TRILHAS"), F.desc("TOTAL_CENTAVOS"), "FAVORECIDO_ID").limit(limit)


def distribution(matrix: DataFrame, scope: Scope, column: str) -> DataFrame:
    return scope.apply(matrix).groupBy(column).agg(F.count(F.lit(1)).alias("N"))


def page(df: DataFrame, keys: list[str], limit: int, offset: int = 0) -> DataFrame:
    """Rows in the order of keys."""
    if not 1 <= limit <= 100_000 or offset < 0:
        raise ValueError("limit must be 1 to 100000 and offset at least 0")
    return df.orderBy(*keys).offset(offset).limit(limit)


DIAGNOSTICS = ("overlap_", "marginal_", "multicollinearity_", "pca_")


def diagnostic_table(tables: Mapping[str, DataFrame], name: str, limit: int = 10_000) -> DataFrame:
    """A published diagnostic table by name; no other table can be read through this."""
    if not name.startswith(DIAGNOSTICS):
        raise ValueError(f"not a diagnostic table: {name}")
    if name not in tables:
        raise ValueError(f"unknown table: {name}")
    return tables[name].limit(limit)


#: The closed set of queries that a caller may name.
TOOLS = {
    "overview": overview,
    "annual": annual_overview,
    "trails": trail_prevalence,
    "units": top_units,
    "suppliers": top_suppliers,
}


def run_tool(name: str, matrix: DataFrame, scope: Scope, **args) -> DataFrame:
    if name not in TOOLS:
        raise ValueError(f"unknown query: {name}")
    return TOOLS[name](matrix, scope, **args)


#: Territorial queries: over the long metrics, or over the unit matrix and the dimension.
TERRITORIAL = {"metric": geography.state_metric, "years": geography.metric_years, "catalogue": geography.metric_catalogue, "units": geography.units_of_state}


def run_territorial(name: str, *tables: DataFrame, **args) -> DataFrame:
    if name not in TERRITORIAL:
        raise ValueError(f"unknown query: {name}")
    return TERRITORIAL[name](*tables, **args)
