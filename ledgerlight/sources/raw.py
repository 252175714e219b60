"""Delimited-text sources: header checks, register lines, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from . import probe


def header_of(spark: SparkSession, path: str) -> list[str]:
    return list(probe.layout_of(probe.first_bytes(spark, path)).columns)


def check_header(columns: list[str], required=model.RAW_COLUMNS) -> dict[str, object]:
    """What is missing, whether the set is the same and whether the order is."""
    return {
        "missing": [c for c in required if c not in columns],
        "same_set": set(columns) == set(required),
        "same_order": list(columns) == list(required),
    }


def read_raw(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Every column as text; empty cells are empty text. A malformed row is an error."""
    return probe.read_text(spark, path, probe.Layout(encoding, sep, ()))


def parse_registry(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """Unit, state, body and title of register lines; if ``strict``, a line that doesn't match is an error when it is read."""
    part = lambda n: F.regexp_extract(F.col(column), model.UNIT_LINE, n)
    bad = F.raise_error(F.concat(F.lit("unreadable line: "), F.col(column))).cast("string")
    return lines.select(
        (F.when(part(1) == "", bad) if strict else F.when(part(1) == "", None)).otherwise(F.lpad(part(1), 6, "0")).alias("UG_ID"),
        part(2).alias("UF_UG"),
        F.lpad(part(3), 5, "0").alias("CODIGO_ORGAO_SIAFI"),
        F.nullif(F.trim(F.regexp_extract(F.col(column), r'^"[^"]*","([^"]*)"', 1)), F.lit("")).alias("TITULO_UG_SIAFI"),
        *keep,
    )


def months(spark: SparkSession, first: str, last: str) -> DataFrame:
    """All YYYYMM from first to last."""
    start, end = (F.to_date(F.lit(m + "01"), "yyyyMMdd") for m in (first, last))
    return spark.range(1).select(F.explode(F.sequence(start, end, F.expr("INTERVAL 1 MONTH"))).alias("d")).select(
        F.date_format("d", "yyyyMM").alias("COMPETENCIA")
    )
