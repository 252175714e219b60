"""The register of units: a malformed text file with a line per unit, completed by hand."""

from __future__ import annotations

from collections.abc import Collection, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from .places import with_places
from .raw import parse_registry

#: Offending lines that an error names.
SHOWN = 5
EXTERIOR = "EX"


def _fail(what: str, rows: list, n: int) -> None:
    shown = "; ".join(str(r[0]) if len(r) == 1 else f"line {r[0]}: {r[1]}" for r in rows)
    raise ValueError(f"{n} {what}: {shown}")


def read_units(
    spark: SparkSession, path: str, version: str, expected: int | None = None, states: Collection[str] = (*model.UFS, EXTERIOR), source: str = "CADASTRO_SIAFI"
) -> DataFrame:
    """(UG_ID, UF_UG, CODIGO_ORGAO_SIAFI, TITULO_UG_SIAFI, FONTE_UF, TIPO_FONTE_UF, VERSAO_FONTE_UF, LINHA_ORIGEM_SIAFI), one row per unit.

    The first line is a heading. A line that can't be read, a repeated unit, a state outside the domain, and another number of units than ``expected``
    are errors that name lines of the file.
    """
    lines = with_places(spark.read.text(path)).filter("LINHA > 1").select("value", "LINHA")
    readable = F.col("value").rlike(model.UNIT_LINE)
    bad = lines.filter(~readable)
    if rows := bad.select("LINHA", F.substring("value", 1, 250)).orderBy("LINHA").limit(SHOWN).collect():
        _fail("lines can't be read", rows, bad.count())
    parsed = parse_registry(lines, keep=("LINHA",), strict=False)
    units = parsed.select(
        "UG_ID", "UF_UG", "CODIGO_ORGAO_SIAFI", "TITULO_UG_SIAFI",
        F.lit(f"{source}_{version}").alias("FONTE_UF"), F.lit(source).alias("TIPO_FONTE_UF"), F.lit(version).alias("VERSAO_FONTE_UF"),
        F.col("LINHA").alias("LINHA_ORIGEM_SIAFI"),
    )
    if rows := units.filter(~F.col("UF_UG").isin(*states)).select("LINHA_ORIGEM_SIAFI", "UF_UG").orderBy("LINHA_ORIGEM_SIAFI").limit(SHOWN).collect():
        _fail("or more states are outside the domain", rows, len(rows))
    repeated = units.groupBy("UG_ID").agg(F.count(F.lit(1)).alias("N"), F.sort_array(F.collect_list("LINHA_ORIGEM_SIAFI")).alias("L")).filter("N > 1")
    if rows := repeated.orderBy("UG_ID").select(F.col("L")[1], F.concat(F.lit("unit "), "UG_ID", F.lit(" again"))).limit(SHOWN).collect():
        _fail("or more units are repeated", rows, len(rows))
    if expected is not None and (n := units.count()) != expected:
        raise ValueError(f"{n} units instead of {expected}")
    return units


def completed(units: DataFrame, manual: Mapping[str, tuple[str, str]], version: str) -> DataFrame:
    """``units`` and rows added by hand, unit -> (state, title). A unit that is in both is an error."""
    rows = [(u, uf, None, title, f"COMPLEMENTO_MANUAL_{version}", "COMPLEMENTO_MANUAL", version, None) for u, (uf, title) in sorted(manual.items())]
    kinds = ", ".join(f"{name} {kind}" for name, kind in units.dtypes)
    added = units.sparkSession.createDataFrame(rows, kinds)
    if met := units.join(F.broadcast(added.select("UG_ID")), "UG_ID", "left_semi").select("UG_ID").orderBy("UG_ID").limit(SHOWN).collect():
        _fail("or more manual units are in the register", met, len(met))
    return units.unionByName(added)
