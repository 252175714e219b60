"""Names of published tables, and text output."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-z][a-z0-9_]{0,62}")


def logical_name(name: str) -> str:
    if not _NAME.fullmatch(name):
        raise ValueError(f"not a table name: {name!r}")
    return name


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolons, decimal commas for floating numbers, and a byte order mark before each file's heading."""
    number = lambda c: F.replace(F.col(c).cast("string"), F.lit("."), F.lit(","))
    out = df.select(
        *((number(c) if t in ("double", "float") else F.col(c)).alias(("\ufeff" if n == 0 else "") + c) for n, (c, t) in enumerate(df.dtypes))
    )
    out.write.option("sep", ";").option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)
