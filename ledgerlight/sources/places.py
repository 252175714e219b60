"""Where a row stands in its file, without a task that holds a file.

A scan reads a file in splits, each in order, and numbers its rows as it reads them. Rows are counted per split, the counts are summed over the splits before, and a row's place is that
sum and how far its number is from its split's first. Two scans of the same files number them alike, so the rows themselves aren't moved or sorted; they look up their split.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_places(scan: DataFrame, file: str = "ARQUIVO_ORIGEM", place: str = "LINHA", first: int = 1) -> DataFrame:
    """``scan`` of files with each row's file name and place; the first row of a file has the number ``first``.

    The folder of a file isn't part of its name, but files of one name in several folders are told apart.
    """
    meta = scan.metadataColumn("_metadata")
    read = scan.select(
        "*",
        meta["file_name"].alias(file),
        meta["file_path"].alias("_PATH"),
        meta["file_block_start"].alias("_SPLIT"),
        F.monotonically_increasing_id().alias("_ORDER"),
    )
    split = ["_PATH", "_SPLIT"]
    before = F.sum("_N").over(Window.partitionBy("_PATH").orderBy("_SPLIT").rowsBetween(Window.unboundedPreceding, -1))
    starts = (
        read.groupBy(*split)
        .agg(F.count(F.lit(1)).alias("_N"), F.min("_ORDER").alias("_FIRST"))
        .select(*(F.col(c).alias(f"{c}_OF") for c in split), (F.coalesce(before, F.lit(0)) - F.col("_FIRST")).alias("_SHIFT"))
    )
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"{c}_OF") for c in split])
    placed = read.join(F.broadcast(starts), on)  # a row per split
    return placed.withColumn(place, F.col("_ORDER") + F.col("_SHIFT") + first).drop("_PATH", "_SPLIT", "_ORDER", "_PATH_OF", "_SPLIT_OF", "_SHIFT")
