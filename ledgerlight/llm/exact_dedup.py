"""Exact duplicates, with heavy hitters split off.

Each text is reduced to its SHA-256 once; the digest table is written to the
shared folder, so texts are scanned a single time and never shuffled. A
Misra-Gries style frequent-items sketch (``approx_top_k``) proposes digests that
may be frequent. An exact count of the proposals verifies them, and the
surviving row of each verified heavy digest is broadcast: at most ``MAX_HEAVY``
rows, whatever the input. Rows of heavy digests are settled where they lie; only
the rows of the other digests are shuffled. A digest that isn't among the MAX_HEAVY most
frequent has at most ``1 / MAX_HEAVY`` of all rows, plus the sketch's error of about
``1 / SKETCH_ITEMS``, which bounds every remaining group; Spark sorts and spills those.

Defined results: a null text is the empty text. Of equal texts the row with the
largest ``doc_id`` stays; null ids rank below all others. Rows that repeat one id
and one text are told apart by their position in the input, and exactly one stays.
An empty table gives an empty result. Other columns of the input play no part,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, numbered, written

#: Most digests that are broadcast as heavy hitters.
MAX_HEAVY = 4096
#: Counters of the frequent-items sketch.
SKETCH_ITEMS = 16384
#: A digest with fewer rows isn't worth a broadcast.
MIN_HEAVY_ROWS = 16


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, _row, text_sha256) of every row, written to the shared folder."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return written(
        numbered(docs.select(id_col, text_col), "_place").select(
            F.col(id_col).alias("doc_id"),
            F.col("_place").alias("_row"),
            F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        ),
        "digests",
    )


def heavy_digests(digests: DataFrame) -> DataFrame:
    """(text_sha256, _best, group_size) of the verified frequent digests: MAX_HEAVY rows at most."""
    proposed = digests.select(
        F.explode(F.expr(f"approx_top_k(text_sha256, {MAX_HEAVY}, {SKETCH_ITEMS})")).alias("top")
    ).select(F.col("top.item").alias("text_sha256"))
    return (
        digests.join(F.broadcast(proposed), "text_sha256")
        .groupBy("text_sha256")
        .agg(F.max(F.struct("doc_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
        .filter(F.col("group_size") >= MIN_HEAVY_ROWS)
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, _row."""
    digests = digest_table(docs, id_col, text_col)
    winners = written(heavy_digests(digests), "heavy")
    heavy = digests.join(F.broadcast(winners), "text_sha256")
    group = Window.partitionBy("text_sha256")
    light = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").select(
        "text_sha256",
        "doc_id",
        "_row",
        F.max(F.struct("doc_id", "_row")).over(group).alias("_best"),
        F.count(F.lit(1)).over(group).alias("group_size"),
    )
    return light.unionByName(heavy).select(
        "doc_id",
        F.col("_best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best._row")).alias("kept"),
        "text_sha256",
        "_row",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged.

    ``docs`` must be a scan of Parquet files, so that a row has the same position whenever
    it is read, however the files are split. The ids that leave are joined away; texts of rows that stay
    move only if those ids are too many for a broadcast.
    """
    place = free_name(docs, "_place_of_row")
    gone = exact_duplicates(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("_row").alias(place))
    return numbered(docs, place).join(gone, place, "left_anti").drop(place)
