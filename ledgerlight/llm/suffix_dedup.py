"""Repeated byte windows by depth-limited radix sorting of suffixes.

A window is ``DEPTH`` bytes; it is repeated if the same bytes also start earlier (in a smaller
document, or before in the same one). Each byte that a repeated window covers is removed. Suffixes are
ordered only as far as that takes, by most-significant-digit passes over ever fewer of them:

1. Windows are named by their anchor: the ``FIRST_DIGIT`` bytes inside them whose hash is smallest, the
   leftmost of equals. Equal windows have equal anchors at equal offsets, so only suffixes at anchors
   need sorting, and all windows of one anchor (a run of neighbouring starts) go together.
   The first digit is the anchor. A group of one anchor in which all runs are equal is settled: all but
   its first are repeated. Runs that no other shares an anchor with are dropped. Runs that repeat an earlier
   one of the same batch are settled before the shuffle, so a frequent passage makes no large group.
2. The runs that differ within a group are cut at fixed offsets from the anchor into bundles of 8 windows.
   The second digit is the 93 bytes that all windows of a bundle share. Equal bundles are settled likewise.
3. The bundles left differ in the 7 bytes on either side, which they carry: they part into single windows,
   whose equal groups at full depth are exactly the repeated windows.

Runs and shared bytes are compared by 128-bit hashes, the bytes at the sides as they are. Sorting is Spark's, by hashed
digits, so it spills and no group is held in memory. The shuffle files of a pass are released
before the next.

Defined results: a null text is empty. Texts of fewer than DEPTH bytes lose nothing. Of rows that
repeat a doc_id, the earlier in the input counts as smaller; null ids count as smaller than others.
An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, written

DEPTH = 100
FIRST_DIGIT = 32
BUNDLE = 8

_U64 = np.uint64
_RANDOM = np.random.default_rng(23)
_BYTES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_ODD = [_U64(int(x) | 1) for x in _RANDOM.integers(1 << 40, 1 << 62, 8)]
_PLACE = _U64((1 << 31) - 1)


def digit_hashes(data: np.ndarray, size: int = FIRST_DIGIT) -> np.ndarray:
    """A hash of the ``size`` bytes (a power of two) from each position on."""
    h = _BYTES[data]
    for step in range(size.bit_length() - 1):
        n = 1 << step
        h = h[:-n] * _ODD[step] + h[n:]
        h ^= h >> _U64(31)
        h *= _U64(0x9E3779B97F4A7C15)
    return h ^ (h >> _U64(29))


def anchor_runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run of window starts with one anchor: the anchor's hash and place, first start, end of starts."""
    windows = len(data) - DEPTH + 1
    inside = DEPTH - FIRST_DIGIT + 1  # anchors that a window may have
    h = digit_hashes(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= inside:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < inside:
        least = np.minimum(least[: len(least) - (inside - size)], least[inside - size :])
    place = (least[:windows] & _PLACE).astype(np.int64)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[start]], place[start], start, np.r_[start[1:], windows]


def _repeated_here(digit: np.ndarray, block: np.ndarray, order: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which runs of a batch have an earlier equal one in it. ``order``: the rank of each run's document."""
    by = np.lexsort((run, order, block, digit))
    same = np.r_[False, (digit[by][1:] == digit[by][:-1]) & (block[by][1:] == block[by][:-1])]
    out = np.empty(len(by), dtype=bool)
    out[by] = same
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digit, block, doc_id, _row, run, settled).

    ``run`` packs the first start, the number of windows and the anchor's offset. A run that an earlier
    one of its batch equals is settled; its digit becomes a hash of its place, so that runs of
    a frequent passage are dealt evenly, and only one per batch meets the others.
    """
    digest = xxhash.xxh3_64_intdigest
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            digits, blocks, runs, count = [], [], [], []
            for text in batch.column("text"):
                data = (text.as_py() or "").encode()
                if len(data) < DEPTH:
                    count.append(0)
                    continue
                digit, place, start, end = anchor_runs(np.frombuffer(data, dtype=np.uint8))
                blocks.extend(
                    digest(data[a : b + DEPTH - 1], q - a)
                    for a, b, q in zip(start.tolist(), end.tolist(), place.tolist(), strict=True)
                )
                digits.append(digit)
                runs.append(((start << 7 | (end - start)) << 7) | (place - start))
                count.append(len(start))
            of = np.repeat(np.arange(batch.num_rows), count)
            digit = np.concatenate([np.empty(0, dtype=np.uint64), *digits])
            block = np.array(blocks, dtype=np.uint64)
            run = np.concatenate([np.empty(0, dtype=np.int64), *runs])
            ids, places = batch.column("doc_id").to_pylist(), batch.column("_row").to_numpy()
            rank = np.empty(batch.num_rows, dtype=np.int64)
            rank[sorted(range(len(ids)), key=lambda n: (ids[n] is not None, ids[n], places[n]))] = np.arange(len(ids))
            settled = _repeated_here(digit, block, rank[of], run)
            spread = (places[of].astype(np.uint64) * _ODD[0] + run.astype(np.uint64)) * _ODD[1]
            digit = np.where(settled, spread ^ (spread >> _U64(29)), digit)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(digit.view(np.int64), pa.int64()),
                    pa.array(block.view(np.int64), pa.int64()),
                    batch.column("doc_id").take(pa.array(of)),
                    batch.column("_row").take(pa.array(of)),
                    pa.array(run, pa.int64()),
                    pa.array(settled, pa.bool_()),
                ],
                names=["digit", "block", "doc_id", "_row", "run", "settled"],
            )


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(core_a, core_b, sides_l, sides_r, doc_id, _row, first, lo, hi) for each bundle of the given runs."""
    digest = xxhash.xxh3_128_intdigest
    low, side = (1 << 63) - 1, BUNDLE - 1
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            out: list[tuple] = []
            for n, (text, runs) in enumerate(
                zip(batch.column("text"), batch.column("runs").to_pylist(), strict=True)
            ):
                data = text.as_py().encode()
                for run in runs:
                    offset, windows, start = run & 127, run >> 7 & 127, run >> 14
                    anchor = start + offset
                    p = start
                    while p < start + windows:
                        k = (anchor - p) // BUNDLE
                        first = anchor - k * BUNDLE - side
                        last = min(first + side, start + windows - 1)
                        core = digest(data[first + side : first + DEPTH], k)
                        left = data[max(first, 0) : first + side].rjust(side, b"\0")
                        right = data[first + DEPTH : first + DEPTH + side]
                        out.append(
                            (
                                core >> 64 & low,
                                core & low,
                                int.from_bytes(left, "little"),
                                int.from_bytes(right, "little"),
                                n,
                                first,
                                p - first,
                                last - first,
                            )
                        )
                        p = last + 1
            a, b, left, right, of, first, lo, hi = list(zip(*out, strict=True)) or [[]] * 8
            of = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *(pa.array(c, pa.int64()) for c in (a, b, left, right)),
                    batch.column("doc_id").take(of),
                    batch.column("_row").take(of),
                    pa.array(first, pa.int64()),
                    pa.array(lo, pa.int32()),
                    pa.array(hi, pa.int32()),
                ],
                names=["core_a", "core_b", "sides_l", "sides_r", "doc_id", "_row", "first", "lo", "hi"],
            )


def _settled(rows: DataFrame, digit: list[str], rest: list[str], place: str, name: str) -> DataFrame:
    """One radix pass: rows that repeat an earlier one, or that others share the digit with but differ from.

    ``repeated`` tells the two apart. All other rows are dropped.
    """
    group = Window.partitionBy(*digit)
    ordered = group.orderBy(*rest, "doc_id", "_row", place)
    same = F.lit(True)
    for c in rest:
        same = same & F.coalesce(F.lag(c).over(ordered) == F.col(c), F.lit(False))
    if "settled" in rows.columns:
        same = same | F.col("settled")
    both = F.struct(*rest) if len(rest) > 1 else F.col(rest[0])
    marked = (
        rows.withColumn("repeated", same)
        .withColumn("_mixed", F.min(both).over(group) != F.max(both).over(group))
        .filter("repeated OR _mixed")
        .drop("_mixed", "settled")
    )
    return written(marked, name)


def _release(df: DataFrame) -> None:
    """Let Spark delete the shuffle files of finished passes."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def repeated_windows(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(_row, start, windows): runs of repeated windows of ``docs``, a table scan."""
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("_row", "doc_id", "text")
    runs = texts.mapInArrow(_runs, f"digit long, block long, doc_id {id_type}, _row long, run long, settled boolean")
    first = _settled(runs, ["digit"], ["block"], "run", "radix-1")
    _release(docs)
    open_runs = (
        first.filter("NOT repeated").groupBy("_row").agg(F.collect_list("run").alias("runs")).withColumnRenamed("_row", "_of")
    )
    bundles = (
        texts.join(open_runs, texts["_row"] == open_runs["_of"])
        .select("_row", "doc_id", "text", "runs")
        .mapInArrow(
            _bundles,
            f"core_a long, core_b long, sides_l long, sides_r long, doc_id {id_type}, _row long, first long, lo int, hi int",
        )
    )
    second = _settled(
        bundles, ["core_a", "core_b"], ["sides_l", "sides_r", "lo", "hi"], "first", "radix-2"
    )
    _release(docs)
    single = second.filter("NOT repeated").withColumn("j", F.explode(F.expr("sequence(lo, hi)")))
    full = Window.partitionBy("core_a", "core_b", "j", "left", "right").orderBy("doc_id", "_row", "first")
    third = (
        single.withColumn("left", F.expr("shiftright(sides_l, 8 * j)"))
        .withColumn("right", F.expr("sides_r & (shiftleft(1L, 8 * j) - 1)"))
        .withColumn("n", F.row_number().over(full))
        .filter("n > 1")
        .select("_row", (F.col("first") + F.col("j")).alias("start"), F.lit(1).cast("long").alias("windows"))
    )
    return (
        first.filter("repeated")
        .selectExpr("_row", "shiftright(run, 14) AS start", "shiftright(run, 7) & 127 AS windows")
        .unionByName(
            second.filter("repeated").selectExpr("_row", "first + lo AS start", "cast(hi - lo + 1 AS long) AS windows")
        )
        .unionByName(third)
    )


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``, a table scan: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and, if asked,
    spans (start and end of the removed bytes) and kept (the bytes that stay)."""
    id_type = docs.schema[id_col].dataType.simpleString()
    found = written(
        repeated_windows(docs, id_col, text_col)
        .groupBy("_row")
        .agg(F.collect_list(F.struct("start", "windows")).alias("found"))
        .withColumnRenamed("_row", "_of"),
        "repeats",
    )
    _release(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows: list[tuple] = []
                for text, found in zip(batch.column("text"), batch.column("found"), strict=True):
                    data = (text.as_py() or "").encode()
                    spans, kept = np.empty((0, 2), dtype=np.int64), data
                    if found.is_valid:
                        start = found.values.field("start").to_numpy()
                        end = start + found.values.field("windows").to_numpy() + DEPTH - 1
                        change = np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1)
                        gone = np.cumsum(change)[: len(data)] > 0
                        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
                        spans = edge.reshape(-1, 2)
                        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                    row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                    rows.append((*row, spans.tolist(), kept) if with_text else row)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())), pa.binary()]
                columns = list(zip(*rows, strict=True)) or [[]] * (6 if with_text else 4)
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), *(pa.array(c, kind) for c, kind in zip(columns, kinds, strict=False))],
                    names=names[: len(columns) + 1],
                )

    texts = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("_row", "doc_id", "text")
    schema = f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", spans array<array<long>>, kept binary" if with_text else ""
    return texts.join(found, texts["_row"] == found["_of"], "left").select("doc_id", "text", "found").mapInArrow(cut, schema)
