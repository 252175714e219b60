"""Alignment of two tokenizers over the same texts, and how often their tokens are linked.

A text is encoded by both tokenizers. The byte offsets at which a token of each ends go into a dictionary from end to
index per tokenizer; the intersection of their keys, sorted, slices both lists of ids into groups: the least stretches that hold
whole tokens of both. Every token of a group is linked to every token of the other tokenizer there.

1. Align: one pass over the texts gives the figures of each document and its distinct pairs of ids with how often each is linked.
   Dictionaries cover ``WINDOW`` bytes of a text at a time, links are expanded ``LINKS`` at a time, and a document's pairs lie in rows of ``PAIRS`` at most,
   so that memory doesn't grow with a text beyond its ids. It is written, so no text is encoded twice.
2. Count: how many documents hold each pair, combined before the shuffle, and the greatest count of each id of the first vocabulary.
3. Sum: the ``FREQUENT`` most frequent pairs are broadcast (5 MB whatever the input), which settles nearly all links where they are. The
   rare rest joins the counts by pair, so no join key is frequent.

Defined results: texts that are null or empty, or whose tokens of either side joined aren't a space and the text (a text that
holds the space mark itself, say), have no tokens. Ids that repeat, also null ones, are documents of their own. Marks of special tokens inside texts
are plain text. Empty tables give an empty result. Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokenizer import chunk_tokenizer
from .common import written
from .piece_codec import codec
from .words import ranges, slices

#: Bytes of a text whose ends are in a dictionary at once, links expanded at once, pairs of a row.
WINDOW = 1 << 22
LINKS = 1 << 21
PAIRS = 1 << 17
#: Pairs that are broadcast.
FREQUENT = 1 << 18


class Side:
    """A tokenizer's ids of whole texts, and the bytes of each id."""

    def __init__(self, bytes_of: list[bytes]):
        self.size = np.array([len(x) for x in bytes_of], dtype=np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        step = 1 << 18
        parts = (ids[at : at + step] for at in range(0, len(ids), step))
        return b"".join(self.flat[ranges(self.place[part], self.size[part])].tobytes() for part in parts)


class ByteSide(Side):
    """A byte-level vocabulary given as ranks, with the library's own file for long words."""

    def __init__(self, ranks: str, pattern: str, library: str):
        with open(ranks, "rb") as f:
            of = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
        super().__init__([of.get(n, b"") for n in range(max(of) + 1)])
        self.tool = chunk_tokenizer(ranks, pattern, (), library)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.tool.encode_all([" " + t for t in texts])
        return np.frombuffer(b"".join(made), dtype="<u4").astype(np.int64), np.array([len(x) // 4 for x in made], dtype=np.int64)


class PieceSide(Side):
    """A vocabulary of pieces, which puts a space before a text itself."""

    def __init__(self, model: str):
        self.tool = codec(model)
        super().__init__(self.tool.bytes_of)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, count = self.tool.encode_all(texts)
        inner = np.ones(len(ids), dtype=bool)
        ends = np.cumsum(count)
        inner[ends - 1] = inner[ends - count] = False  # begin and end
        return ids[inner], count - 2


def common_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte offset at which a token of both ends, in order: the tokens of either list up to there."""
    a_at, b_at = [], []
    total = int(ends_a[-1]) if len(ends_a) else 0
    i = j = 0
    for stop in range(WINDOW, total + WINDOW, WINDOW):
        i_to, j_to = (int(np.searchsorted(x, stop, "right")) for x in (ends_a, ends_b))
        index_a = dict(zip(ends_a[i:i_to].tolist(), range(i + 1, i_to + 1), strict=True))
        index_b = dict(zip(ends_b[j:j_to].tolist(), range(j + 1, j_to + 1), strict=True))
        common = sorted(index_a.keys() & index_b.keys())
        a_at.extend([index_a[end] for end in common])
        b_at.extend([index_b[end] for end in common])
        i, j = i_to, j_to
    return np.array(a_at, dtype=np.int64), np.array(b_at, dtype=np.int64)


@cache
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Each number below ``most`` in decimal digits, ended by a place for a mark and filled up with zero bytes, and its digits."""
    width = len(str(most)) + 1
    table = np.array([str(n) for n in range(most)], dtype=f"S{width}").view(np.uint8).reshape(most, width).copy()
    return table, (table != 0).sum(axis=1)


def group_texts(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, groups: np.ndarray, vocabulary: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` for each document, from the ids of all groups and the number of each group's and document's."""
    table, width = _digits(vocabulary)
    place_a = np.arange(len(a)) + np.repeat(np.cumsum(n_b) - n_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(np.cumsum(n_a), n_b)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[place_a], ids[place_b] = a, b
    mark = np.full(len(ids), ord(","), dtype=np.uint8)
    mark[np.cumsum(n_a + n_b) - n_b - 1] = ord("|")
    mark[np.cumsum(n_a + n_b) - 1] = ord(";")
    parts = []
    for at in range(0, len(ids), 1 << 18):
        some = ids[at : at + (1 << 18)]
        rows = table[some]
        rows[np.arange(len(some)), width[some]] = mark[at : at + (1 << 18)]
        parts.append(rows[rows != 0].tobytes())
    raw = b"".join(parts)
    tokens = np.r_[0, np.cumsum(n_a + n_b)][np.r_[0, np.cumsum(groups)]]
    ends = np.r_[0, np.cumsum(width[ids] + 1)][tokens].tolist()
    return [raw[s : max(s, e - 1)] for s, e in zip(ends, ends[1:], strict=False)]


def linked_pairs(a, b, n_a, n_b, doc, second: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times) of the links of all groups, by document and pair. A pair is first id * second + second id."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    before = np.r_[0, np.cumsum(links)]
    span = int(a.max(initial=0) + 1) * second
    keys, times = [], []

    def keep(key, weight=None):
        found, place = np.unique(key, return_inverse=True)
        keys.append(found)
        times.append(np.bincount(place, minlength=len(found)) if weight is None else _sums(place, weight, len(found)))

    at = 0
    while at < len(links):
        end = max(at + 1, int(np.searchsorted(before, before[at] + LINKS, "right")) - 1)
        if links[at] <= LINKS:
            own = slice(at, end)
            i = ranges(first_a[own], n_a[own])
            group = np.repeat(np.arange(at, end), n_a[own])
            left = np.repeat(a[i] * second + doc[group] * span, n_b[group])
            keep(left + b[ranges(first_b[group], n_b[group])])
        else:  # one group of many links: distinct ids with their numbers, some of the first at a time
            end = at + 1
            x, of_x = np.unique(a[first_a[at] : first_a[at] + n_a[at]], return_counts=True)
            y, of_y = np.unique(b[first_b[at] : first_b[at] + n_b[at]], return_counts=True)
            step = max(1, LINKS // len(y))
            for k in range(0, len(x), step):
                left = x[k : k + step, None] * second + int(doc[at]) * span
                keep((left + y[None, :]).ravel(), (of_x[k : k + step, None] * of_y[None, :]).ravel())
        at = end
    if len(keys) > 1:
        weight = np.concatenate(times)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = _sums(place, weight, len(key))
    else:
        key, n = (keys[0], times[0]) if keys else (np.empty(0, np.int64), np.empty(0, np.int64))
    return key // span, key % span, n.astype(np.int64)


def _sums(place: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=np.int64)
    np.add.at(out, place, weight)
    return out


@cache
def _sides(ranks: str, pattern: str, library: str, model: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(ranks, pattern, library), PieceSide(model)


def _offsets(count: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(count)]


def aligned(first: ByteSide, second: PieceSide, texts: list[str]) -> dict[str, list]:
    """Per text: ids of both sides and the number of each group's, none where either side's bytes aren't the text's."""
    (a, n_a), (b, n_b) = first.encode(texts), second.encode(texts)
    ends_a, ends_b = np.cumsum(first.size[a]), np.cumsum(second.size[b])
    joined = first.joined(a), second.joined(b)
    at_a, at_b = _offsets(n_a).tolist(), _offsets(n_b).tolist()
    byte_a, byte_b = (np.r_[0, e][_offsets(n)].tolist() for e, n in ((ends_a, n_a), (ends_b, n_b)))
    out = {"a": [], "b": [], "n_a": [], "n_b": []}
    for d, text in enumerate(texts):
        own = b" " + text.encode()
        ia, ib = slice(at_a[d], at_a[d + 1]), slice(at_b[d], at_b[d + 1])
        cuts = np.empty(0, np.int64), np.empty(0, np.int64)
        if text and joined[0][byte_a[d] : byte_a[d + 1]] == own and joined[1][byte_b[d] : byte_b[d + 1]] == own:
            cuts = common_ends(ends_a[ia] - byte_a[d], ends_b[ib] - byte_b[d])
        kept = len(cuts[0]) > 0
        out["a"].append(a[ia] if kept else a[:0])
        out["b"].append(b[ib] if kept else b[:0])
        out["n_a"].append(np.diff(cuts[0], prepend=0))
        out["n_b"].append(np.diff(cuts[1], prepend=0))
    return out


def _rows(first: ByteSide, second: PieceSide, rows: pa.Array, ids: pa.Array, texts: list[str]) -> pa.RecordBatch:
    made = aligned(first, second, texts)
    groups = np.array([len(x) for x in made["n_a"]], dtype=np.int64)
    tokens = {k: np.array([len(x) for x in made[k]], dtype=np.int64) for k in ("a", "b")}
    a, b, n_a, n_b = (np.concatenate(made[k]) for k in ("a", "b", "n_a", "n_b"))
    hashed = [
        hashlib.sha256(x).hexdigest() if x else ""
        for x in group_texts(a, b, n_a, n_b, groups, max(len(first.size), len(second.size)))
    ]
    n_links = np.diff(np.r_[0, np.cumsum(n_a * n_b)][_offsets(groups)])
    doc, pair, times = linked_pairs(a, b, n_a, n_b, np.repeat(np.arange(len(texts)), groups), len(second.size))
    of_doc = np.bincount(doc, minlength=len(texts))
    parts = np.maximum(1, -(-of_doc // PAIRS))  # rows of each document: the first holds its figures
    of = np.repeat(np.arange(len(texts)), parts)
    part = ranges(np.zeros(len(texts), dtype=np.int64), parts)
    ends = np.minimum((part + 1) * PAIRS, of_doc[of]) + _offsets(of_doc)[of]
    offsets = pa.array(np.r_[0, ends], pa.int32())
    pick = lambda x, kind: pa.array(x, kind).take(pa.array(of))
    return pa.RecordBatch.from_pydict(
        {
            "_row": rows.take(pa.array(of)),
            "doc_id": ids.take(pa.array(of)),
            "_part": pa.array(part, pa.int32()),
            "n_a": pick(tokens["a"], pa.int64()),
            "n_b": pick(tokens["b"], pa.int64()),
            "n_groups": pick(groups, pa.int64()),
            "n_links": pick(n_links, pa.int64()),
            "groups_sha256": pick(hashed, pa.string()),
            "_pairs": pa.ListArray.from_arrays(offsets, pa.array(pair, pa.int64())),
            "_times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
        }
    )


def align_texts(
    docs: DataFrame, ranks: str, pattern: str, library: str, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The documents' figures, and the links' counts (first_id, second_id, n: documents that hold the pair, is_best).

    A document's row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = (
        f"_row long, doc_id {id_type}, _part int, n_a long, n_b long, n_groups long, n_links long, "
        "groups_sha256 string, _pairs array<long>, _times array<long>"
    )

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(ranks, pattern, library, model)
        for whole in batches:
            at = 0
            for column in slices(whole.column(2)):
                batch = whole.slice(at, len(column))
                at += len(column)
                yield _rows(*sides, batch.column(0), batch.column(1), [t or "" for t in column.to_pylist()])

    given = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = written(given.mapInArrow(align, schema), "aligned")

    second = len(codec(model).bytes_of)
    counts = made.select(F.explode("_pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    plain = written(counts.withColumn("first_id", F.floor(F.col("pair") / second).cast("long")), "pairs")
    best = plain.groupBy("first_id").agg(F.max("n").alias("best"))  # a row per id of the first vocabulary at most
    counted = plain.join(F.broadcast(best), "first_id").select("pair", "n", (F.col("n") == F.col("best")).alias("is_best"))
    head = counted.orderBy(F.desc("n"), "pair").limit(FREQUENT).toPandas().sort_values("pair")
    sent = spark.sparkContext.broadcast((head["pair"].to_numpy(np.int64), head["n"].to_numpy(np.int64), head["is_best"].to_numpy(bool)))
    frequent = len(head)

    def placed(batch: pa.RecordBatch):
        pairs, n, is_best = sent.value
        lists = batch.column(1)
        own, times = lists.flatten().to_numpy().astype(np.int64), batch.column(2).flatten().to_numpy().astype(np.int64)
        row = np.repeat(batch.column(0).to_numpy().astype(np.int64), np.diff(lists.offsets.to_numpy()))
        at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
        known = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
        return row, own, times, at, known, n, is_best

    sum_schema = "_row long, n_best long, count_sum long"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, _, times, at, known, n, is_best = placed(batch)
            row, times, at = row[known], times[known], at[known]
            rows, place = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "_row": pa.array(rows, pa.int64()),
                    "n_best": pa.array(_sums(place, times * is_best[at], len(rows)), pa.int64()),
                    "count_sum": pa.array(_sums(place, times * n[at], len(rows)), pa.int64()),
                }
            )

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, own, times, _, known, _, _ = placed(batch)
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v[~known], pa.int64()) for k, v in (("_row", row), ("pair", own), ("times", times))}
            )

    lists = made.select("_row", "_pairs", "_times")
    summed = lists.mapInArrow(sums, sum_schema)
    if frequent == FREQUENT:
        rare = lists.mapInArrow(rest, "_row long, pair long, times long").join(counted, "pair")
        summed = summed.unionByName(
            rare.select(
                "_row", F.when(F.col("is_best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
            )
        )
    totals = summed.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    figures = (
        made.filter("_part = 0")
        .select("_row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        .join(totals, "_row", "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")),
            "groups_sha256",
        )
    )
    links = counted.select(
        F.floor(F.col("pair") / second).cast("long").alias("first_id"), (F.col("pair") % second).alias("second_id"), "n", "is_best"
    )
    return figures, links
