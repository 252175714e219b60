"""Similarity join on word n-grams: MinHash LSH forest, then exact verification.

Each text is the set of its shingles, ``WORDS`` lower-case words in a row. Texts with the same
set are one class, and only one of each goes on. A forest of ``TREES`` prefix tries holds the classes by their
signatures: per tree ``LONGEST`` levels at most, one minimum hash of 16 bits each. Two classes of similarity s
share a prefix of d levels in some tree with probability 1 - (1 - s**d)**TREES.

A class begins with its longest prefix, which is shortened until links are met with the target recall. How far that is
depends on the class: the least similarity, at or above the threshold, that a set of its size can have with a different one
decides it, and it is 1 / 1.25 for most sizes, more for small sets, while sets of fewer than four shingles have no partner
at all at 0.8. A node of a trie that holds a class which still has to shorten passes all its classes up to its parent;
one in which all are done is a bucket. In a bucket all members are tied to the first: as many ties as members, never all
pairs. A pair is met if its nearer class is, since the others in a node come along. Prefixes cost what
they hold: a class whose prefix ends early has no deeper levels in its signature.

The components of the ties hold every candidate pair. Each is verified exactly: its sets are cut
into blocks of bounded size, and each pair of blocks is one unit of work that compares bit sets
inside the task and gives back, per member, the number of its links and the first
member of its linked group there. The links' components are the classes of near-duplicates. So
similarity decides each link alone, and no cap cuts a group of any size.

Defined results: texts of one to four words have one shingle, all their words. Texts without words
(null, empty, white space) link to nothing and are classes of their own. Rows that repeat a
doc_id are rows of their own. A null doc_id stays null; a group of null ids only has a null class.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, written
from .components import connected_components

WORDS = 5
THRESHOLD = 0.8
TREES = 32
LONGEST = 8
TARGET_RECALL = 0.99999
#: Sets up to this size have a prefix length of their own; larger ones have the threshold's.
SMALL = 64
#: Shingles of a block of classes that is verified against another.
BLOCK = 128_000
#: Classes of a block: what is compared has a few cells of 8 bytes per pair of them.
ROWS = 2_000
#: Bits of the matrix that a task compares at once.
MATRIX_BITS = 1 << 28

_U64 = np.uint64
_POWERS = np.random.default_rng(11).integers(1, 1 << 63, WORDS, dtype=np.uint64) * _U64(2) + _U64(1)


def prefix_length(similarity: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix that pairs of this similarity share in some tree with the target probability; 1 if none is."""
    for depth in range(LONGEST, 1, -1):
        if 1 - (1 - similarity**depth) ** TREES >= target:
            return depth
    return 1


@cache
def depth_of(size: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Levels to which a set of ``size`` shingles shortens its prefix; 0 if no different set can be similar enough."""
    if size > SMALL:
        return prefix_length(threshold, target)
    least = 2.0
    for union in range(size, int(size / threshold) + 2):
        common = math.ceil(threshold * union - 1e-9)
        if common <= min(size, union - 1):
            least = min(least, common / union)
    return prefix_length(least, target) if least <= 1 else 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U64(31))) * _U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U64(29))) * _U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = (text or "").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for w in found), dtype=np.uint64, count=len(found))
    size = min(words, len(found))
    total = np.zeros(len(found) - size + 1, dtype=np.uint64)
    for k in range(size):
        total += hashes[k : len(found) - size + 1 + k] * _POWERS[k]
    return np.unique(_mixed(total + _U64(size)))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(5)
    odd = random.integers(0, 1 << 63, n, dtype=np.uint64) * _U64(2) + _U64(1)
    return odd, random.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(found: np.ndarray, depth: int) -> bytes:
    """Per tree the first ``depth`` minimum hashes, 16 bits of each."""
    odd, add = _multipliers(TREES * LONGEST)
    own = np.concatenate([np.arange(t * LONGEST, t * LONGEST + depth) for t in range(TREES)])
    least = np.empty(len(own), dtype=np.uint64)
    step = max(1, (1 << 16) // max(1, len(found)))
    for at in range(0, len(own), step):
        part = own[at : at + step]
        values = found[None, :] * odd[part, None] + add[part, None]
        values ^= values >> _U64(33)
        values *= _U64(0xC2B2AE3D27D4EB4F)
        least[at : at + step] = values.min(axis=1)
    return (_mixed(least) >> _U64(48)).astype("<u2").tobytes()


def signatures(docs: DataFrame, threshold: float, target: float, id_col="doc_id", text_col="text") -> DataFrame:
    """(_row, doc_id, digest, n_shingles, depth, signature) of every row, written."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, depths, made = [], [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py())
                depth = depth_of(min(len(found), SMALL + 1), threshold, target) if len(found) else 0
                digests.append(hashlib.md5(found.tobytes()).digest())
                sizes.append(len(found))
                depths.append(depth)
                made.append(signature(found, depth) if depth else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(depths, pa.int32()),
                    pa.array(made, pa.binary()),
                ],
                names=["_row", "doc_id", "digest", "n_shingles", "depth", "signature"],
            )

    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("_row", "doc_id", "text")
    return written(
        rows.mapInArrow(run, f"_row long, doc_id {id_type}, digest binary, n_shingles long, depth int, signature binary"),
        "signatures",
    )


def candidate_ties(classes: DataFrame, shortest: int) -> DataFrame:
    """(u, v): ties that join every class with all the first members of the buckets that it shares with others.

    ``classes``: rep, depth, signature. A class has at most one such first member per tree. It is tied to the smallest
    of them, and so are the others, which the members of a bucket have in common: about one tie per class is left.

    The tries are walked from the shortest prefix: a node that holds a class which shortens that far is a bucket; the
    classes of all other nodes, few small sets, are parted by one level more.
    """
    at = classes.select("rep", "depth", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    buckets = []
    for level in range(shortest, LONGEST + 1):
        prefix = F.substring("signature", F.col("tree") * F.col("depth") * 2 + 1, F.lit(2 * level))
        nodes = at.select("rep", "depth", "signature", "tree", F.xxhash64("tree", prefix).alias("node"))
        held = (
            nodes.groupBy("node")
            .agg(F.min("rep").alias("head"), F.count(F.lit(1)).alias("n"), F.min("depth").alias("least"))
            .filter("n > 1")
        )
        buckets.append(nodes.select("rep", "node").join(held.filter(F.col("least") <= level).select("node", "head"), "node"))
        going_on = held.filter(F.col("least") > level).select("node")
        if level == LONGEST:
            break
        at = written(nodes.filter(F.col("depth") > level).join(going_on, "node").drop("node"), "open-nodes")
        if at.isEmpty():
            break
    heads = buckets[0].select("rep", "head")
    for more in buckets[1:]:
        heads = heads.unionByName(more.select("rep", "head"))
    shared = heads.groupBy("rep").agg(F.collect_set("head").alias("heads"))
    least = F.array_min("heads")
    ties = F.transform(F.array_union("heads", F.array("rep")), lambda u: F.struct(u.alias("u"), least.alias("v")))
    return shared.select(F.explode(ties).alias("t")).select("t.u", "t.v").filter("u <> v").distinct()


def _common(sets: list[np.ndarray], n_left: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n_left`` sets with the sets after them."""
    n_right = len(sets) - n_left
    count = np.zeros((n_left, n_right), dtype=np.int32)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    on_left = np.zeros(len(values), dtype=bool)
    on_right = np.zeros(len(values), dtype=bool)
    on_left[column[row < n_left]] = True
    on_right[column[row >= n_left]] = True
    shared = np.flatnonzero(on_left & on_right)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    place = place[column]
    width = max(64, MATRIX_BITS // max(1, len(sets)) // 64 * 64)
    for at in range(0, len(shared), width):
        inside = (place >= at) & (place < at + width)
        size = min(width, len(shared) - at)
        bits = np.zeros((len(sets), -(-size // 64) * 64), dtype=bool)
        bits[row[inside], place[inside] - at] = True
        packed = np.packbits(bits, axis=1).view(np.uint64)
        left, right = packed[:n_left], packed[n_left:]
        for i in range(n_left):
            count[i] += np.bitwise_count(left[i] & right).sum(axis=1, dtype=np.int32)
    return count


def _groups(linked: np.ndarray) -> np.ndarray:
    """Per member, the first member of its linked group; ``linked`` is symmetric."""
    first = np.arange(len(linked))
    while True:
        lower = np.where(linked, first[None, :], len(linked)).min(axis=1, initial=len(linked))
        new = np.minimum(first, lower)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def verified(unit: list[dict], threshold: float) -> list[tuple[int, int, int]]:
    """(rep, first rep of its linked group, links) of the members that have a link.

    A unit is one block against itself, or two blocks against each other.
    """
    a, b = unit[0]["a"], unit[0]["b"]
    left = [r for r in unit if r["block"] == a]
    right = left if a == b else [r for r in unit if r["block"] == b]
    if not left or not right or (a == b and len(left) < 2):
        return []
    sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in left + right]
    size = np.array([len(s) for s in sets])
    common = _common(sets, len(left))
    union = size[: len(left), None] + size[None, len(left) :] - common
    linked = common >= threshold * union - 1e-9
    if a == b:
        np.fill_diagonal(linked, False)
        whole, members = linked, left
        weight = np.array([r["n_copies"] for r in left])
        links = linked @ weight
    else:
        members = left + right
        whole = np.zeros((len(members), len(members)), dtype=bool)
        whole[: len(left), len(left) :] = linked
        whole |= whole.T
        weight = np.array([r["n_copies"] for r in members])
        links = whole @ weight
    order = np.argsort([r["rep"] for r in members])
    first = _groups(whole[np.ix_(order, order)])
    return [
        (members[k]["rep"], members[order[first[n]]]["rep"], int(links[k])) for n, k in enumerate(order) if links[k]
    ]


def _verify(threshold: float):
    names = ("comp", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit: list[dict] = []
        key = None

        def result(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rep", "first", "links"])

        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if (own := tuple(row[n] for n in names)) != key:
                    found += verified(unit, threshold) if unit else []
                    unit, key = [], own
                unit.append(row)
            yield result(found)
        yield result(verified(unit, threshold) if unit else [])

    return run


def _with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()).tobytes() for t in batch.column("text")]
        kept = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], names=[*kept.schema.names, "shingles"])


def in_blocks(members: DataFrame) -> DataFrame:
    """rep, n_copies, comp, n_blocks and block: about ``BLOCK`` shingles and ``ROWS`` classes in a block at most."""
    blocks = F.ceil(F.greatest(F.sum("n_shingles") / BLOCK, F.count(F.lit(1)) / ROWS)).cast("int")
    return members.join(members.groupBy("comp").agg(blocks.alias("n_blocks")), "comp").select(
        "rep",
        "n_copies",
        "comp",
        "n_blocks",
        F.pmod(F.xxhash64("rep"), F.col("n_blocks")).cast("int").alias("block"),
    )


def verified_links(docs: DataFrame, members: DataFrame, threshold: float, text_col: str) -> DataFrame:
    """(rep, first, links) per unit of work; ``members``: rep, n_copies, n_shingles, comp."""
    placed = in_blocks(members)
    texts = numbered(docs.select(F.col(text_col).alias("text")))
    sets = (
        texts.join(placed, texts["_row"] == placed["rep"])
        .select("rep", "n_copies", "comp", "n_blocks", "block", "text")
        .mapInArrow(
            _with_shingles, "rep long, n_copies long, comp long, n_blocks int, block int, shingles binary"
        )
    )
    units = sets.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)"))).select(
        "comp",
        F.least("block", "other").alias("a"),
        F.greatest("block", "other").alias("b"),
        "block",
        "rep",
        "n_copies",
        "shingles",
    )
    dealt = units.repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b")
    return written(dealt.mapInArrow(_verify(threshold), "rep long, first long, links long"), "links")


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    target_recall: float = TARGET_RECALL,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``, a table scan.

    doc_id; class_id, the smallest doc_id that links lead to; copy_id, the smallest doc_id
    with the same shingles; n_links, the number of other rows of that similarity; _row and _first_row,
    the row's own place and the first of its class.
    """
    rows = signatures(docs, threshold, target_recall, id_col, text_col)
    sets = (
        rows.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(F.min("_row").alias("rep"), F.min("doc_id").alias("copy_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    sets = written(sets, "sets")
    classes = rows.join(
        sets.select(F.col("rep"), "n_copies"), F.col("_row") == F.col("rep")
    ).select("rep", "n_copies", "n_shingles", "depth", "signature").filter("depth > 0")
    candidates = connected_components(candidate_ties(classes, prefix_length(threshold, target_recall)))
    members = classes.drop("depth", "signature").join(candidates, F.col("rep") == F.col("node")).drop("node")
    links = verified_links(docs, members, threshold, text_col)
    groups = connected_components(links.select(F.col("rep").alias("u"), F.col("first").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    per_set = (
        sets.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts, "rep", "left")
        .select(
            "digest",
            "copy_id",
            F.coalesce("comp", "rep").alias("comp"),
            (F.coalesce("links", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"),
        )
    )
    per_set = written(per_set, "classes")
    smallest = per_set.groupBy("comp").agg(F.min("copy_id").alias("class_id"))
    named = per_set.join(smallest, "comp").withColumnRenamed("comp", "_first_row")
    # Texts without words have a digest too, but no set.
    return rows.drop("depth", "signature").join(named, "digest", "left").select(
        "doc_id",
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "_row",
        F.coalesce("_first_row", "_row").alias("_first_row"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, a table scan, that stay: the first of each class, and all without links."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    place = free_name(docs, "_place_of_row")
    gone = found.filter("_row <> _first_row").select(F.col("_row").alias(place))
    return numbered(docs, place).join(gone, place, "left_anti").drop(place)
