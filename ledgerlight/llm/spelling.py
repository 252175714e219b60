"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One inserted, deleted or replaced letter moves a word's letter counts by one up, one down, or one of each, an
L1 distance of two at most. So the near words of a word lie in a small box around its counts:

1. Words are counted in one aggregation, combined before the shuffle.
2. For each length, a k-d tree over the counts cuts the words into boxes. The cuts come from a hashed sample of
   ``SAMPLE`` count vectors at most, which only decides how even the boxes are: every word gets the box that its counts fall
   into, and goes as a query to each box of its own length and of the next length that one edit can reach.
3. A box's task continues with a k-d tree of its own over all words of the box, prunes its boxes the same way, and
   verifies the order of the letters of what is left. Leaves that no cut divides (words of equal counts) are matched
   by their halves, one of which an edit leaves as it was.
4. Each task gives a word's number of near words there and the best of them; these few rows are combined by word.
   Roots follow from doubling the steps of the forms, each of which is at least ``factor`` times as frequent.

Letters beyond a-z and U+00C0-U+00FF share the places of others, and counts stop at 255; both keep distances from growing,
so that nothing is missed.

Defined results: null and empty texts have no words, and a null id counts as an empty one. Repeated rows count
once each. Words of any length take part. Ties go to the smaller word by code points. Empty tables give an empty result.
Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

LETTERS = 26 + 64
#: Words whose counts the outer trees are fitted on, at most; words that a box should hold.
SAMPLE = 1 << 17
BOX = 16384
#: Words of an inner tree's leaf.
LEAF = 16
#: Queries that go down a tree at once, and letters of candidate pairs that are compared at once.
AT_ONCE = 2048
COMPARED = 1 << 24

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, drop_every: int = 199
) -> DataFrame:
    """(word, n): runs of letters with A-Z lowered, a letter dropped wherever ``drop_every`` divides the hash of id and run."""
    run = F.col("run")
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(text_col, F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.char_length(run) >= shortest)
    lowered = runs.select(F.translate(run, UPPER, LOWER).alias("run"), "id")
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), run).cast("binary")).alias("h"))
    at = (F.col("h") % F.char_length(run)).cast("int")
    dropped = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    words = hashed.select(F.when(F.col("h") % drop_every == 0, dropped).otherwise(run).alias("word"))
    return (
        words.filter(F.char_length("word") >= shortest)
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
    )


def codes_of(words: list[str], length: int) -> np.ndarray:
    """The letters of words of one length, a row each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length)
    return codes.astype(np.uint8) if codes.max(initial=0) < 256 else codes


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each letter stands in each row, 255 at most."""
    out = np.empty((len(codes), LETTERS), dtype=np.uint8)
    step = max(1, (1 << 20) // max(LETTERS, codes.shape[1]))
    for at in range(0, len(codes), step):
        some = codes[at : at + step].astype(np.int64)
        place = np.where(some < 0x80, some - ord("a"), some - 0xC0 + 26) % LETTERS
        place += LETTERS * np.arange(len(some))[:, None]
        found = np.bincount(place.ravel(), minlength=LETTERS * len(some)).reshape(len(some), LETTERS)
        out[at : at + step] = np.minimum(found, 255)
    return out


class Tree:
    """A k-d tree over letter counts. A node sends what has at most ``cut`` of its letter to the left.

    Children at or above 0 are nodes, others are leaves (-1 - leaf). ``low`` and ``high`` bound the node's box along its letter.
    """

    def __init__(self, counts: np.ndarray, most: int):
        rows: list[list[int]] = []  # letter, cut, low, high, left, right
        self.leaves: list[np.ndarray] = []
        # members, node above, its side, bounds of the box by letter
        todo = [(np.arange(len(counts)), -1, 4, {})]
        while todo:
            members, above, side, bounds = todo.pop()
            some = counts[members]
            spread = some.var(axis=0) if len(members) > most else np.zeros(1)
            if spread.max(initial=0) == 0:
                name = -1 - len(self.leaves)
                self.leaves.append(members)
            else:
                letter = int(spread.argmax())
                own = some[:, letter].astype(np.int64)
                middle = int(np.median(own))
                share = lambda c, own=own: abs(int((own <= c).sum()) * 2 - len(own))
                cut = min((c for c in (middle, middle - 1, middle + 1) if own.min() <= c < own.max()), key=share)
                low, high = bounds.get(letter, (0, 255))
                name = len(rows)
                rows.append([letter, cut, low, high, 0, 0])
                todo.append((members[own <= cut], name, 4, bounds | {letter: (low, cut)}))
                todo.append((members[own > cut], name, 5, bounds | {letter: (cut + 1, high)}))
            if above >= 0:
                rows[above][side] = name
        self.nodes = np.array(rows, dtype=np.int32).reshape(-1, 6)

    def home(self, counts: np.ndarray) -> np.ndarray:
        """The leaf that each row's counts fall into."""
        at = np.zeros(len(counts), dtype=np.int64) if len(self.nodes) else np.full(len(counts), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            letter, cut, _, _, left, right = self.nodes[at[inner]].T
            at[inner] = np.where(counts[inner, letter] <= cut, left, right)
        return -1 - at

    def reached(self, counts: np.ndarray, more: int, fewer: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves whose boxes hold counts with at most ``more`` letters added and ``fewer`` taken away."""
        q = np.arange(len(counts))
        if not len(self.nodes):
            return q, np.zeros(len(counts), dtype=np.int64)
        at, up, down = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int32), np.zeros(len(q), dtype=np.int32)
        found = []
        while len(q):
            letter, cut, low, high, left, right = self.nodes[at].T
            own = counts[q, letter].astype(np.int32)
            to_left = down - np.maximum(own - high, 0) + np.maximum(own - cut, 0)
            to_right = up - np.maximum(low - own, 0) + np.maximum(cut + 1 - own, 0)
            l, r = to_left <= fewer, to_right <= more
            at = np.r_[left[l], right[r]].astype(np.int64)
            q, up, down = np.r_[q[l], q[r]], np.r_[up[l], to_right[r]], np.r_[to_left[l], down[r]]
            leaf = at < 0
            found.append((q[leaf], -1 - at[leaf]))
            q, at, up, down = q[~leaf], at[~leaf], up[~leaf], down[~leaf]
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def one_edit(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which rows of ``q`` are one edit from those of ``c``, which are as long or one letter longer."""
    if q.shape[1] == c.shape[1]:
        return (q != c).sum(axis=1) == 1
    ahead = np.logical_and.accumulate(q == c[:, :-1], axis=1).sum(axis=1)
    behind = np.logical_and.accumulate((q == c[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return ahead + behind >= q.shape[1]


def _half_keys(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first half of a word of ``length`` letters and of the rest, which a word one letter shorter shares from its end."""
    weights = np.random.default_rng(length).integers(1, 2**63, size=length, dtype=np.uint64) | np.uint64(1)
    half = length // 2
    wide = codes.astype(np.uint64)
    with np.errstate(over="ignore"):
        return wide[:, :half] @ weights[:half], wide[:, wide.shape[1] - (length - half) :] @ weights[half:]


def _equal_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) with a[i] == b[j], in parts."""
    order = np.argsort(b, kind="stable")
    first, last = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    yield from _expanded(np.arange(len(a)), first, last - first, order)


def _expanded(q, first, size, order, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each q with order[first], order[first + 1], ... (``size`` of them), at most about ``most`` pairs at a time."""
    before = np.r_[0, np.cumsum(size)]
    at = 0
    while at < len(q):
        end = max(at + 1, int(np.searchsorted(before, before[at] + most, "right")) - 1)
        n = size[at:end]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(q[at:end], n), order[np.repeat(first[at:end], n) + within]
        at = end


def _verified(q, c, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, COMPARED // max(1, c.shape[1]))
    for i, j in pairs:
        for at in range(0, len(i), step):
            a, b = i[at : at + step], j[at : at + step]
            near = one_edit(q[a], c[b])
            yield a[near], b[near]


def near_pairs(tree: Tree, members: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, member) of all pairs one edit apart. The tree holds the counts of ``members``; queries are as long or one shorter."""
    same = members.shape[1] == queries.shape[1]
    sizes = np.array([len(x) for x in tree.leaves], dtype=np.int64)
    order = np.concatenate(tree.leaves)
    first = np.cumsum(sizes) - sizes
    big = sizes > LEAF
    found = []
    step = max(64, min(AT_ONCE, (1 << 24) // max(1, queries.shape[1])))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        q, leaf = tree.reached(letter_counts(some), 1, int(same))
        plain = ~big[leaf]
        found += [(a + at, b) for a, b in _verified(some, members, _expanded(q[plain], first[leaf[plain]], sizes[leaf[plain]], order))]
        for number in np.unique(leaf[~plain]).tolist():
            asked, own = q[leaf == number], tree.leaves[number]
            keys = zip(_half_keys(some[asked], members.shape[1]), _half_keys(members[own], members.shape[1]), strict=True)
            met = np.unique(np.concatenate([i * len(own) + j for a, b in keys for i, j in _equal_pairs(a, b)]))
            found += [(a + at, b) for a, b in _verified(some, members, iter([(asked[met // len(own)], own[met % len(own)])]))]
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _box(batch: pd.DataFrame) -> pd.DataFrame:
    """Of a box's words and queries: per word its near words here and the best of them."""
    empty = pd.DataFrame({"word": pd.Series(dtype=str), "n_near": pd.Series(dtype="int64"), "form": pd.Series(dtype=str), "form_n": pd.Series(dtype="int64")})
    inside = batch[batch["home"]]
    if not len(inside):
        return empty
    length = int(batch["length"].iloc[0])
    words, n = inside["word"].to_numpy(), inside["n"].to_numpy()
    members = codes_of(words.tolist(), length)
    tree = Tree(letter_counts(members), LEAF)
    sides = []
    own_size = batch["word"].str.len().to_numpy()
    for size in {length, length - 1} & set(own_size.tolist()):
        asked = batch[own_size == size]
        i, j = near_pairs(tree, members, codes_of(asked["word"].tolist(), size))
        a, a_n = asked["word"].to_numpy()[i], asked["n"].to_numpy()[i]
        sides.append((a, words[j], n[j]))
        if size < length:
            sides.append((words[j], a, a_n))
    word, form, form_n = (np.concatenate(x) for x in zip(*sides, strict=True)) if sides else ([], [], [])
    if not len(word):
        return empty
    pairs = pd.DataFrame({"word": word, "form": form, "form_n": form_n})
    best = pairs.sort_values(["word", "form_n", "form"], ascending=[True, False, True]).drop_duplicates("word")
    best["n_near"] = best["word"].map(pairs["word"].value_counts())
    return best[["word", "n_near", "form", "form_n"]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words (word, n; distinct) that have near words: how many, and the most frequent."""
    spark = words.sparkSession
    n_words = words.count()
    often = min(1.0, SAMPLE / max(1, n_words))
    picked = words if often == 1 else words.filter(F.pmod(F.xxhash64("word"), F.lit(1_000_003)) < int(1_000_003 * often))

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, own in batch.groupby(batch["word"].str.len())["word"]:
                raw = letter_counts(codes_of(own.tolist(), int(size)))
                yield pd.DataFrame({"size": int(size), "counts": [x.tobytes() for x in raw]})

    sample = picked.select("word").mapInPandas(sizes, "size int, counts binary").toPandas()
    most = max(1, int(BOX * often), -(-len(sample) // 8192))
    trees = {}
    for size, own in sample.sort_values("counts").groupby("size")["counts"]:
        tree = Tree(np.frombuffer(b"".join(own), dtype=np.uint8).reshape(-1, LETTERS), most)
        tree.leaves = []
        trees[int(size)] = tree
    sent = spark.sparkContext.broadcast(trees)
    whole = Tree(np.zeros((0, LETTERS), dtype=np.uint8), 1)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, own in batch.groupby(batch["word"].str.len()):
                size = int(size)
                word, n = own["word"].to_numpy(), own["n"].to_numpy()
                counts = letter_counts(codes_of(word.tolist(), size))
                tree, longer = sent.value.get(size, whole), sent.value.get(size + 1, whole)
                home = tree.home(counts)
                for length, (q, box) in ((size, tree.reached(counts, 1, 1)), (size + 1, longer.reached(counts, 1, 0))):
                    inside = (home[q] == box) & (length == size)
                    yield pd.DataFrame({"length": length, "box": box, "home": inside, "word": word[q], "n": n[q]})

    boxes = words.select("word", "n").mapInPandas(routed, "length int, box long, home boolean, word string, n long")
    found = boxes.groupBy("length", "box").applyInPandas(_box, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))
    )


def with_roots(words: DataFrame, most: int, factor: int) -> DataFrame:
    """``words`` (word, form, n, ...) with ``root``, from each word along the forms to the last.

    ``most`` is the greatest n. A form has ``factor`` times the n of its word, so there are at most
    log(most) / log(factor) steps, and each round doubles how many are taken.
    """
    steps = max(1, ceil(log(max(most, 2)) / log(factor)))
    ways = written(words.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "ways")
    for _ in range(ceil(log2(steps)) if steps > 1 else 0):
        onward = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(ways.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "ways")
        drop_written(ways)
        ways = longer
    return words.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def spelling_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6, least: int = 5, drop_every: int = 199, factor: int = 5
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each frequent word of the texts."""
    words = written(word_counts(docs, id_col, text_col, shortest, least, drop_every), "words")
    near = near_words(words)
    is_form = F.col("form_n") >= factor * F.col("n")
    joined = written(
        words.join(near, "word", "left").select(
            "word",
            F.when(is_form, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    most = joined.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    return with_roots(joined, most, factor).select("word", "form", "root", "n", "n_near", "form_n")
