"""Document probabilities under a subword lattice.

A document is the sequence of its words and an end. A word's arcs are the pieces of an
existing vocabulary (those with a space mark open it, the others continue it), single
bytes, and, for words of the training rows, the whole word. Its probability is the sum over all its
segmentations, found by a forward recursion in log space; whether the word goes on
is part of each piece's choice, so probabilities sum to one over all documents. A
document's score is the log10 of the product over its words and its end.

The pieces' probabilities follow the existing vocabulary's scores, by which all segmentations are weighted. Training goes
over all training rows. Words are counted per task in bounded counters and summed
by Spark; the table of distinct words, which grows with the corpus, stays a table. A whole word has
its count less ``DISCOUNT``, and what is taken off is left to the pieces: a pass runs forward and backward over
all distinct words, weighted by what was taken off, and adds to the vocabulary's probabilities, which keep ``OWN_SHARE``,
each piece's expected share. Only the piece table is collected: a row per piece and byte.

Both scores need each word's own count. The ``HOT_WORDS`` most frequent words are broadcast with
theirs (long ones by a digest); the others are looked up by a shuffled join, each with its probability by pieces, so that
no frequent word is ever a join key. The scores do not depend on which words are broadcast.

Defined results: a null text is the empty text, which is an end only. Rows that repeat a
doc_id are rows of their own. If there are no training rows, N and V are 0 and every token has
the same base probability, 1; the pieces keep the vocabulary's probabilities.
Null ids belong to training.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = "▁"
#: Words whose counts are broadcast.
HOT_WORDS = 200_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 400_000
#: Bytes of long words that a task counts before it passes its words on.
COUNTED_BYTES = 32_000_000
#: Words whose probability a task keeps.
KEPT = 500_000
#: Longer words are not kept, and broadcast by their digests.
KEPT_BYTES = 64
#: Texts that are scored at once.
AT_ONCE = 512
#: Expectation passes over the word table; without one the pieces have the vocabulary's probabilities alone.
PASSES = 1
#: What the vocabulary's own probabilities keep when expected shares are added.
OWN_SHARE = 0.1
#: Taken off the count of a word and left to its pieces.
DISCOUNT = 0.75
END = b""  # the end token in word tables; no word is empty


def tokens(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space."""
    return (text or "").encode().lower().split()


def word_key(word: bytes) -> bytes:
    """What a word is broadcast by: itself, or a NUL and its digest."""
    return word if len(word) <= KEPT_BYTES else b"\0" + sha256(word).digest()


def _word_key(word: Column) -> Column:
    digest = F.concat(F.lit(b"\0"), F.unhex(F.sha2(word, 256)))
    return F.when(F.length(word) <= KEPT_BYTES, word).otherwise(digest)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % modulus == remainder, F.lit(False))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n long) over all rows, ends included as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: Counter[bytes] = Counter()
        long = 0

        def passed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counted), pa.binary()), pa.array(list(counted.values()), pa.int64())],
                names=["word", "n"],
            )

        for batch in batches:
            for text in batch.column(0):
                words = tokens(text.as_py())
                counted.update(words)
                long += sum([len(w) for w in words if len(w) > KEPT_BYTES])
                if len(counted) > COUNTED or long > COUNTED_BYTES:
                    yield passed_on()
                    counted.clear()
                    long = 0
            counted[END] += batch.num_rows
        yield passed_on()

    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of all words that are worked on at once.
CHARS_AT_ONCE = 60_000
#: Starts of a word whose arcs are looked up at once where words are worked on one by one.
BLOCK = 50_000


class Lattice:
    """Log probabilities of pieces, bytes and a word's stop, and the recursions over words.

    Words are worked on in batches of equal length. A batch's arcs are found by looking up the
    hashes of all its substrings among those of the pieces. Where a batch has few words for their length, each is
    worked on by itself, the arcs of a block of starts at a time, and none are kept.
    """

    def __init__(self, pieces: list[str], log_p: np.ndarray, log_byte: np.ndarray, log_stop: float):
        self.pieces, self.log_p, self.log_byte, self.log_stop = pieces, log_p, log_byte, log_stop
        self._tables = None
        self._chars: dict[int, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_tables": None, "_chars": {}}

    @staticmethod
    def _hash(before: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (before + codes + np.uint64(1)) * _ODD

    def tables(self) -> tuple:
        """Sorted hashes, piece numbers and greatest length of opening and of continuing pieces; number of the bare mark."""
        if self._tables is None:
            made, bare = [], None
            for opens in (True, False):
                own = [(n, p[1:] if opens else p) for n, p in enumerate(self.pieces) if (p[0] == SPACE) == opens]
                if opens:
                    bare = next((n for n, text in own if not text), None)
                hashes = []
                for _, text in own:
                    h = np.zeros(1, dtype=np.uint64)
                    for c in text:
                        h = self._hash(h, np.uint64(ord(c)))
                    hashes.append(h[0])
                hashes, numbers = np.array(hashes, dtype=np.uint64), np.array([n for n, _ in own], dtype=np.int64)
                order = np.argsort(hashes)
                made.append((hashes[order], numbers[order], max((len(t) for _, t in own), default=0)))
            self._tables = (*made, bare)
        return self._tables

    def _by_bytes(self, codes: np.ndarray) -> np.ndarray:
        """ln p of characters as bytes."""
        chars, place = np.unique(codes, return_inverse=True)
        known = self._chars
        for c in chars.tolist():
            if c not in known:
                known[c] = sum(self.log_byte[b] for b in chr(c).encode())
        return np.array([known[c] for c in chars.tolist()])[place].reshape(codes.shape)

    def _arcs(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray | slice, np.ndarray | None, np.ndarray]]:
        """(start, end, words, piece numbers or None for bytes, ln p), opening ones (start -1) first, then by start.

        ``codes``: characters by words.
        """
        opening, going_on, bare = self.tables()
        length = len(codes)
        if bare is not None:
            everywhere = np.full(codes.shape[1], bare)
            yield -1, 0, slice(None), everywhere, self.log_p[everywhere]
        by_bytes = self._by_bytes(codes)
        for start in range(-1, length):
            hashes, numbers, longest = opening if start < 0 else going_on
            first = max(start, 0)
            if start >= 0:
                yield start, start + 1, slice(None), None, by_bytes[start]
            h = np.zeros(codes.shape[1], dtype=np.uint64)
            for end in range(first + 1, min(length, first + longest) + 1):
                h = self._hash(h, codes[end - 1])
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                words = np.flatnonzero(hashes[at] == h)
                if len(words):
                    found = numbers[at[words]]
                    yield start, end, words, found, self.log_p[found]

    @staticmethod
    def batches(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in ``words``, characters by words) of batches of equal length."""
        by_length: dict[int, list[int]] = {}
        for n, w in enumerate(words):
            by_length.setdefault(len(w), []).append(n)
        for length, places in by_length.items():
            step = max(1, CHARS_AT_ONCE // max(1, length))
            for at in range(0, len(places), step):
                part = places[at : at + step]
                raw = "".join([words[n] for n in part]).encode("utf-32-le")
                codes = np.frombuffer(raw, dtype=np.uint32).astype(np.uint64).reshape(len(part), length)
                yield np.array(part), np.ascontiguousarray(codes.T)

    def _forward(self, codes: np.ndarray, arcs) -> np.ndarray:
        """Row j: ln of the sum over all ways to come to place j; the last row is the virtual start."""
        ahead = np.full((len(codes) + 2, codes.shape[1]), -np.inf)
        ahead[-1] = 0.0
        for start, end, words, _, value in arcs:
            ahead[end, words] = np.logaddexp(ahead[end, words], ahead[start, words] + value)
        return ahead

    @staticmethod
    def _one_by_one(codes: np.ndarray) -> bool:
        length, words = codes.shape
        return words * (128 + length) < 64 * length

    def _openings(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(end, piece number) of the pieces that open a word."""
        (hashes, numbers, longest), _, bare = self.tables()
        found = [] if bare is None else [(0, bare)]
        h = np.zeros(1, dtype=np.uint64)
        for end in range(1, min(len(codes), longest) + 1):
            h = self._hash(h, codes[end - 1])
            at = np.searchsorted(hashes, h[0])
            if at < len(hashes) and hashes[at] == h[0]:
                found.append((end, int(numbers[at])))
        return found

    def _onward(self, codes: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and ln p of a block's arcs by start, pieces' numbers by length and start (-1: none), ln p of its bytes.

        A piece of one character and its bytes are one arc.
        """
        hashes, numbers, longest = self.tables()[1]
        n = min(BLOCK, len(codes) - first)
        piece = np.full((max(longest, 1), n), -1)
        value = np.full(piece.shape, -np.inf)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(longest):
            inside = min(n, len(codes) - first - k)
            if inside <= 0:
                break
            h = self._hash(h[:inside], codes[first + k : first + k + inside])
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            found = np.flatnonzero(hashes[at] == h)
            piece[k, found] = numbers[at[found]]
            value[k, found] = self.log_p[piece[k, found]]
        by_bytes = self._by_bytes(codes[first : first + n])
        value[0] = np.logaddexp(value[0], by_bytes)
        start, k = np.nonzero(np.isfinite(value.T))
        return start + first, start + first + k + 1, value[k, start], piece, by_bytes

    def _along(self, codes: np.ndarray) -> array:
        """ln of the sum over all ways to come to each place of one word."""
        ahead = array("d", [-math.inf]) * (len(codes) + 1)
        for end, number in self._openings(codes):
            ahead[end] = self.log_p[number]
        for first in range(0, len(codes), BLOCK):
            start, end, value, _, _ = self._onward(codes, first)
            _add_up(ahead, start, end, value)
        return ahead

    def _expect_one(self, codes: np.ndarray, weight: float, counts: np.ndarray, byte_counts: np.ndarray) -> None:
        forward = self._along(codes)
        backward = array("d", [-math.inf]) * (len(codes) + 1)
        backward[len(codes)] = 0.0
        ahead, back = np.frombuffer(forward), np.frombuffer(backward)
        whole = ahead[-1]
        for first in reversed(range(0, len(codes), BLOCK)):
            start, end, value, piece, by_bytes = self._onward(codes, first)
            _add_up(backward, end[::-1], start[::-1], value[::-1])
            k, at = np.nonzero(piece >= 0)
            number = piece[k, at]
            share = weight * np.exp(ahead[first + at] + self.log_p[number] + back[first + at + k + 1] - whole)
            counts += np.bincount(number, share, minlength=len(counts))
            last = first + len(by_bytes)
            share = weight * np.exp(ahead[first:last] + by_bytes + back[first + 1 : last + 1] - whole)
            self._count_bytes(codes[first:last], share, byte_counts)
        for end, number in self._openings(codes):
            counts[number] += weight * np.exp(self.log_p[number] + back[end] - whole)

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """ln of each word's sum over all segmentations: forward recursions in log space."""
        out = np.empty(len(words))
        for places, codes in self.batches(words):
            if self._one_by_one(codes):
                out[places] = [self._along(word)[-1] for word in np.ascontiguousarray(codes.T)]
            else:
                out[places] = self._forward(codes, self._arcs(codes))[len(codes)]
        return out + self.log_stop

    def expect(self, words: list[str], times: np.ndarray, counts: np.ndarray, byte_counts: np.ndarray) -> None:
        """Add the expected uses of each piece and byte in ``times`` occurrences of each word."""
        for places, codes in self.batches(words):
            if self._one_by_one(codes):
                for word, weight in zip(np.ascontiguousarray(codes.T), times[places], strict=True):
                    self._expect_one(word, weight, counts, byte_counts)
                continue
            arcs = list(self._arcs(codes))
            ahead = self._forward(codes, arcs)
            back = np.full_like(ahead, -np.inf)
            back[len(codes)] = 0.0
            weight = times[places]
            numbers, shares = [], []
            for start, end, own, found, value in reversed(arcs):
                onward = value + back[end, own]
                back[start, own] = np.logaddexp(back[start, own], onward)
                share = weight[own] * np.exp(ahead[start, own] + onward - ahead[len(codes), own])
                if found is not None:
                    numbers.append(found)
                    shares.append(share)
                else:
                    self._count_bytes(codes[start], share, byte_counts)
            counts += np.bincount(np.concatenate(numbers), np.concatenate(shares), minlength=len(counts))

    @staticmethod
    def _count_bytes(chars: np.ndarray, share: np.ndarray, byte_counts: np.ndarray) -> None:
        found, place = np.unique(chars, return_inverse=True)
        for c, total in zip(found.tolist(), np.bincount(place, share).tolist(), strict=True):
            for b in chr(c).encode():
                byte_counts[b] += total


def _add_up(sums: array, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> None:
    """For each arc in turn, add its start's sum times ``value`` to its end's, all as logarithms."""
    exp, log1p, nothing = math.exp, math.log1p, -math.inf
    for a, b, v in zip(start.tolist(), end.tolist(), value.tolist(), strict=True):
        v += sums[a]
        old = sums[b]
        if old == nothing:
            sums[b] = v
        elif old < v:
            sums[b] = v + log1p(exp(old - v))
        else:
            sums[b] = old + log1p(exp(v - old))


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of a SentencePiece model, best score first."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normal = type(model.pieces[0]).NORMAL
    pieces = [(p.score, p.piece) for p in model.pieces if p.type == normal]
    usable = [(v, t) for v, t in pieces if t.encode().lower() == t.encode() and SPACE not in t[1:]]
    return [t for _, t in sorted(usable, key=lambda x: -x[0])]


def _lattice(pieces: list[str], weight: np.ndarray, byte_weight: np.ndarray, stops: float) -> Lattice:
    """Opening pieces share one distribution; the others share one with the bytes and the stop."""
    opens = np.array([p[0] == SPACE for p in pieces])
    on = weight[~opens].sum() + byte_weight.sum() + stops
    log_p = np.log(weight) - np.where(opens, math.log(weight[opens].sum()), math.log(on))
    return Lattice(pieces, log_p, np.log(byte_weight) - math.log(on), math.log(stops / on))


def _expected(words: DataFrame, lattice) -> DataFrame:
    """(piece, n): expected counts over the word table; bytes are named by two hex digits after a NUL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Lattice = lattice.value
        counts, byte_counts, stops = np.zeros(len(model.pieces)), np.zeros(256), 0.0
        for batch in batches:
            own = [w.decode() for w in batch.column(0).to_pylist() if w]
            times = np.full(len(own), DISCOUNT)
            stops += times.sum()
            model.expect(own, times, counts, byte_counts)
        used = np.flatnonzero(counts)
        names = [*(model.pieces[i] for i in used), *(f"\0{b:02x}" for b in range(256)), ""]
        values = [*counts[used].tolist(), *byte_counts.tolist(), float(stops)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["piece", "n"]
        )

    counted = words.select("word").mapInArrow(run, "piece string, n double")
    return counted.groupBy("piece").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, path: str, passes: int = PASSES) -> Lattice:
    """The pieces' probabilities from the vocabulary's and a written table of word counts."""
    spark = words.sparkSession
    pieces = vocabulary(path)
    own = 1.0 / np.arange(10, 10 + len(pieces))  # the vocabulary's scores are ranks
    own_bytes = np.full(256, own.sum() / 25600)
    lattice = _lattice(pieces, own, own_bytes, own.sum() / 2)
    opens = np.array([p[0] == SPACE for p in pieces])
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(lattice)
        found = dict(_expected(words, sent).toPandas().itertuples(index=False))
        sent.unpersist()
        if not found.get(""):
            break
        weight = np.array([found.get(p, 0.0) for p in pieces])
        byte_weight = np.array([found.get(f"\0{b:02x}", 0.0) for b in range(256)])
        odds = OWN_SHARE / (1 - OWN_SHARE)
        first, on = odds * (weight[opens].sum() or 1.0), odds * (weight[~opens].sum() + byte_weight.sum() or 1.0)
        weight[opens] += first * own[opens] / own[opens].sum()
        weight[~opens] += on * own[~opens] / (own[~opens].sum() + own_bytes.sum())
        byte_weight += on * own_bytes / (own[~opens].sum() + own_bytes.sum())
        lattice = _lattice(pieces, weight, byte_weight, found[""])
    return lattice


def hot_words(words: DataFrame, most: int = HOT_WORDS) -> tuple[DataFrame, int]:
    """The words with more than ``least`` occurrences, and ``least``: ``most`` words at most."""
    level = F.floor(F.log2("n") * 16)
    levels = sorted(words.groupBy(level.alias("level")).agg(F.count(F.lit(1)), F.min("n")).collect(), reverse=True)
    taken, least = 0, None
    for _, n_words, lowest in levels:
        if (taken := taken + n_words) > most:
            break
        least = lowest - 1
    if least is None:
        least = max((int(2 ** ((r[0] + 1) / 16)) + 1 for r in levels), default=0)
    return words.filter(F.col("n") > least), least


@dataclass
class Model:
    """Shares of the whole words, the pieces and the end among all training tokens."""

    lattice: Lattice
    hot: dict[bytes, int]  # by word_key
    n_all: int
    n_ends: int
    n_words: int  # distinct words, the end not among them

    def __post_init__(self):
        # one more word and end than were seen, so that neither is impossible
        self.total = self.n_all + 2
        self.log_end = math.log((self.n_ends + 1) / self.total)
        self.log_by_pieces = math.log((DISCOUNT * self.n_words + 1) / self.total)

    def known(self, words: list[bytes]) -> Iterator[tuple[bytes, tuple[float, float | None]]]:
        """Each word with ln p (of its pieces alone, unless it's hot) and, if it's hot, log10 of one more than its count."""
        by_pieces = self.log_by_pieces + self.lattice.log_probabilities([w.decode() for w in words])
        counts = [self.hot.get(word_key(w)) for w in words]
        whole = np.array([0.0 if c is None else (c - DISCOUNT) / self.total for c in counts])
        with np.errstate(divide="ignore"):
            both = np.logaddexp(by_pieces, np.log(whole)).tolist()
        for word, p, count in zip(words, both, counts, strict=True):
            own = None if count is None else math.log10(count + 1)
            yield word, (p if word else self.log_end, own)


def _scored(docs: DataFrame, sent) -> DataFrame:
    """Per row what is known at once, and the words that aren't hot. ``docs``: _row, doc_id, held_out, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        known: dict[bytes, tuple[float, float | None]] = {}
        log10 = 1 / math.log(10)
        for whole in batches:
            out: list[tuple] = []
            for at in range(0, whole.num_rows, AT_ONCE):
                texts = [Counter(tokens(t.as_py())) for t in whole.column("text").slice(at, AT_ONCE)]
                for words in texts:
                    words[END] = 1
                if len(known) > KEPT:
                    known.clear()
                new = [w for w in set().union(*texts) if w not in known]
                known.update(model.known(new))
                for words in texts:
                    score, logs, n_known, rare, times, by_pieces = 0.0, 0.0, 0, [], [], []
                    for word, k in words.items():
                        p, log_count = known[word]
                        score += k * p
                        if log_count is None:
                            rare.append(word)
                            times.append(k)
                            by_pieces.append(p)
                        else:
                            n_known += k
                            logs += k * log_count
                    out.append((words.total(), n_known, logs, score * log10, rare, times, by_pieces))
                for word in new:
                    if len(word) > KEPT_BYTES:
                        del known[word]
            batch = whole
            columns = list(zip(*out, strict=True)) or [[]] * len(_SCORED)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("_row", "doc_id", "held_out")]
                + [pa.array(c, kind) for c, kind in zip(columns, _SCORED.values(), strict=True)],
                names=["_row", "doc_id", "held_out", *_SCORED],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run,
        f"_row long, doc_id {id_type}, held_out boolean, n_tokens long, hot_known long, hot_logs double, "
        "score double, rare array<binary>, times array<long>, by_pieces array<double>",
    )


_SCORED = {
    "n_tokens": pa.int64(),
    "hot_known": pa.int64(),
    "hot_logs": pa.float64(),
    "score": pa.float64(),
    "rare": pa.list_(pa.binary()),
    "times": pa.list_(pa.int64()),
    "by_pieces": pa.list_(pa.float64()),
}


def score_documents(
    docs: DataFrame,
    path: str,
    modulus: int = 7,
    remainder: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    passes: int = PASSES,
    most_hot: int = HOT_WORDS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    held = held_out(id_col, modulus, remainder)
    words = written(word_counts(docs.filter(~held), text_col), "word-counts")
    n_all, n_distinct = (int(x or 0) for x in words.agg(F.sum("n"), F.count(F.lit(1))).first())
    frequent, least = hot_words(words, most_hot)
    hot = {bytes(w): int(n) for w, n in frequent.select(_word_key(F.col("word")), "n").toPandas().itertuples(index=False)}
    n_ends = int(words.filter(F.length("word") == 0).agg(F.sum("n")).first()[0] or 0)
    own = Model(fit(words, path, passes), hot, n_all, n_ends, n_distinct - (n_ends > 0))
    model = spark.sparkContext.broadcast(own)
    scored = written(
        _scored(
            docs.select(
                F.monotonically_increasing_id().alias("_row"),
                F.col(id_col).alias("doc_id"),
                held.alias("held_out"),
                F.col(text_col).alias("text"),
            ),
            model,
        ),
        "scored",
    )
    # ln of pieces and whole word together, less that of the pieces, which the score has already
    by_pieces, whole = F.col("by_pieces"), F.log((F.col("n") - DISCOUNT) / own.total)
    gain = F.greatest(by_pieces, whole) + F.log1p(F.exp(-F.abs(by_pieces - whole))) - by_pieces
    gain = F.when(F.length("word") > 0, gain / math.log(10)).otherwise(0.0)
    cold = (
        scored.select("_row", F.explode(F.arrays_zip("rare", "times", "by_pieces")).alias("r"))
        .select("_row", F.col("r.rare").alias("word"), F.col("r.times").alias("k"), F.col("r.by_pieces").alias("by_pieces"))
        .join(words.filter(F.col("n") <= least), "word")
        .groupBy("_row")
        .agg(
            F.sum("k").alias("cold_known"),
            F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("cold_logs"),
            F.sum(F.col("k") * gain).alias("cold_gain"),
        )
    )
    denominator = math.log10(n_all + n_distinct + 1)
    logs = F.col("hot_logs") + F.coalesce(F.col("cold_logs"), F.lit(0.0))
    return (
        scored.drop("rare", "times", "by_pieces")
        .join(cold, "_row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("hot_known") + F.coalesce(F.col("cold_known"), F.lit(0))).alias("n_known"),
            F.lit(n_all).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
            (F.col("score") + F.coalesce(F.col("cold_gain"), F.lit(0.0))).alias("score"),
        )
    )
