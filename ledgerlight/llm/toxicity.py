"""Toxicity by a subsequence string kernel and a support vector machine with Nyström landmarks.

A text is a bag of units: its words without anything but letters, runs of single letters
joined to one word, and neighbouring words of at most ``FRAGMENT`` letters each joined to one, so that ``id-i.ot``,
``i d i o t`` and ``id iot`` are units like ``idiot``. The kernel of two
units counts their common subsequences of ``ORDER`` letters, each weighted by ``DECAY`` to the power
of its span in both, normalised to 1 for equal units; inserted letters and gaps only lower
it. Units of more than ``WINDOW`` letters are taken as overlapping windows, whole, in training as in
scoring. The features of a unit are its kernel values to ``LANDMARKS`` units taken from labelled
texts, whitened by the landmarks' own kernel matrix (Nyström). A linear machine over them
gives each unit a margin; a text has the largest margin of its units, turned into a
probability by a logistic curve.

Labels are of texts, not of words, so training alternates: the machine is fitted to one unit of each
toxic text, which counts as often as toxic texts have it, and to a working set of ``WORKING_SET`` units of clean texts; then each toxic text's unit of largest margin among those that
clean texts hardly hold makes the next training set, with the clean units of largest margins among all of them, and others by
chance. Toxic units also enter with a letter put in, so that the machine learns to overlook it. The fit runs on
the driver over a bounded sample of labelled texts, ``max_toxic`` and ``max_clean``; a
quarter of them are kept for the logistic curve.

For scoring, the landmarks' weights are folded into one table of weights per letter triple, so a unit's margin costs
the same however many landmarks there are. The table holds the landmarks' triples only, however many letters a script has.

Defined results: a null text, an empty one and one without units have the smallest
margin, so a low score. Rows of a repeated doc_id are scored each. Labels that are null, or whose id is, are left out;
of labels that contradict each other for one doc_id any toxic wins. With no
toxic or no clean label every score is the share of toxic labels, or 0. An empty table gives an empty result. Extra columns
play no part and are passed on, whatever their names; one of the output's name is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 3
DECAY = 0.6
WINDOW = 20
LANDMARKS = 192
#: Bounds of the labelled sample that is collected for training.
MAX_TOXIC = 2500
MAX_CLEAN = 4000
#: Units of clean texts that one round of training looks at; between rounds all of them are scored for the next.
WORKING_SET = 6000
ROUNDS = 4
#: A unit may be an insult if its share of toxic texts is at least so many times that of clean texts, whose labels may err.
RATIO = 10
#: Price of a margin that falls short, small since labels err: margins follow what many texts agree on. This and RATIO were chosen
#: inside the learning rows (``tests/llm/choose_toxicity.py``): of 18 settings the one of highest recall at 2.5 % false alarms at most.
COST = 0.03
#: Letters of neighbouring words that are tried as one.
FRAGMENT = 4
#: Margins are cut to this range; a text without units has the lower end.
RANGE = 4.0
#: Words whose margin a worker keeps, and letters of the longest of them.
KEPT = 400_000
KEPT_LETTERS = 64
AT_ONCE = 256
#: Cells up to which the table of triple weights is an array by three letters.
DENSE = 1 << 22


def words_of(text: str | None) -> set[str]:
    """Lower-case words as they are written, runs of three or more single letters joined, and short neighbours joined."""
    words = (text or "").lower().split()
    found = set(words)
    sizes = list(map(len, words))
    found.update([a + b for a, b, m, n in zip(words, words[1:], sizes, sizes[1:], strict=False) if m <= FRAGMENT >= n])
    single = [i for i, n in enumerate(sizes) if n == 1]
    if len(single) > 2:
        run = [single[0]]
        for i in [*single[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
            else:
                if len(run) > 2:
                    found.add("".join(words[k] for k in run))
                run = [i]
    return found


def unit_of(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def windows(unit: str) -> list[str]:
    if len(unit) <= WINDOW:
        return [unit]
    step = WINDOW // 2
    return [unit[i : i + WINDOW] for i in range(0, len(unit) - step, step)]


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all triples in a unit of n letters, and their weights."""
    places = np.array(list(combinations(range(n), ORDER)), dtype=np.intp).reshape(-1, ORDER)
    return places, DECAY ** (places[:, -1] - places[:, 0] + 1).astype(np.float32)


@lru_cache(maxsize=64)
def _gaps(n: int) -> np.ndarray:
    i, j = np.indices((n, n))
    return np.where(j < i, DECAY ** np.maximum(i - j - 1, 0).astype(float), 0.0).astype(np.float32)


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row (a unit of equal length) with itself."""
    same = (codes[:, :, None] == codes[:, None, :]) * np.float32(DECAY**2)
    gaps = _gaps(codes.shape[1])
    ends = same
    for _ in range(ORDER - 1):
        ends = same * (gaps @ ends @ gaps.T)
    return ends.sum(axis=(1, 2))


def _points(words: list[str], length: int) -> np.ndarray:
    """Letters of words of one length, as numbers."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").reshape(len(words), length).astype(np.int64)


def _by_length(units: list[str]) -> dict[int, list[tuple[int, str]]]:
    """Windows of the units by their length, each with its unit's number."""
    found: dict[int, list[tuple[int, str]]] = {}
    for n, unit in enumerate(units):
        if len(unit) >= ORDER:
            for window in windows(unit):
                found.setdefault(len(window), []).append((n, window))
    return found


class Triples:
    """Numbers of the letter triples that some units have; all others, and those with other letters, are the last number."""

    def __init__(self, units: list[str]):
        self.letters = np.array(sorted({ord(c) for u in units for c in u}), dtype=np.int64)
        self.size = len(self.letters)
        keys = [self._keys(_points([w for _, w in own], n))[0] for n, own in _by_length(units).items()]
        self.keys = np.unique(np.concatenate([k.ravel() for k in keys])) if keys else np.empty(0, dtype=np.int64)
        self.table = None
        if self.size**3 <= DENSE:
            self.table = np.full(self.size**3 + 1, len(self.keys), dtype=np.int32)
            self.table[self.keys] = np.arange(len(self.keys))

    def _keys(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word the keys of its triples (the greatest for triples with other letters), and the triples' weights."""
        places, decay = _triples(points.shape[1])
        at = np.minimum(np.searchsorted(self.letters, points), max(self.size - 1, 0))
        other = self.letters[at] != points if self.size else np.ones(points.shape, dtype=bool)
        keys = (at[:, places[:, 0]] * self.size + at[:, places[:, 1]]) * self.size + at[:, places[:, 2]]
        if other.any():
            keys[other[:, places].any(axis=2)] = self.size**3
        return keys, decay

    def numbers(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, decay = self._keys(points)
        if self.table is not None:
            return self.table[keys], decay
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys)), decay

    def mapped(self, units: list[str], columns: np.ndarray) -> np.ndarray:
        """Normalised features of units of at most WINDOW letters, times ``columns``: a row per triple and one of zeros."""
        out = np.zeros((len(units), columns.shape[1]), dtype=np.float32)
        for length, members in _by_length(units).items():
            for at in range(0, len(members), 2048):
                part = members[at : at + 2048]
                points = _points([w for _, w in part], length)
                numbers, decay = self.numbers(points)
                value = np.zeros((len(part), columns.shape[1]), dtype=np.float32)
                for k, weight in enumerate(decay):
                    value += weight * columns[numbers[:, k]]
                out[[n for n, _ in part]] = value / np.sqrt(self_kernel(points))[:, None]
        return out

    def features(self, units: list[str]) -> np.ndarray:
        """Normalised features of a few units of at most WINDOW letters, dense."""
        out = np.zeros((len(units), len(self.keys) + 1), dtype=np.float32)
        for length, members in _by_length(units).items():
            for n, window in members:
                points = _points([window], length)
                numbers, decay = self.numbers(points)
                np.add.at(out[n], numbers[0], decay / np.sqrt(self_kernel(points)[0]))
        out[:, -1] = 0
        return out


@dataclass
class UnitScorer:
    """Margins from weights per letter triple, the last of which is 0."""

    triples: Triples
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, units: list[str]) -> np.ndarray:
        out = np.full(len(units), -RANGE, dtype=np.float32)
        for length, members in _by_length(units).items():
            for at in range(0, len(members), 512):
                part = members[at : at + 512]
                points = _points([w for _, w in part], length)
                numbers, decay = self.triples.numbers(points)
                value = (self.weights[numbers] @ decay) / np.sqrt(self_kernel(points)) + self.bias
                np.maximum.at(out, [n for n, _ in part], value.astype(np.float32))
        return out

    def probability(self, margin: float) -> float:
        value = self.slope * min(max(margin, -RANGE), RANGE) + self.shift
        return float(1 / (1 + np.exp(-value)))


def _svm(z: np.ndarray, y: np.ndarray, times: np.ndarray, cost: float = COST) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss, by Newton steps; the last is the bias.

    Each row counts ``times``, and both classes together the same.
    """
    z = np.hstack([z, np.ones((len(z), 1), dtype=z.dtype)]).astype(np.float64)
    weight = cost * len(y) * times / np.where(y > 0, times[y > 0].sum(), times[y < 0].sum())
    loss = lambda w: w @ w / 2 + (weight / 2) @ np.maximum(1 - y * (z @ w), 0) ** 2
    w = np.zeros(z.shape[1])
    for _ in range(50):
        short = y * (z @ w) < 1
        zs, ws = z[short], weight[short]
        goal = np.linalg.solve(np.eye(len(w)) + (zs * ws[:, None]).T @ zs, zs.T @ (ws * y[short]))
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * (goal - w)) > now:
            step /= 2
        w, before = w + step * (goal - w), w
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def _fit_units(landmarks: list[str], positive: dict[str, float], negative: list[str]) -> UnitScorer:
    triples = Triples(landmarks)
    base = triples.features(landmarks)
    value, vector = np.linalg.eigh((base @ base.T).astype(np.float64))
    kept = value > 1e-4
    whiten = vector[:, kept] / np.sqrt(value[kept])
    z = triples.mapped([*positive, *negative], (base.T @ whiten).astype(np.float32))
    y = np.array([1] * len(positive) + [-1] * len(negative))
    w = _svm(z, y, np.array([*positive.values(), *[1.0] * len(negative)]))
    return UnitScorer(triples, ((whiten @ w[:-1]) @ base).astype(np.float32), float(w[-1]))


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton steps with a small penalty on the slope."""
    slope, shift = 1.0, 0.0
    x = np.column_stack([margin, np.ones(len(margin))])
    penalty = np.diag([0.05, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [slope, shift], -30, 30)))
        gradient = x.T @ (p - y) + penalty @ [slope, shift]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, gradient)
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
    return max(float(slope), 0.0), float(shift)


def _disguised(
    units: dict[str, float], letters: list[str], clean: Counter, pick: np.random.Generator
) -> dict[str, float]:
    """The units, and each with one letter put in, twice by chance and once doubled, unless a clean text has that."""
    out = dict(units)
    for unit, times in units.items():
        if ORDER + 1 < len(unit) < WINDOW:
            for letter in (*pick.choice(letters, 2), None):
                at = int(pick.integers(1, len(unit)))
                other = unit[:at] + (letter or unit[at]) + unit[at:]
                if other not in clean:
                    out.setdefault(other, times)
    return out


def train(texts: list[tuple[list[str], int]]) -> UnitScorer:
    """``texts``: units of each labelled text, and its label."""
    bags = [(sorted({w for u in units if len(u) >= ORDER for w in windows(u)}), y) for units, y in texts]
    n_toxic = sum(y for _, y in bags)
    if not n_toxic or n_toxic == len(bags):
        share = min(max(n_toxic / max(1, len(bags)), 1e-3), 1 - 1e-3)
        return UnitScorer(Triples([]), np.zeros(1, dtype=np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    kept_out = {n for y in (0, 1) for n in [n for n, b in enumerate(bags) if b[1] == y][3::4]}
    fitted = [b for n, b in enumerate(bags) if n not in kept_out]
    toxic = [b for b, y in fitted if y]
    in_toxic, in_clean = Counter(), Counter()
    for units, y in fitted:
        (in_toxic if y else in_clean).update(units)
    n_clean = len(fitted) - len(toxic)
    suspicious = {u for u, n in in_toxic.items() if in_clean[u] * len(toxic) * RATIO <= n * n_clean}
    suspects = [[u for u in b if u in suspicious] or b for b in toxic]
    suspects = [b for b in suspects if b]
    clean = sorted(u for u in in_clean if u not in suspicious)
    pick = np.random.default_rng(7)
    positive = {u: in_toxic[u] for u in sorted({max(b, key=lambda u: (in_toxic[u], u)) for b in suspects})}
    common = [u for u, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))[: LANDMARKS // 4]]
    alphabet = sorted({c for u in positive for c in u})
    hard: list[str] = []
    scorer = None
    for _ in range(ROUNDS):
        ranked = sorted(positive, key=lambda u: (-positive[u], u))
        landmarks = list(dict.fromkeys([*ranked[: LANDMARKS // 2], *common, *hard[: LANDMARKS // 4]]))
        spare = pick.choice(len(clean), min(len(clean), WORKING_SET - min(len(hard), WORKING_SET // 2)), replace=False)
        negative = list(dict.fromkeys([*hard[: WORKING_SET // 2], *(clean[i] for i in sorted(spare))]))
        scorer = _fit_units(landmarks, _disguised({u: positive[u] for u in ranked}, alphabet, in_clean, pick), negative)
        margin = dict(zip(clean, scorer.margins(clean).tolist(), strict=True))
        hard = sorted(clean, key=lambda u: (-margin[u], u))[: WORKING_SET // 2]
        names = sorted({u for b in suspects for u in b})
        margin = dict(zip(names, scorer.margins(names).tolist(), strict=True))
        chosen = {max(b, key=lambda u: (margin[u], u)) for b in suspects}
        chosen |= {u for u in names if margin[u] > 0.5 and in_toxic[u] > 1 and u in suspicious}
        positive = {u: in_toxic[u] for u in sorted(chosen)}
    rest = [bags[n] for n in sorted(kept_out)]
    rest = rest if len({y for _, y in rest}) == 2 else bags
    margin = np.array([max(scorer.margins(units).tolist(), default=-RANGE) for units, _ in rest])
    scorer.slope, scorer.shift = _logistic(np.clip(margin, -RANGE, RANGE), np.array([y for _, y in rest]))
    return scorer


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN
) -> list[tuple[list[str], int]]:
    """Units of at most ``max_toxic`` and ``max_clean`` labelled texts, by the hash of their ids."""
    marks = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("_toxic"))
    order = F.xxhash64(F.col(id_col))
    chosen = [
        marks.filter(F.col("_toxic") == y).orderBy(order, id_col).limit(most)
        for y, most in ((1, max_toxic), (0, max_clean))
    ]
    ids = chosen[0].unionByName(chosen[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [sorted({unit_of(w) for w in words_of(t)}) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_toxic"), pa.array(units, pa.list_(pa.string()))],
                names=["_id", "_toxic", "units"],
            )

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(
        F.broadcast(ids.withColumnRenamed(id_col, "_label_id")), F.col("_id") == F.col("_label_id")
    )
    found = (
        texts.select("_id", F.col("_toxic").cast("int").alias("_toxic"), "text")
        .mapInArrow(run, f"_id {docs.schema[id_col].dataType.simpleString()}, _toxic int, units array<string>")
        .toArrow()
    )
    rows = sorted(
        (key, [intern(u) for u in units.as_py()], int(y == 1))
        for key, y, units in zip(found["_id"].to_pylist(), found["_toxic"].to_pylist(), found["units"], strict=True)
    )
    return [(units, y) for _, units, y in rows]


def score_texts(docs: DataFrame, scorer: UnitScorer, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with a column of scores in place of any of that name; all other columns are passed on."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    docs = docs.drop(out_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: UnitScorer = sent.value
        known: dict[str, float] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                texts = [words_of(t) for t in batch.column(text_col).to_pylist()]
                new = list({w for words in texts for w in words if w not in known})
                units = list(dict.fromkeys(map(unit_of, new)))
                margin = dict(zip(units, model.margins(units).tolist(), strict=True))
                known.update((w, margin[unit_of(w)]) for w in new)
                scores = [model.probability(max(map(known.__getitem__, words), default=-RANGE)) for words in texts]
                if len(known) > KEPT:
                    known.clear()
                for word in new:
                    if len(word) > KEPT_LETTERS:
                        known.pop(word, None)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, out_col]
                )

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    return F.coalesce(crc % 5 == 0, F.lit(False))


def trained_on(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_toxic: int = MAX_TOXIC,
    max_clean: int = MAX_CLEAN,
) -> UnitScorer:
    """A scorer from the labels whose documents aren't held out, at most so many toxic and clean ones."""
    return train(labelled_sample(docs, labels.filter(~held_out(id_col)), id_col, text_col, max_toxic, max_clean))
