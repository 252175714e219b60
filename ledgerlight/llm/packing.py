"""Packing documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised once into pieces of at most ``capacity`` ids; the pieces' lengths and
checksums are written to the shared folder, and only those are moved afterwards. A
piece that fills a sequence has it for itself. All other pieces are dealt by hash
to shards of about ``SHARD`` pieces, so one sequence per shard at most is wasted.

Each shard is evolved on ``ISLANDS`` islands. A packing is a list of bins. Crossover
injects whole well-filled bins of one parent into the other, takes away the bins there that
hold the same pieces, and best-fits the pieces this displaces, longest first; mutation
empties the worst bins and best-fits their pieces. After the first round, the elite of
each island moves to its neighbour (rows joined by shard and island), and a
second round follows. The best packing of a shard's islands wins. Random numbers
follow from shard and island alone, so a task that is run again gives the same rows.

Defined results: a null text is the empty text, which has the final id only. Rows that repeat
a doc_id are packed as documents of their own. Null ids stay null. An empty
table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_tokenizer import chunk_tokenizer
from .common import written
from .words import slices

CAPACITY = 2048
#: Id after each document.
FINAL_ID = 0
SHARD = 3000
ISLANDS = 2
POPULATION = 4
GENERATIONS = 40


def pieces_of(docs: DataFrame, vocabulary: tuple, capacity: int = CAPACITY, id_col="doc_id", text_col="text", with_ids=True):
    """(doc_id, _row, piece, start, length, ids_crc32[, ids]) of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, _row long, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<long>" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = chunk_tokenizer(*vocabulary)
        final = FINAL_ID.to_bytes(4, "little")
        for whole in batches:
            at = 0
            for texts in slices(whole.column(2)):
                batch = whole.slice(at, len(texts))
                at += len(texts)
                of, piece, start, length, crc, ids = [], [], [], [], [], []
                for n, data in enumerate(tool.encode_all([t or "" for t in texts.to_pylist()])):
                    data += final
                    size = len(data) // 4
                    first = (size - 1) % capacity + 1
                    cuts = [0, *range(first, size + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        of.append(n)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(data[4 * a : 4 * b]))
                        if with_ids:
                            ids.append(np.frombuffer(data[4 * a : 4 * b], "<u4").astype(np.int64))
                rows = pa.array(of, pa.int64())
                columns = [
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "_row", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(
        F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).alias("text")
    ).mapInArrow(run, schema)


class Packer:
    """Packings of one shard: a packing is a list of bins, a bin a tuple of items."""

    def __init__(self, sizes: list[int], capacity: int, seed: int):
        self.sizes, self.capacity = sizes, capacity
        self.least = -(-sum(sizes) // capacity)
        self.random = random.Random(int(seed))

    def fill(self, bin_: tuple[int, ...]) -> int:
        return sum(map(self.sizes.__getitem__, bin_))

    def best_fit(self, bins: list[tuple[int, ...]], items: list[int]) -> list[tuple[int, ...]]:
        """Put each item into the fullest bin that has room for it, or into a new one."""
        if not items:
            return bins
        capacity, sizes = self.capacity, self.sizes
        smallest = min(map(sizes.__getitem__, items))
        closed: list[tuple[int, ...]] = []
        by_room: dict[int, list[list[int]]] = {}
        rooms = 0  # bit r is set if a bin has just r free places
        for b in bins:
            room = capacity - self.fill(b)
            if room < smallest:
                closed.append(b)
            else:
                by_room.setdefault(room, []).append(list(b))
                rooms |= 1 << room
        for item in items:
            size = sizes[item]
            if fitting := rooms >> size:
                room = size + (fitting & -fitting).bit_length() - 1
                chosen = by_room[room].pop()
                if not by_room[room]:
                    rooms ^= 1 << room
            else:
                room, chosen = capacity, []
            chosen.append(item)
            room -= size
            by_room.setdefault(room, []).append(chosen)
            rooms |= 1 << room
        closed.extend(tuple(b) for same in by_room.values() for b in same)
        return closed

    def longest_first(self, items: list[int], blur: float = 0.0) -> list[int]:
        noise = self.random.random
        return sorted(items, key=lambda i: -self.sizes[i] * (1 + blur * noise()))

    def rank(self, bins: list[tuple[int, ...]]) -> tuple[int, float]:
        """Lower is better: fewer bins, then bins of more unequal filling."""
        return len(bins), -sum(self.fill(b) ** 2 for b in bins)

    def first(self, n: int) -> list[list[tuple[int, ...]]]:
        items = list(range(len(self.sizes)))
        return [self.best_fit([], self.longest_first(items, blur)) for blur in [0.0, *[0.15] * (n - 1)]]

    def cross(self, mother: list[tuple[int, ...]], father: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        by_fill = sorted(father, key=self.fill, reverse=True)
        best = by_fill[: max(1, len(by_fill) // 2)]
        injected = self.random.sample(best, max(1, len(best) // 4))
        taken = {i for b in injected for i in b}
        kept, displaced = list(injected), []
        for b in mother:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced.extend(i for i in b if i not in taken)
        return self.best_fit(kept, self.longest_first(displaced))

    def mutate(self, bins: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        by_fill = sorted(bins, key=self.fill, reverse=True)
        emptied = max(2, len(by_fill) // 20)
        kept, rest = by_fill[:-emptied], by_fill[-emptied:]
        self.random.shuffle(kept)
        rest += kept[:emptied]
        return self.best_fit(kept[emptied:], self.longest_first([i for b in rest for i in b], 0.05))

    def evolve(self, population: list[list[tuple[int, ...]]], generations: int) -> list[list[tuple[int, ...]]]:
        ranked = sorted(((self.rank(b), n, b) for n, b in enumerate(population)), key=lambda x: x[:2])
        for n in range(generations):
            if ranked[0][0][0] <= self.least or len(ranked) < 2:
                break
            mother, father = self.random.sample(ranked, 2)
            child = self.cross(mother[2], father[2])
            if self.random.random() < 0.5:
                child = self.mutate(child)
            if (rank := self.rank(child)) < ranked[-1][0] and all(rank != r for r, _, _ in ranked):
                ranked[-1] = (rank, len(population) + n, child)
                ranked.sort(key=lambda x: x[:2])
        return [b for _, _, b in ranked]


def _genes(bins: list[tuple[int, ...]], n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(bins):
        out[list(b)] = k
    return out


def _bins(genes: np.ndarray) -> list[tuple[int, ...]]:
    order = np.argsort(genes, kind="stable")
    cuts = np.flatnonzero(np.diff(genes[order])) + 1
    return [tuple(b.tolist()) for b in np.split(order, cuts)]


_ISLAND = "shard int, island int, _row long, length long, genes array<int>"


def _island_frame(key: tuple, rows: pd.DataFrame, population: list[list[tuple[int, ...]]]) -> pd.DataFrame:
    genes = np.stack([_genes(b, len(rows)) for b in population], axis=1)
    return pd.DataFrame(
        {"shard": key[0], "island": key[1], "_row": rows["_row"], "length": rows["length"], "genes": list(genes)}
    )


def _settle(capacity: int):
    def island(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        packer = Packer(rows["length"].tolist(), capacity, seed=key[0] * ISLANDS + key[1])
        return _island_frame(key, rows, packer.evolve(packer.first(POPULATION), GENERATIONS))

    return island


def _migrate(capacity: int):
    def island(key: tuple, rows: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        guest = guests.sort_values("guest_row")["guest"].to_numpy()
        packer = Packer(rows["length"].tolist(), capacity, seed=~(key[0] * ISLANDS + key[1]))
        own = np.stack(rows["genes"].to_list(), axis=1)
        population = [_bins(g) for g in own[:-1]] + [_bins(guest)]
        return _island_frame(key, rows, packer.evolve(population, GENERATIONS)[:1])

    return island


def _choose(capacity: int):
    def shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best, places = None, None
        for _, own in rows.groupby("island"):
            own = own.sort_values("_row", ignore_index=True)
            packer = Packer(own["length"].tolist(), capacity, 0)
            bins = _bins(np.array([g[0] for g in own["genes"]]))
            if best is None or packer.rank(bins) < best:
                best, places = packer.rank(bins), (own, bins)
        own, bins = places
        order = [i for b in bins for i in b]
        length = own["length"].to_numpy()[order]
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(length)
        first = np.r_[0, np.flatnonzero(np.diff(number)) + 1]
        before = np.repeat(ends[first] - length[first], [len(b) for b in bins])
        return pd.DataFrame(
            {
                "_row": own["_row"].to_numpy()[order],
                "sequence_id": number + int(key[0]) * (1 << 32),
                "offset": ends - length - before,
            }
        )

    return shard


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) with sequence_id and offset."""
    full = pieces.filter(F.col("length") == capacity).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    open_ = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-open_.count() // SHARD))
    items = open_.select("_row", "length", F.pmod(F.xxhash64("_row"), F.lit(shards)).cast("int").alias("shard"))
    placed = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    settled = written(placed.groupBy("shard", "island").applyInPandas(_settle(capacity), _ISLAND), "islands")
    guests = settled.select(
        F.col("shard").alias("guest_shard"),
        F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("guest_island"),
        F.col("_row").alias("guest_row"),
        F.col("genes")[0].alias("guest"),
    )
    evolved = (
        settled.groupBy("shard", "island")
        .cogroup(guests.groupBy("guest_shard", "guest_island"))
        .applyInPandas(_migrate(capacity), _ISLAND)
    )
    chosen = evolved.groupBy("shard").applyInPandas(_choose(capacity), "_row long, sequence_id long, offset long")
    return full.unionByName(open_.join(chosen, "_row"))


def pack(
    docs: DataFrame,
    vocabulary: tuple,
    capacity: int = CAPACITY,
    id_col="doc_id",
    text_col="text",
    with_ids: bool = True,
) -> DataFrame:
    """``vocabulary``: a file of ranks, the pre-tokenizer's pattern and, if any, the added tokens with their ids.

    One row per piece: doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset."""
    pieces = written(pieces_of(docs, vocabulary, capacity, id_col, text_col, with_ids), "pieces")
    return pack_pieces(pieces, capacity).drop("_row")
