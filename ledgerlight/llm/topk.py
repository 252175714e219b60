"""Exact top-k inner products by three-phase uniform thresholds.

A vector's dimensions fall into slices; each slice is a node with lists of its own, sorted by the length of
the vectors' parts there, since a part's share of a score is at most the product of two lengths.

1. Gather: each slice gives, per query, the ``k`` best shares in the head of its list. The full scores of what was
   gathered give a score that ``k`` candidates reach: the safe cutoff. Heads are of bounded size.
2. Collect: a candidate that reaches the cutoff must have cutoff / slices in at least one slice, whatever
   the signs. That uniform threshold goes out with the queries. Each slice walks its list only
   as far as lengths allow a share of that size, and collects the entries that have it.
3. Resolve: of collected entries, shares that no walk has met are worked out, scores summed exactly, and those
   below the cutoff dropped; the ``k`` best per query and block of rows leave the task, and the ``k`` best of all stay.

The stated query set meets all rows in blocks: query blocks and row blocks of bounded bytes meet in cells by an
equi-join on the cell's number.

Defined results: vectors that are null, or hold null or non-finite components, take no
part. Vectors of unequal length compare as if the shorter went on with zeros.
Ties go to the smaller vec_id, and rows that repeat a vec_id are candidates of their own. A
query isn't matched to rows of its own id; a query id that is repeated asks with the smallest of its
vectors. Null ids take no part. Scores are 64-bit integers: a component or a score among the ``k`` best that doesn't fit
is an error, never another number. Empty tables give an empty result. Other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, written

SLICES = 4
#: Most vectors of a block, and bytes of their components.
QUERY_BLOCK = 4096
ROW_BLOCK = 16384
BLOCK_BYTES = 16 << 20
#: Vectors in the head of a slice's list, and bytes of all heads.
HEAD = 1024
HEAD_BYTES = 16 << 20
#: Queries of a cell that are scored at once.
AT_ONCE = 128


def quantised(vectors: DataFrame, id_col="vec_id", vector_col="embedding", scale: int = 64) -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of each component of the valid vectors."""
    v = F.col(vector_col)
    doubles = F.transform(v, lambda x: x.cast("double"))
    finite = ~F.exists(
        doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    whole = lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(
        F.raise_error(F.lit("a component doesn't fit 64 bits")).cast("long")
    )
    return vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(doubles, whole).alias("v")
    )


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which their products are exact; floats are multiplied fastest."""
    reach = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    kind = np.float64 if reach < 2.0**52 else np.int64 if reach < 2.0**62 else object
    return q.astype(kind), c.astype(kind)


def _cuts(width: int) -> list[slice]:
    step = max(1, -(-width // SLICES))
    return [slice(i, i + step) for i in range(0, max(width, 1), step)]


def _lengths(part: np.ndarray) -> np.ndarray:
    """Euclidean lengths, rounded up."""
    return np.sqrt((part.astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)


def safe_cutoffs(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, heads: list[np.ndarray], k: int) -> list:
    """Phase 1: per query a score that k candidates reach, or None. ``heads``: places in ``c`` of each slice's head."""
    out = []
    q, c = _exact(q, c)
    for at in range(0, len(q_ids), AT_ONCE):
        some, own = q[at : at + AT_ONCE], q_ids[at : at + AT_ONCE, None] == ids[None, :]
        gathered = np.zeros(own.shape, dtype=bool)
        for cut, head in zip(_cuts(q.shape[1]), heads, strict=True):
            share = some[:, cut] @ c[head][:, cut].T
            share = np.where(own[:, head], share.min(initial=0) - 1, share)
            best = head[np.argsort(-share, axis=1, kind="stable")[:, :k]]
            np.put_along_axis(gathered, best, True, axis=1)
        gathered &= ~own
        for vector, seen in zip(some, gathered, strict=True):
            scores = sorted((c[seen] @ vector).tolist(), reverse=True)
            out.append(int(scores[k - 1]) if len(scores) >= k else None)
    return out


def collect_and_resolve(q_ids, q, cutoffs, ids, c, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3 in a cell: places of queries and rows, scores, and the number of entries collected.

    At most k entries of a query, its best here, all at or above its cutoff.
    """
    q, c = _exact(q, c)
    cuts = _cuts(q.shape[1])
    lists = [(order := np.argsort(-(size := _lengths(c[:, cut])), kind="stable"), size[order]) for cut in cuts]
    found, n_collected = [], 0
    for at in range(0, len(q_ids), AT_ONCE):
        some = q[at : at + AT_ONCE]
        limits = cutoffs[at : at + AT_ONCE]
        bounded = all(x is not None for x in limits)
        limit = np.array([-(2**62) if x is None else x for x in limits], dtype=q.dtype)[:, None]
        no_limit = np.array([x is None for x in limits])[:, None]
        collected = np.zeros((len(some), len(ids)), dtype=bool)
        shares = []
        for cut, (order, size) in zip(cuts, lists, strict=True):
            walked = len(order)
            if bounded:
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = limit[:, 0].astype(np.float64) / len(cuts) / _lengths(some[:, cut])
                # a query of length 0 here has only shares of 0, which count if its limit is not above 0
                least = np.where(limit[:, 0].astype(np.float64) <= 0, 0.0, np.nan_to_num(least, nan=0.0)).min()
                walked = int(np.searchsorted(-size, -least, "right"))
            rows = order[:walked]
            share = some[:, cut] @ c[rows][:, cut].T
            collected[:, rows] |= (share * len(cuts) >= limit) | no_limit
            place = np.full(len(ids), -1)
            place[rows] = np.arange(walked)
            shares.append((share, place))
        collected &= q_ids[at : at + AT_ONCE, None] != ids[None, :]
        i, j = np.nonzero(collected)
        n_collected += len(i)
        score = np.zeros(len(i), dtype=q.dtype)
        for cut, (share, place) in zip(cuts, shares, strict=True):
            met = place[j] >= 0
            score[met] += share[i[met], place[j[met]]]
            if not met.all():
                score[~met] += (some[i[~met]][:, cut] * c[j[~met]][:, cut]).sum(axis=1)
        kept = (score >= limit[i, 0]) | no_limit[i, 0]
        i, j, score = i[kept], j[kept], score[kept]
        order = np.lexsort((ids[j], -score, i)) if score.dtype != object else np.array(
            sorted(range(len(i)), key=lambda n: (i[n], -score[n], ids[j[n]])), dtype=np.int64
        )
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        best = rank < k
        if score.dtype == object and any(abs(x) >= 2**63 for x in score[best]):
            raise OverflowError("a score doesn't fit 64 bits")
        found.append((i[best] + at, j[best], score[best].astype(np.int64)))
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, dtype=np.int64)] * 3
    return (*columns, n_collected)


def _cell(k: int, width: int):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q_ids, ids = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy()
        cutoffs = [None if pd.isna(x) else int(x) for x in queries["cutoff"].astype(object)]
        i, j, score, _ = collect_and_resolve(q_ids, _matrix(queries["v"], width), cutoffs, ids, _matrix(rows["v"], width), k)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": score})

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The k highest inner products for each query. Both inputs are (vec_id, v) as of ``quantised``."""
    spark = vectors.sparkSession
    rows = written(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("_n")), "vectors")
    asked = written(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    n_rows, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, asked_width = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, asked_width, 1)

    most = max(k, min(HEAD, HEAD_BYTES // (8 * width * SLICES)))
    square = lambda cut: F.aggregate(
        F.slice("v", cut.start + 1, cut.stop - cut.start), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")
    )
    lists = [rows.orderBy(square(cut).desc(), "_n").limit(most).toPandas() for cut in _cuts(width)]
    every = pd.concat(lists).drop_duplicates("_n", ignore_index=True)
    place = dict(zip(every["_n"], range(len(every)), strict=True))
    heads = [np.array([place[n] for n in own["_n"]], dtype=np.int64) for own in lists]
    sent = spark.sparkContext.broadcast((every["vec_id"].to_numpy(dtype=np.int64), _matrix(every["v"], width), heads))

    def gather(batches):
        ids, c, own = sent.value
        for batch in batches:
            cutoffs = safe_cutoffs(batch["vec_id"].to_numpy(), _matrix(batch["v"], width), ids, c, own, k)
            yield batch.assign(cutoff=pd.array(cutoffs, dtype="Int64"))

    told = written(asked.mapInPandas(gather, "vec_id long, v array<long>, cutoff long"), "cutoffs")

    in_block = lambda n: max(1, min(n, BLOCK_BYTES // (8 * width)))
    n_row_blocks = max(1, -(-n_rows // in_block(ROW_BLOCK)))
    n_query_blocks = max(1, -(-n_asked // in_block(QUERY_BLOCK)))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    row_cells = rows.withColumn("rb", block("_n", n_row_blocks)).withColumn("qb", other(n_query_blocks))
    query_cells = told.withColumn("qb", block("vec_id", n_query_blocks)).withColumn("rb", other(n_row_blocks))
    resolved = (
        query_cells.groupBy("rb", "qb")
        .cogroup(row_cells.groupBy("rb", "qb"))
        .applyInPandas(_cell(k, width), "query_id long, vec_id long, score long")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    drop_written(asked)
    return (
        resolved.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
