"""Document retrieval: tokens, lexical and vector scores, rank fusion, splitting, and its measures."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Collection, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.exprs import folded_lower
from ..sources import scratch

FUSION_K = 60


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters and digits, marks removed."""
    return F.regexp_extract_all(folded_lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def term_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("ID"), F.explode(tokens(F.col(text_col))).alias("TERMO")).groupBy("ID", "TERMO").agg(
        F.count(F.lit(1)).alias("TF")
    )


def own_frequencies(c: Column) -> Column:
    """(TERMO, TF) of one text's terms, as an array; the terms are sorted, and a run of equal ones is a term's number."""
    ends = lambda words: F.filter(F.sequence(F.lit(1), F.size(words)), lambda i: (i == F.size(words)) | (F.get(words, i) != F.get(words, i - 1)))
    runs = lambda words, at: F.zip_with(
        at,
        F.concat(F.array(F.lit(0)), F.slice(at, 1, F.size(at) - 1)),
        lambda b, a: F.struct(F.get(words, b - 1).alias("TERMO"), (b - a).alias("TF")),
    )
    # each step is bound by a lambda of its own, so that it's worked out once
    bound = lambda value, f: F.transform(F.array(value), f)[0]
    counted = lambda words: bound(ends(words), lambda at: runs(words, at))
    return bound(F.array_sort(tokens(c)), lambda words: F.when(F.size(words) > 0, counted(words)).otherwise(F.array().cast("array<struct<TERMO:string,TF:int>>")))


def _weighted(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, query_id: str, query_text: str) -> tuple[DataFrame, DataFrame]:
    """(ID, TERMO, TF) of the documents' terms that a query holds, and (Q, TERMO, W) with (ln((1 + N) / (1 + df)) + 1) * query tf as weight.

    Document frequencies are of the whole corpus. The first table is written, since it is read for them and for the scores.
    """
    asked = term_frequencies(queries, query_id, query_text).select(F.col("ID").alias("Q"), "TERMO", F.col("TF").alias("QTF"))
    terms = asked.select("TERMO").distinct()
    words = docs.select(F.col(id_col).alias("ID"), F.explode(tokens(F.col(text_col))).alias("TERMO"))
    found = scratch.written(words.join(terms, "TERMO", "left_semi").groupBy("ID", "TERMO").agg(F.count(F.lit(1)).alias("TF")), "found_terms")
    frequency = found.groupBy("TERMO").agg(F.count(F.lit(1)).alias("DF"))
    size = docs.agg(F.count(F.lit(1)).alias("N_DOCS"))
    idf = F.log((1 + F.col("N_DOCS")) / (1 + F.col("DF"))) + 1
    return found, asked.join(frequency, "TERMO").crossJoin(F.broadcast(size)).select("Q", "TERMO", (idf * F.col("QTF")).alias("W"))


def lexical_scores(docs: DataFrame, queries: DataFrame, id_col="doc_id", text_col="text", query_id="item_id", query_text="text") -> DataFrame:
    """(Q, ID, SCORE): (1 + ln tf) * (ln((1 + N) / (1 + df)) + 1) * query tf, over matching terms. A row per query and matching document; ``lexical_top`` makes none.

    Only terms that a query holds are counted; document frequencies are of the whole corpus.
    """
    found, weighted = _weighted(docs, queries, id_col, text_col, query_id, query_text)
    score = F.sum((1 + F.log(F.col("TF").cast("double"))) * F.col("W"))
    return found.join(weighted, "TERMO").groupBy("Q", "ID").agg(score.alias("SCORE")).filter("SCORE > 0")


def lexical_top(docs: DataFrame, queries: DataFrame, limit: int, id_col="doc_id", text_col="text", query_id="item_id", query_text="text") -> DataFrame:
    """(Q, ID, SCORE, POSICAO): the best ``limit`` by the scores of ``lexical_scores``, rounded to six places so that sums of any order rank alike."""
    found, weighted = _weighted(docs, queries, id_col, text_col, query_id, query_text)
    return best_by_terms(found, weighted, limit, docs.count(), queries.count())


def best_by_terms(found: DataFrame, asked: DataFrame, limit: int, n: int, n_asked: int, block: int = 4096, asked_block: int = 4096) -> DataFrame:
    """(Q, ID, SCORE, POSICAO): the best ``limit`` per query by the sum of (1 + ln tf) * W over shared terms, rounded to six places; ties to the smaller id.

    ``found``: a row (ID, TERMO, TF) per id and term, of ``n`` ids at most; ``asked``: a row (Q, TERMO, W) per query and term, of ``n_asked`` queries at most.
    Ids and queries are dealt to blocks, and a cell of two blocks passes on its own best per query, so that no row is made per query and id.
    """
    kinds = {c: df.schema[c].dataType for df, c in ((asked, "Q"), (found, "ID"))}
    number = isinstance(kinds["ID"], IntegralType)
    n_rows, n_queries = max(1, -(-n // block)), max(1, -(-n_asked // asked_block))
    own = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = asked.select(F.col("Q").cast("string").alias("Q"), "TERMO", "W", own("Q", n_queries).alias("QB"), every(n_rows).alias("RB"))
    terms = asked.select("TERMO").distinct()
    met = found.join(F.broadcast(terms) if n_queries == 1 else terms, "TERMO", "left_semi")  # one block's terms are few
    right = met.select(F.col("ID").cast("string").alias("ID"), "TERMO", "TF", own("ID", n_rows).alias("B"), every(n_queries).alias("A"))

    def order(name: str | None) -> tuple:
        return (name is not None, 0 if name is None else int(name) if number else name)

    def cell(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(r):
            ids = np.array(sorted(set(r["ID"]), key=order), dtype=object)
            code, terms = pd.factorize(r["TERMO"])
            by_term = np.argsort(code, kind="stable")
            at = np.array(r["ID"].map({name: k for k, name in enumerate(ids)}), dtype=int)[by_term]
            share = (1 + np.log(r["TF"].to_numpy(dtype=float)))[by_term]
            end = np.cumsum(np.bincount(code))
            places = {t: slice(a, b) for t, a, b in zip(terms, end - np.bincount(code), end, strict=True)}
            for name, asks in q.groupby("Q", dropna=False, sort=False):
                score = np.zeros(len(ids))
                for term, weight in zip(asks["TERMO"], asks["W"], strict=True):
                    if (s := places.get(term)) is not None:
                        score[at[s]] += share[s] * weight
                score = np.floor(score * 1e6 + 0.5) / 1e6
                least = np.partition(score, -limit)[-limit] if len(ids) > limit else 0
                among = np.flatnonzero((score >= least) & (score > 0))
                best = among[np.argsort(-score[among], kind="stable")[:limit]]
                out += [(None if pd.isna(name) else name, ids[k], score[k]) for k in best]
        q_names, id_names, scores = zip(*out, strict=True) if out else ((), (), ())
        return pd.DataFrame({"Q": pd.Series(q_names, dtype=object), "ID": pd.Series(id_names, dtype=object), "SCORE": pd.Series(scores, dtype=float)})

    cells = left.groupBy("QB", "RB").cogroup(right.groupBy("A", "B")).applyInPandas(cell, "Q string, ID string, SCORE double")
    return top(cells.select(*(F.col(c).cast(kind).alias(c) for c, kind in kinds.items()), "SCORE"), limit)


def allowed(docs: DataFrame, accepted: Mapping[str, Collection[str]], default: Column | None = None, include_non_default: bool = False) -> DataFrame:
    """Documents that retrieval may use: those of the accepted values in each column, and by default only default ones.

    No values for a column means no filter on it; a null value is in no set, and a null default counts as false.
    """
    for column, values in accepted.items():
        if values:
            docs = docs.filter(F.col(column).cast("string").isin(sorted(values)))
    return docs if include_non_default or default is None else docs.filter(F.coalesce(default, F.lit(False)))


def vector_top(
    vectors: DataFrame, queries: DataFrame, limit: int, id_col="vec_id", vector_col="embedding", block: int = 4096
) -> DataFrame:
    """(Q, ID, SCORE, POSICAO): the best positive cosines per query, ties to the smaller id.

    Queries and rows meet in cells of bounded blocks, each of which passes on its own best
    ``limit`` per query. Vectors are of one length; null vectors and those of norm 0 take no part.
    """
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()
    pick = lambda df: df.filter(usable).select(F.col(id_col).cast("long").alias("ID"), F.col(vector_col).alias("V"))
    rows, asked = pick(vectors), pick(queries)
    n_rows, n_asked = (max(1, -(-df.count() // block)) for df in (rows, asked))
    own = lambda n: F.pmod(F.xxhash64("ID"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(F.col("ID").alias("Q"), F.col("V").alias("QV"), own(n_asked).alias("QB"), every(n_rows).alias("RB"))
    right = rows.select("ID", "V", own(n_rows).alias("B"), every(n_asked).alias("A"))

    def unit(v: pd.Series) -> np.ndarray:
        m = np.array([np.asarray(x, dtype=float) for x in v])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.full_like(m, np.nan), where=norm > 0)

    def cell(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(r):
            r = r.sort_values("ID", ignore_index=True)
            score = unit(q["QV"]) @ unit(r["V"]).T
            for name, own_scores in zip(q["Q"], score, strict=True):
                best = np.argsort(-own_scores, kind="stable")[:limit]
                best = best[own_scores[best] > 0]
                found.append(pd.DataFrame({"Q": name, "ID": r["ID"].to_numpy()[best], "SCORE": own_scores[best]}))
        return pd.concat(found) if found else pd.DataFrame({"Q": [], "ID": [], "SCORE": []})

    cells = left.groupBy("QB", "RB").cogroup(right.groupBy("A", "B"))
    return top(cells.applyInPandas(cell, "Q long, ID long, SCORE double"), limit)


def top(scores: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` per query; ties to the smaller id."""
    order = Window.partitionBy("Q").orderBy(F.desc("SCORE"), "ID")
    return scores.withColumn("POSICAO", F.row_number().over(order)).filter(F.col("POSICAO") <= limit)


def candidates(limit: int) -> int:
    """How many places of each ranking a fusion of so many results looks at."""
    if not 1 <= limit <= 20:
        raise ValueError("limit must be between 1 and 20")
    return min(20, 4 * limit)


def fused(rankings: list[DataFrame], limit: int, k: int = FUSION_K) -> DataFrame:
    """Reciprocal rank fusion of several (Q, ID, POSICAO)."""
    every = rankings[0].select("Q", "ID", "POSICAO")
    for r in rankings[1:]:
        every = every.unionByName(r.select("Q", "ID", "POSICAO"))
    return top(every.groupBy("Q", "ID").agg(F.sum(1.0 / (k + F.col("POSICAO"))).alias("SCORE")), limit)


def label_measures(ranking: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """hit, recall, reciprocal rank and average precision at k, where all rows of the query's label are right.

    ``labels``: (ID, LABEL). How many are right is counted per label, so that no pair of a query and a row is formed.
    """
    sizes = labels.groupBy("LABEL").agg(F.count(F.lit(1)).alias("N_GOLD"))
    of_query = labels.select(F.col("ID").alias("Q"), F.col("LABEL").alias("_LABEL"))
    asked = ranking.select("Q").distinct().join(of_query, "Q").join(sizes, F.col("_LABEL") == F.col("LABEL")).select("Q", "_LABEL", "N_GOLD")
    hits = ranking.filter(F.col("POSICAO") <= k).join(labels, "ID").join(asked, "Q").filter("LABEL = _LABEL")
    counted = hits.withColumn("_K", F.row_number().over(Window.partitionBy("Q").orderBy("POSICAO"))).groupBy("Q").agg(
        F.count(F.lit(1)).alias("_N"), F.min("POSICAO").alias("_FIRST"), F.sum(F.col("_K") / F.col("POSICAO")).alias("_SUM")
    )
    none = lambda c: F.coalesce(c, F.lit(0.0))
    return asked.join(counted, "Q", "left").select(
        "Q",
        F.when(F.col("_N") > 0, 1.0).otherwise(0.0).alias("HIT"),
        none(F.col("_N") / F.col("N_GOLD")).alias("RECALL"),
        none(1.0 / F.col("_FIRST")).alias("MRR"),
        none(F.col("_SUM") / F.least(F.col("N_GOLD"), F.lit(k))).alias("AP"),
    )


def retrieval_measures(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """hit, recall, reciprocal rank and average precision at k per query. ``gold``: (Q, ID)."""
    sizes = gold.groupBy("Q").agg(F.count(F.lit(1)).alias("N_GOLD"))
    hits = ranking.filter(F.col("POSICAO") <= k).join(gold, ["Q", "ID"])
    numbered = hits.withColumn("N_HIT", F.row_number().over(Window.partitionBy("Q").orderBy("POSICAO")))
    found = numbered.groupBy("Q").agg(
        F.count(F.lit(1)).alias("HITS"), F.min("POSICAO").alias("PRIMEIRO"), F.sum(F.col("N_HIT") / F.col("POSICAO")).alias("_AP")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return sizes.join(found, "Q", "left").select(
        "Q",
        F.when(F.col("HITS") > 0, 1.0).otherwise(0.0).alias("HIT"),
        zero(F.col("HITS") / F.col("N_GOLD")).alias("RECALL"),
        zero(1.0 / F.col("PRIMEIRO")).alias("MRR"),
        zero(F.col("_AP") / F.least(F.col("N_GOLD"), F.lit(k))).alias("AP"),
    )


def _last_between(places: list[int], low: int, high: int) -> int | None:
    """The greatest of the sorted places above ``low`` and up to ``high``."""
    at = bisect_right(places, high) - 1
    return places[at] if at >= 0 and places[at] > low else None


def spans(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text.

    A piece that isn't the last ends before the last paragraph mark in its further half, else behind the last full stop there, else after ``most`` characters.
    The next one starts ``overlap`` characters before that end.
    """
    if len(text) <= most:
        return [(0, len(text))]
    paragraphs, stops = ([m.start() for m in re.finditer(mark, text)] for mark in ("(?=\n\n)", r"\. "))
    out, start = [], 0
    while start + most < len(text):
        middle, last = start + most // 2, start + most - 2  # both marks have two characters
        cut = _last_between(paragraphs, middle, last)
        if cut is None and (stop := _last_between(stops, middle, last)) is not None:
            cut = stop + 1
        end = start + most if cut is None else cut
        out.append((start, end))
        start = max(end - overlap, start + 1)
    return [*out, (start, len(text))]


def split_documents(
    docs: DataFrame, id_col="doc_id", text_col="text", most: int = 1800, overlap: int = 180, page_col: str | None = None, keep: Collection[str] = ()
) -> DataFrame:
    """(ID, PARTE, CHUNK_ID, TEXTO, and the columns to keep): overlapping pieces that end at paragraphs or sentences where they can.

    A text of up to ``most`` characters is one piece as it is; pieces of longer ones are stripped, and those of white space dropped.
    A null text has none. The id is of document, page, place and text.
    """
    if most < 300:
        raise ValueError("most must be at least 300")
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and below most")

    def pieces(text: str | None) -> list[str]:
        if text is None or len(text) <= most:
            return [] if text is None else [text]
        return [piece for a, b in spans(text, most, overlap) if (piece := text[a:b].strip())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cut = [list(enumerate(pieces(t))) for t in batch["TEXTO"]]
            row = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
            out = pd.DataFrame({c: batch[c].to_numpy(dtype=object)[row] for c in ("ID", "_PAGE", *keep)})
            flat = [p for c in cut for p in c]
            names = [
                hashlib.sha256(f"{key}|{None if page is None or page != page else int(page)}|{n}|{piece}".encode()).hexdigest()[:24]
                for key, page, (n, piece) in zip(out["ID"], out["_PAGE"], flat, strict=True)
            ]
            yield out.assign(PARTE=[n for n, _ in flat], CHUNK_ID=np.array(names, dtype=object), TEXTO=np.array([p for _, p in flat], dtype=object))[["ID", "PARTE", "CHUNK_ID", "TEXTO", *keep]]

    given = docs.select(
        F.col(id_col).alias("ID"), F.col(text_col).alias("TEXTO"), (F.lit(None) if page_col is None else F.col(page_col)).cast("int").alias("_PAGE"), *keep
    )
    kinds = {f.name: f.dataType.simpleString() for f in given.schema.fields}
    more = "".join(f", `{c}` {kinds[c]}" for c in keep)
    return given.mapInPandas(run, f"ID {kinds['ID']}, PARTE int, CHUNK_ID string, TEXTO string{more}")


def host(url: Column) -> Column:
    """Host of a URL, lower-case; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
