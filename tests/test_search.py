"""Cuts of the splitter on fixed texts, and index searches against a loop over all pieces."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import search_index, text


def cuts(body, **more):
    return [body[a:b] for a, b in text.spans(body, **{"most": 1800, "overlap": 180, **more})]


def test_a_cut_lies_before_the_paragraph_mark():
    got = cuts("a" * 1000 + "\n\n" + "b" * 1000)
    assert got == ["a" * 1000, "a" * 180 + "\n\n" + "b" * 1000]


def test_a_mark_at_the_middle_or_before_it_is_no_cut():
    body = "a" * 900 + "\n\n" + "b" * 1200
    assert [len(c) for c in cuts(body)] == [1800, 2102 - 1620]
    body = "a" * 901 + "\n\n" + "b" * 1200
    assert [len(c) for c in cuts(body)] == [901, 2103 - 721]


def test_a_full_stop_stays_and_counts_only_without_a_paragraph():
    body = "a" * 1500 + ". " + "b" * 1000
    assert cuts(body)[0] == "a" * 1500 + "."
    body = "a" * 1000 + "\n\n" + "c" * 600 + ". " + "b" * 1000
    assert cuts(body)[0] == "a" * 1000
    body = "a" * 1799 + "\n\n" + "b" * 600  # the mark isn't whole within the first 1800
    assert len(cuts(body)[0]) == 1800


def test_overlapping_marks_and_tiny_steps():
    assert cuts("a" * 1000 + "\n\n\n" + "b" * 1000)[0] == "a" * 1000 + "\n"
    got = text.spans("x" * 1000, most=300, overlap=299)
    assert got[:3] == [(0, 300), (1, 301), (2, 302)] and got[-1] == (700, 1000)


def test_pieces_of_documents(spark):
    long = "a" * 1000 + "\n\n" + " " * 2000 + "b" * 1000
    rows = [(1, "short ", 3), (2, None, None), (3, "", None), (4, "   ", None), (5, long, None)]
    got = text.split_documents(spark.createDataFrame(rows, "doc_id long, text string, page int"), page_col="page", keep=("page",)).collect()
    found = {}
    for r in got:
        found.setdefault(r.ID, []).append((r.PARTE, r.TEXTO, r.page))
    assert found[1] == [(0, "short ", 3)] and found[3] == [(0, "", None)] and found[4] == [(0, "   ", None)] and 2 not in found
    # a piece of white space only is dropped, and places count what is kept
    assert [(n, t.strip("ab")) for n, t, _ in found[5]] == [(0, ""), (1, ""), (2, "")][: len(found[5])] and all(t == t.strip() != "" for _, t, _ in found[5])
    name = {r.ID: r.CHUNK_ID for r in got if r.PARTE == 0}
    assert name[1] == hashlib.sha256(b"1|3|0|short ").hexdigest()[:24] and name[3] == hashlib.sha256(b"3|None|0|").hexdigest()[:24]
    with pytest.raises(ValueError):
        text.split_documents(spark.createDataFrame(rows, "doc_id long, text string, page int"), most=200)


WORDS = [f"w{n}" for n in range(60)]


@pytest.fixture(scope="module")
def corpus():
    """Pieces of frequent and rare words; some hold only the most frequent."""
    rng = np.random.default_rng(8)
    share = 1 / np.arange(1, 61)
    share /= share.sum()
    pieces = [(f"p{n:03}", n // 3, ("en", "de")[n % 2], n % 5 != 0, " ".join(rng.choice(WORDS, rng.integers(3, 40), p=share))) for n in range(240)]
    pieces += [(f"q{n:03}", 90 + n, "en", True, "w0 w0 w1") for n in range(60)]
    queries = [(n, " ".join(rng.choice(WORDS, rng.integers(1, 7), p=share))) for n in range(25)] + [(98, "w0"), (99, "nothing here")]
    return pieces, queries


def plain(pieces, queries, limit, keep):
    bags = {i: Counter(re.findall("[a-z0-9]{2,}", t)) for i, *_, t in pieces}
    df = Counter(w for bag in bags.values() for w in bag)
    out = {}
    for q, t in queries:
        scores = []
        for i, _, lang, usual, _ in pieces:
            score = sum((1 + math.log(bags[i][w])) * (math.log((1 + len(pieces)) / (1 + df[w])) + 1) * n for w, n in Counter(re.findall("[a-z0-9]{2,}", t)).items() if bags[i][w])
            if score > 0 and keep(lang, usual):
                scores.append((-round(score, 6), i))
        out[q] = [i for _, i in sorted(scores)[:limit]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("first", [1, 64])
def test_bounded_search_finds_the_best(spark, corpus, tmp_path, monkeypatch, first):
    monkeypatch.setattr(search_index, "FIRST", first)
    pieces, queries = corpus
    df = spark.createDataFrame(pieces, "CHUNK_ID string, doc long, lang string, usual boolean, TEXTO string")
    index = search_index.build(df, str(tmp_path / "index"), files=3)
    asked = spark.createDataFrame(queries, "item_id long, text string")

    def found(**more):
        out = {}
        for r in sorted(search_index.search(index, asked, 5, **more).collect(), key=lambda r: (r.Q, r.POSICAO)):
            out.setdefault(r.Q, []).append(r.ID)
        return out

    assert found() == plain(pieces, queries, 5, lambda lang, usual: True)
    assert found(accepted={"lang": {"en"}}, default="usual") == plain(pieces, queries, 5, lambda lang, usual: lang == "en" and usual)
    assert found(accepted={"lang": ()}, default="usual", include_non_default=True) == plain(pieces, queries, 5, lambda lang, usual: True)
    with pytest.raises(ValueError):
        search_index.search(index, asked, 21)


def test_documents_stand_at_their_first_piece(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "c", 1)], "Q int, ID string, POSICAO int")
    pieces = spark.createDataFrame([("a", 10), ("b", 10), ("c", 20)], "ID string, doc int")
    got = sorted(map(tuple, search_index.by_document(hits, pieces, "doc").collect()))
    assert got == [(1, 10, 1), (1, 20, 2), (2, 20, 1)]


def test_measures_by_category(spark):
    measures = spark.createDataFrame([(1, 1.0, 0.5, 1.0, 0.5), (2, 0.0, 0.0, 0.0, 0.0)], "Q int, HIT double, RECALL double, MRR double, AP double")
    queries = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "Q int, kind string")
    got = {r.CATEGORIA: (r.N_CASOS, r.HIT, r.RECALL) for r in search_index.averaged(measures, queries, "kind").collect()}
    assert got == {"TODAS": (2, 0.5, 0.25), "x": (1, 1.0, 0.5), "y": (1, 0.0, 0.0)}
    assert search_index.averaged(measures, queries).filter(F.col("MRR") == 0.5).count() == 1


def by_pair(df):
    """Whether a plan groups by query and id, which takes a row of each pair."""
    return re.search(r"Aggregate \[Q#\d+L?, ID#\d+L?\]", df._jdf.queryExecution().optimizedPlan().toString()) is not None


def test_no_row_per_query_and_piece(spark, corpus, tmp_path):
    pieces, queries = corpus
    df = spark.createDataFrame(pieces, "CHUNK_ID string, doc long, lang string, usual boolean, TEXTO string")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert not by_pair(search_index.search(search_index.build(df, str(tmp_path / "index")), asked, 5))
    docs = df.select(F.col("CHUNK_ID").alias("doc_id"), F.col("TEXTO").alias("text"))
    assert by_pair(text.lexical_scores(docs, asked)) and not by_pair(text.lexical_top(docs, asked, 5))


def test_best_documents_by_words(spark, corpus):
    pieces, queries = corpus
    docs = [(int(i[1:]) + 1000 * (i[0] == "q"), t) for i, *_, t in pieces]
    df, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    found = {}
    for r in sorted(text.lexical_top(df, asked, 7).collect(), key=lambda r: (r.Q, r.POSICAO)):
        found.setdefault(r.Q, []).append(r.ID)
    assert found == plain([(i, None, None, None, t) for i, t in docs], queries, 7, lambda *_: True)


def test_terms_of_one_text(spark):
    rows = [(1, "b aa Aa ção aa cao zz"), (2, ""), (3, None), (4, "x y"), (5, "ab")]
    df = spark.createDataFrame(rows, "k int, t string").select("k", text.own_frequencies(F.col("t")).alias("e"))
    got = {r.k: {e.TERMO: e.TF for e in r.e} for r in df.collect()}
    assert got == {1: {"aa": 3, "cao": 2, "zz": 1}, 2: {}, 3: {}, 4: {}, 5: {"ab": 1}}


def test_evaluation_reads_its_tables_once(spark):
    from ledgerlight.plans import text_queries

    files = text_queries._evaluated(spark, "/root/testdata/sf0.001").inputFiles()
    assert not any("documents.parquet" in f or "embeddings" in f for f in files)
