"""The pipeline's stages against plain versions, and the queries against their SQL."""

import hashlib
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from ledgerlight.llm import registry, toxicity
from ledgerlight.llm.common import read

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    pick = want.select(*(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(str, map(tuple, df.select(*columns).collect()))) == sorted(map(str, pick))


def test_stages(spark, tmp_path):
    docs, kept = read(spark, SF, "documents"), []
    names = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append((name, docs.count()))
        if name != "packing":
            assert docs.columns == names
        if name == "toxicity":
            scorer = toxicity.trained_on(before.select("doc_id", "text"), read(spark, SF, "labels"))
            scores = {r.doc_id: r.score for r in toxicity.score_texts(before, scorer).collect()}
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {i for i, s in scores.items() if s < 0.5}
        if name == "exact_dedup":
            last = defaultdict(int)
            for r in before.collect():
                last[hashlib.sha256((r.text or "").encode()).digest()] = max(last[hashlib.sha256((r.text or "").encode()).digest()], r.doc_id)
            assert {r.doc_id for r in docs.select("doc_id").collect()} == set(last.values())
        if name == "secrets":
            texts = {r.doc_id: r.text for r in before.collect()}
            changed = [r for r in docs.collect() if r.text != texts[r.doc_id]]
            assert all("[SECRET]" in r.text and r.n_chars == len(r.text) for r in changed)
            packed_from = len(texts)
    assert docs.select("doc_id").distinct().count() == packed_from
    counts = [n for _, n in kept[:3]]
    assert counts == sorted(counts, reverse=True)
