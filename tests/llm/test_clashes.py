"""Tables whose other columns have names that the operators, Spark's scans or the pipeline use themselves."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlight.llm.common import numbered, read
from ledgerlight.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from ledgerlight.llm.ngram_join import near_duplicates, one_of_each
from ledgerlight.llm.secret_scan import redact, with_spans
from ledgerlight.llm.suffix_dedup import remove_repeats

SF = "/root/testdata/sf0.001"
NAMES = ("_metadata", "_row", "_place", "_toxicity", "_file_number", "_file_name", "_file_path", "_file_row", "found", "score", "_text", "_id", "_place_of_row")
LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen "


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Documents with such columns: copies, near copies, a secret, nulls and an empty text."""
    texts = [LONG, LONG, LONG * 9 + "x", LONG * 9 + "y", "password = hunter2hunter2", None, "", "short", LONG * 9 + "y", "id iot"]
    rows = [(n, t, "en", "s", len(t or ""), *([f"{name} {n}" for name in NAMES])) for n, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)
    spark.createDataFrame(rows, kinds).repartition(3, "doc_id").write.parquet(path)
    return spark.read.parquet(path)


def test_places_are_of_files_whatever_columns_are_called(docs):
    assert numbered(docs.select("doc_id", "text"), "p").select("p").distinct().count() == 10
    assert set(numbered(docs, "p").columns) == {*docs.columns, "p"}


def test_operators(docs):
    assert {r.doc_id for r in exact_duplicates(docs).filter("NOT kept").collect()} == {0, 3, 5}
    assert sorted(drop_exact_duplicates(docs).columns) == sorted(docs.columns)
    near = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert len(near) == 10
    assert sorted(one_of_each(docs).columns) == sorted(docs.columns)
    cleaned = redact(docs).collect()
    assert len(cleaned) == 10 and any("[SECRET]" in (r.text or "") for r in cleaned) and all(r["_metadata"] == f"_metadata {r.doc_id}" for r in cleaned)
    assert with_spans(docs.select("doc_id", "text"), out_col="spans").count() == 10
    assert remove_repeats(docs).count() == 10


def test_stages_keep_every_column(spark, docs, tmp_path):
    own = docs
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, own, SF).write.parquet(str(tmp_path / str(n)))
        own = spark.read.parquet(str(tmp_path / str(n)))
        assert own.columns == docs.columns
        assert own.filter(F.col("_toxicity") != F.concat(F.lit("_toxicity "), F.col("doc_id").cast("string"))).count() == 0
        if name == "exact_dedup":
            assert {r.doc_id for r in own.collect()} <= {1, 2, 4, 6, 7, 8, 9}
    assert corpus_pipeline.STAGES[-1][1](spark, own, SF).count() == own.count()
    empty = docs.filter("false")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / f"empty-{name}")
        empty.write.parquet(path)
        assert stage(spark, spark.read.parquet(path), SF).count() == 0


def test_stages_take_nulls_and_repeated_rows(spark, tmp_path):
    given = read(spark, SF, "documents").limit(20)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "x", None, None, None), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)], given.schema)
    given.unionByName(odd).unionByName(odd).write.parquet(str(tmp_path / "in"))
    own = spark.read.parquet(str(tmp_path / "in"))
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, own, SF).write.parquet(str(tmp_path / str(n)))
        own = spark.read.parquet(str(tmp_path / str(n)))
        if name == "exact_dedup":  # of equal texts one row, null as empty; a null id is the smallest
            assert [r.doc_id for r in own.filter("text = 'x'").collect()] == [3] and own.filter("text IS NULL").count() == 1
