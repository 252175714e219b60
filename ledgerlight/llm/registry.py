"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(read(spark, sf_dir, "documents")).drop("_row")


OP8_SQL = """
SELECT doc_id,
       max(doc_id) OVER g AS keep_id,
       count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import BASE_RULES, spans_string, with_spans

    found = with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"), out_col="found")
    base = F.filter("found", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(
            F.size(F.filter("found", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")  # noqa: B023
            for rule in BASE_RULES
        ),
        F.sha2(spans_string(base).cast("binary"), 256).alias("base_sha256"),
        spans_string(F.col("found")).alias("spans"),
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, score_texts, trained_on

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = trained_on(docs, read(spark, sf_dir, "labels"))
    return score_texts(docs, scorer).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_lm import score_documents
    from .tokenizers_path import path

    return score_documents(read(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    vectors = quantised(read(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack
    from .tokenizers_path import byte_level_with_added

    return pack(read(spark, sf_dir, "documents"), byte_level_with_added(), with_ids=False)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"), with_text=False)


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_texts
    from .tokenizers_path import path

    return encode_texts(read(spark, sf_dir, "documents"), path("piece_bpe_32k.model"), with_ids=False)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    folder, index = write_archives(read(spark, sf_dir, "pages"))
    response = F.col("record_type") == "response"
    return read_records(folder, index).select(
        "page_id",
        F.when(response, F.octet_length("payload")).otherwise(F.col("stated_bytes")).cast("long").alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("stated_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages
), g AS (
  SELECT page_id, html, n, max(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id,
       n::BIGINT AS payload_bytes,
       sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM g
"""


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents")).drop("_row", "_first_row")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants

    return spelling_variants(read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import align_texts
    from .tokenizers_path import byte_level, path

    figures, _ = align_texts(
        read(spark, sf_dir, "documents"), *byte_level(), path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
    )
    return figures


def op13_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_forest import Forest

    return Forest(read(spark, sf_dir, "embeddings"), k=20).nearest(F.col("vec_id") % 20 == 0)


def queries() -> dict:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_lattice_lm": op2_lattice_lm,
        "op3_exact_topk": op3_exact_topk,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_piece_codec": op6_piece_codec,
        "op7_warc": op7_warc,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_ngram_join": op10_ngram_join,
        "op11_spelling": op11_spelling,
        "op12_token_alignment": op12_token_alignment,
        "op13_vector_forest": op13_vector_forest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_topk": OP3_SQL, "op7_warc": OP7_SQL, "op8_exact_dedup": OP8_SQL}
