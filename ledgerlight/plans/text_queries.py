"""Retrieval over documents and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search_index, text, web
from ..sources import scratch
from .adapters import _table
from .rule_queries import r


def _vector_top(spark, d):
    v = _table(spark, d, "embeddings").select("vec_id", "embedding")
    return text.vector_top(v, v.filter("vec_id % 50 = 0"), 10)


def _lexical(spark, d, limit=10):
    return text.lexical_top(_table(spark, d, "documents"), _table(spark, d, "benchmark"), limit)


def _fused(spark, d, limit=5):
    """Fusion of a ranking by weighted terms and one by vectors over the same ids; the vector of a query is the row of its number."""
    most = text.candidates(limit)
    v, asked = _table(spark, d, "embeddings").select("vec_id", "embedding"), _table(spark, d, "benchmark")
    own = v.join(asked.select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return text.fused([_lexical(spark, d, most), text.vector_top(v, own, most)], limit)


def _measures(spark, d):
    labels = _table(spark, d, "embeddings").select(F.col("vec_id").alias("ID"), F.col("label").alias("LABEL"))
    return text.label_measures(_vector_top(spark, d), labels, 10)


_FOLD = "lower(strip_accents(coalesce({}, '')))"
TERMS_SQL = f"""WITH w AS (SELECT doc_id AS ID, unnest(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]{{2,}}')) AS TERMO FROM documents),
tf AS (SELECT ID, TERMO, count(*) AS TF FROM w GROUP BY ALL)"""
LEXICAL_SQL = f"""{TERMS_SQL}, qw AS (SELECT item_id AS Q, unnest(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]{{2,}}')) AS TERMO FROM benchmark),
qt AS (SELECT Q, TERMO, count(*) AS QTF FROM qw GROUP BY ALL), df AS (SELECT TERMO, count(*) AS DF FROM tf GROUP BY ALL),
ls AS (SELECT Q, ID, round(sum((1 + ln(TF)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + DF)::DOUBLE) + 1) * QTF), 6) AS SCORE
  FROM qt JOIN df USING (TERMO) JOIN tf USING (TERMO) GROUP BY ALL HAVING SCORE > 0),
lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Q ORDER BY SCORE DESC, ID)::INT AS POSICAO FROM ls) WHERE POSICAO <= 10)"""
VECTOR_SQL = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), s AS (
  SELECT q.vec_id AS Q, v.vec_id AS ID, list_cosine_similarity(q.e, v.e) AS SCORE FROM v CROSS JOIN (SELECT * FROM v WHERE vec_id % 50 = 0) q),
tv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Q ORDER BY SCORE DESC, ID)::INT AS POSICAO FROM s WHERE SCORE > 0) WHERE POSICAO <= 10)"""
_CANDIDATES = text.candidates(5)
FUSED_SQL = f"""{LEXICAL_SQL.replace("POSICAO <= 10", f"POSICAO <= {_CANDIDATES}")}, v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
vs AS (SELECT q.vec_id AS Q, v.vec_id AS ID, list_cosine_similarity(q.e, v.e) AS SCORE FROM v CROSS JOIN (SELECT * FROM v WHERE vec_id IN (SELECT item_id FROM benchmark)) q),
vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY Q ORDER BY SCORE DESC, ID)::INT AS POSICAO FROM vs WHERE SCORE > 0) WHERE POSICAO <= {_CANDIDATES}),
f AS (SELECT Q, ID, sum(1.0::DOUBLE / (60 + POSICAO)) AS SCORE FROM (SELECT Q, ID, POSICAO FROM lt UNION ALL SELECT Q, ID, POSICAO FROM vt) GROUP BY ALL)
SELECT Q, ID, round(SCORE, 8) AS SCORE FROM (SELECT *, row_number() OVER (PARTITION BY Q ORDER BY SCORE DESC, ID) AS rn FROM f) WHERE rn <= 5"""
MEASURES_SQL = f"""{VECTOR_SQL}, n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY ALL),
asked AS (SELECT DISTINCT Q, v.label, n FROM tv JOIN v ON v.vec_id = Q JOIN n USING (label)),
h AS (SELECT tv.Q, POSICAO, row_number() OVER (PARTITION BY tv.Q ORDER BY POSICAO) AS k FROM tv JOIN v ON v.vec_id = tv.ID JOIN asked ON asked.Q = tv.Q AND asked.label = v.label),
a AS (SELECT Q, count(*) AS c, min(POSICAO) AS p, sum(k / POSICAO::DOUBLE) AS ap FROM h GROUP BY ALL)
SELECT Q, (CASE WHEN c > 0 THEN 1 ELSE 0 END)::DOUBLE AS HIT, round(coalesce(c / n::DOUBLE, 0), 6) AS RECALL, round(coalesce(1 / p::DOUBLE, 0), 6) AS MRR,
  round(coalesce(ap / least(n, 10), 0), 6) AS AP FROM asked LEFT JOIN a USING (Q)"""

#: Python's white space, which pieces are stripped of.
_SPACE = "' ' || " + " || ".join(f"chr({n})" for n in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288))
#: Pieces of documents: a recursion over starts, marks found from the end by reversing the window.
CHUNKS_SQL = f"""WITH RECURSIVE cut AS (
  SELECT doc_id, lang, source, text, 0 AS a, NULL::INT AS b, -1 AS step FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, lang, source, text, CASE WHEN step < 0 THEN 0 ELSE greatest(b - 180, a + 1) END AS s,
    CASE WHEN s + 1800 >= length(text) THEN length(text) WHEN p > 900 THEN s + p WHEN q > 900 THEN s + q + 1 ELSE s + 1800 END, step + 1
  FROM (SELECT *, CASE WHEN step < 0 THEN 0 ELSE greatest(b - 180, a + 1) END AS s0, reverse(substr(text, s0 + 1, 1800)) AS w,
      CASE WHEN strpos(w, chr(10) || chr(10)) = 0 THEN -1 ELSE length(w) - strpos(w, chr(10) || chr(10)) - 1 END AS p,
      CASE WHEN strpos(w, ' .') = 0 THEN -1 ELSE length(w) - strpos(w, ' .') - 1 END AS q FROM cut)
  WHERE step < 0 OR b < length(text)
), piece AS (SELECT doc_id, lang, source, step, CASE WHEN length(text) <= 1800 THEN text ELSE trim(substr(text, a + 1, b - a), {_SPACE}) END AS TEXTO, length(text) <= 1800 AS whole FROM cut WHERE step >= 0
), chunk AS (SELECT doc_id AS ID, (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1)::INT AS PARTE, lang, source, TEXTO,
    sha256(doc_id || '|None|' || (row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1) || '|' || TEXTO)[:24] AS CHUNK_ID FROM piece WHERE whole OR TEXTO <> '')"""


def _chunks(spark, d):
    docs = _table(spark, d, "documents").withColumn("padrao", F.length("text") >= 200)
    return text.split_documents(docs, keep=("lang", "source", "padrao"))


_INDEXES: dict = {}


def _index(spark, d):
    """The chunks' index, built once per session and state of the documents' file."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
    key = spark.sparkContext.applicationId, d, status.getModificationTime(), status.getLen()
    if key not in _INDEXES:
        folder = scratch.new_folder(spark, "index")
        search_index.build(_chunks(spark, d).withColumnRenamed("ID", "doc_id"), folder)
        _INDEXES[key] = folder
    return search_index.load(spark, _INDEXES[key])


def _search(spark, d, limit=5):
    """English chunks of documents that retrieval may use by default."""
    return search_index.search(_index(spark, d), _table(spark, d, "benchmark"), limit, accepted={"lang": {"en"}}, default="padrao")


#: Words that a document must have in the order of a benchmark item's to count as its source.
SHARED = 8


def _gold(spark, d):
    """(Q, ID): documents that share eight words in a row with an item; both sides are shingled and joined by shingle."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    runs = lambda df, key, name: (
        df.select(F.col(key).alias(name), words(F.col("text")).alias("w"))
        .filter(F.size("w") >= SHARED)
        .select(name, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - SHARED + 1), lambda i: F.array_join(F.slice("w", i, SHARED), " "))).alias("s"))
    )
    return runs(_table(spark, d, "benchmark"), "item_id", "Q").join(runs(_table(spark, d, "documents"), "doc_id", "ID"), "s").select("Q", "ID").distinct()


def _categories(spark, d):
    length = F.length("text")
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("Q"), F.when(length < 200, "CURTA").when(length < 300, "MEDIA").otherwise("LONGA").alias("CATEGORIA"))


def _evaluated(spark, d):
    index = _index(spark, d)
    documents = search_index.by_document(_search(spark, d, 20), index.pieces, "doc_id")
    gold = scratch.written(_gold(spark, d), "gold")  # both tables are read several times below
    measures = scratch.written(text.retrieval_measures(documents, gold, 5), "measures")
    return r(search_index.averaged(measures, _categories(spark, d), "CATEGORIA"), "HIT", "RECALL", "MRR", "AP")


INDEX_SQL = f"""{CHUNKS_SQL}, w AS (SELECT CHUNK_ID AS ID, unnest(regexp_extract_all({_FOLD.format('TEXTO')}, '[a-z0-9]{{2,}}')) AS TERMO FROM chunk),
tf AS (SELECT ID, TERMO, count(*) AS TF FROM w GROUP BY ALL), df AS (SELECT TERMO, count(*) AS DF FROM tf GROUP BY ALL),
qw AS (SELECT item_id AS Q, unnest(regexp_extract_all({_FOLD.format('text')}, '[a-z0-9]{{2,}}')) AS TERMO FROM benchmark), qt AS (SELECT Q, TERMO, count(*) AS QTF FROM qw GROUP BY ALL),
ok AS (SELECT CHUNK_ID AS ID, chunk.ID AS DOC FROM chunk JOIN documents ON doc_id = chunk.ID WHERE chunk.lang = 'en' AND length(text) >= 200),
ls AS (SELECT Q, ID, DOC, round(sum((1 + ln(TF)) * (ln((1 + (SELECT count(*) FROM chunk)) / (1 + DF)::DOUBLE) + 1) * QTF), 6) AS SCORE
  FROM qt JOIN df USING (TERMO) JOIN tf USING (TERMO) JOIN ok USING (ID) GROUP BY ALL HAVING SCORE > 0),
lt AS (SELECT *, row_number() OVER (PARTITION BY Q ORDER BY SCORE DESC, ID)::INT AS POSICAO FROM ls)"""


def _shingles_sql(table, key, name) -> str:
    return f"""SELECT DISTINCT {name}, list_aggregate(ws[i:i + {SHARED - 1}], 'string_agg', ' ') AS s FROM (SELECT {name}, ws, unnest(range(1, len(ws) - {SHARED - 2})) AS i
  FROM (SELECT {key} AS {name}, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM {table}) WHERE len(ws) >= {SHARED})"""


EVALUATED_SQL = f"""{INDEX_SQL}, gd AS (SELECT DISTINCT Q, ID FROM ({_shingles_sql("benchmark", "item_id", "Q")}) JOIN ({_shingles_sql("documents", "doc_id", "ID")}) USING (s)),
dr AS (SELECT Q, DOC AS ID, row_number() OVER (PARTITION BY Q ORDER BY min(POSICAO)) AS POSICAO FROM lt WHERE POSICAO <= 20 GROUP BY Q, DOC),
h AS (SELECT Q, POSICAO, row_number() OVER (PARTITION BY Q ORDER BY POSICAO) AS k FROM dr JOIN gd USING (Q, ID) WHERE POSICAO <= 5),
m AS (SELECT Q, n, count(POSICAO) AS c, min(POSICAO) AS f, sum(k / POSICAO::DOUBLE) AS ap FROM (SELECT Q, count(*) AS n FROM gd GROUP BY Q) LEFT JOIN h USING (Q) GROUP BY Q, n),
v AS (SELECT Q, (CASE WHEN c > 0 THEN 1 ELSE 0 END)::DOUBLE AS HIT, c / n::DOUBLE AS RECALL, coalesce(1 / f::DOUBLE, 0) AS MRR, coalesce(ap / least(n, 5), 0) AS AP,
  CASE WHEN length(text) < 200 THEN 'CURTA' WHEN length(text) < 300 THEN 'MEDIA' ELSE 'LONGA' END AS CATEGORIA FROM m JOIN benchmark ON item_id = Q)
SELECT CATEGORIA, count(*) AS N_CASOS, round(avg(HIT), 6) AS HIT, round(avg(RECALL), 6) AS RECALL, round(avg(MRR), 6) AS MRR, round(avg(AP), 6) AS AP
FROM (SELECT 'TODAS' AS CATEGORIA, * EXCLUDE (CATEGORIA) FROM v UNION ALL BY NAME SELECT * FROM v) GROUP BY CATEGORIA"""


def _evidence(spark, d):
    """Up to ten pages for each of five needs, dated by their number: none older than a cutoff, official hosts first."""
    number = F.col("page_id")
    pages = _table(spark, d, "pages").withColumns(
        {"need": (number % 5).cast("int"), "at": F.when(number % 7 != 0, F.timestamp_seconds(number % 100 * 86_400)), "rank": number}
    )
    found = web.evidence(pages, {"example.org"}, 10, "need", published="at", cutoff=F.timestamp_seconds(F.lit(20 * 86_400)), schemes=("http", "https"))
    return found.select("need", "POSICAO", "URL", "HOST", "OFICIAL", "RANK", F.unix_seconds("PUBLICADO").alias("PUBLICADO"))


_URL_SQL = "^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:@]+)(?::([0-9]*))?(/[^?#]*)?(\\?[^#]*)?"
EVIDENCE_SQL = f"""WITH p AS (SELECT page_id, page_id % 5 AS need, CASE WHEN page_id % 7 <> 0 THEN page_id % 100 * 86400 END AS dated, lower(regexp_extract(url, '{_URL_SQL}', 1)) AS s,
  lower(regexp_extract(url, '{_URL_SQL}', 2)) AS h, regexp_extract(url, '{_URL_SQL}', 3) AS pt, regexp_extract(url, '{_URL_SQL}', 4) AS pa, regexp_extract(url, '{_URL_SQL}', 5) AS qu FROM pages),
c AS (SELECT *, s || '://' || h || CASE WHEN pt = '' OR (s = 'http' AND pt = '80') OR (s = 'https' AND pt = '443') THEN '' ELSE ':' || pt END || CASE WHEN pa = '' THEN '/' ELSE pa END || qu AS URL,
  h = 'example.org' OR h LIKE '%.example.org' AS o FROM p WHERE s IN ('http', 'https') AND dated >= 20 * 86400),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY need, URL ORDER BY dated DESC, page_id) AS rn FROM c) WHERE rn = 1),
e AS (SELECT *, row_number() OVER (PARTITION BY need ORDER BY o DESC, page_id, h, URL) AS k FROM n)
SELECT need::INT AS need, k::INT AS POSICAO, URL, h AS HOST, o AS OFICIAL, page_id AS RANK, dated::BIGINT AS PUBLICADO FROM e WHERE k <= 10"""


def _allowed(spark, d):
    """English documents of any source; those of 200 characters or more are the default."""
    docs = _table(spark, d, "documents")
    return text.allowed(docs, {"lang": {"en"}, "source": ()}, F.length("text") >= 200).select("doc_id", "source")


QUERIES = {
    "FLT-09": (_allowed, "SELECT doc_id, source FROM documents WHERE lang = 'en' AND length(text) >= 200"),
    "TXT-01": (
        lambda s, d: text.term_frequencies(_table(s, d, "documents"), "doc_id", "text").groupBy("ID").agg(F.count(F.lit(1)).alias("N_TERMOS"), F.sum("TF").alias("N")),
        f"{TERMS_SQL} SELECT ID, count(*) AS N_TERMOS, sum(TF)::BIGINT AS N FROM tf GROUP BY ALL",
    ),
    "TXT-02": (_lexical, f"{LEXICAL_SQL} SELECT Q, ID, SCORE, POSICAO FROM lt"),
    "TXT-03": (lambda s, d: r(_vector_top(s, d), "SCORE"), f"{VECTOR_SQL} SELECT Q, ID, round(SCORE, 6) AS SCORE, POSICAO FROM tv"),
    "TXT-04": (lambda s, d: r(_fused(s, d), "SCORE", places=8).drop("POSICAO"), FUSED_SQL),
    "TXT-05": (lambda s, d: text.split_documents(_table(s, d, "documents")), f"{CHUNKS_SQL} SELECT ID, PARTE, CHUNK_ID, TEXTO FROM chunk"),
    "SRT-05": (_search, f"{INDEX_SQL} SELECT Q, ID, SCORE, POSICAO FROM lt WHERE POSICAO <= 5"),
    "EVL-01b": (_evaluated, EVALUATED_SQL),
    "TXT-12": (
        lambda s, d: _table(s, d, "pages").groupBy(text.host(F.col("url")).alias("HOST")).agg(F.count(F.lit(1)).alias("N")),
        "SELECT nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '') AS HOST, count(*) AS N FROM pages GROUP BY ALL",
    ),
    "TXT-12b": (_evidence, EVIDENCE_SQL),
    "EVL-01": (lambda s, d: r(_measures(s, d), "RECALL", "MRR", "AP"), MEASURES_SQL),
}
