"""SQL counterparts that have to state the query's own rule on odd rows."""

import duckdb
import pytest

from ledgerlight.operators import linalg, patterns
from ledgerlight.plans import diagnostic_queries, exploratory_queries


def test_inflation_of_dependent_flags(spark):
    """Two equal flags, a third that is correlated and one that is independent: the inverse doesn't exist, the regressions do."""
    flags = ["A", "B", "C", "D"]
    rows = [(int(n % 3 == 0), int(n % 3 == 0), int(n % 6 == 0 or n % 7 == 0), int(n % 5 == 0), "x", 2000) for n in range(600)]
    matrix = spark.createDataFrame(rows, "A int, B int, C int, D int, RECORTE string, ANO_TRANSACAO int")
    got = {r.FLAG: (r.R2, r.VIF) for r in linalg.variance_inflation(matrix, flags).collect()}
    cube = {r.REGRA_OU_FAMILIA: (r.R2_AUXILIAR, r.VIF) for r in patterns.inflation(patterns.pattern_cube(matrix, flags, "U", "RECORTE")).collect()}
    values = ", ".join(map(str, rows))
    base = f"WITH sm AS (SELECT * FROM (VALUES {values}) t(A, B, C, D, RECORTE, ANO_TRANSACAO))"
    sql = diagnostic_queries.inverse_sql(base, {"all": ("sm", flags, "RECORTE")}) + f"""
SELECT FLAG, round(1 - v, 6) AS R2, {diagnostic_queries._INFLATED} AS VIF FROM el JOIN vif USING (CUBO, CORTE, i) WHERE CORTE = ''"""
    want = {f: (r2, v) for f, r2, v in duckdb.sql(sql).fetchall()}
    assert want["A"] == want["B"] == (1.0, float("inf"))
    for found in (got, cube):
        assert found.keys() == want.keys()
        assert all(found[f] == pytest.approx(want[f], abs=1e-6) for f in flags)


def test_words_end_at_letters_beyond_ascii(spark, tmp_path):
    texts = ["dießung", "die ßung", "ßde", "de", "x-der_", "æder", "DÉ", "δde δ", "1die", "der,", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run, sql = exploratory_queries.QUERIES["TXT-08"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(sql).select("ROTA, N").fetchall()
    assert sorted((r.ROTA, r.N) for r in run(spark, str(tmp_path)).collect()) == sorted(want) == [("B", 2), ("C", 2), ("D", 7)]
