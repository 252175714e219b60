"""Evidence tags, context flags, strata and territorial queries on small rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlight import model
from ledgerlight.operators import geography, governance, linalg, primary, serving, text
from ledgerlight.sources import probe


def test_tags_come_first_and_keep_the_rows(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, "confirmado"), (None, 3, None), (None, 4, None)], "ID_GRUPO string, V int, STATUS_VALIDACAO string")
    out = governance.tag_evidence(rows, " t03 ")
    assert out.columns[:3] == ["ID_EVIDENCIA", "TRILHA", "FAMILIA_EVIDENCIA"] and out.columns[12:] == ["ID_GRUPO", "V"]
    got = {r["V"]: (r["ID_EVIDENCIA"], r["TRILHA"], r["FAMILIA_EVIDENCIA"], r["STATUS_VALIDACAO"]) for r in out.collect()}
    assert got == {
        1: ("a", "T03", "F2", "NAO_VALIDADO"),
        2: ("b", "T03", "F2", "CONFIRMADO"),
        3: (None, "T03", "F2", "NAO_VALIDADO"),
        4: (None, "T03", "F2", "NAO_VALIDADO"),
    }


def test_context_rules_are_outside_the_core(spark):
    out = governance.tag_evidence(spark.createDataFrame([("a",)], "ID_SINAL string"), "T08").first()
    assert (out["PAPEL_EVIDENCIA"], out["CONVERGENCIA_NUCLEO"], out["FAMILIA_EVIDENCIA"]) == ("CONTEXTO", False, "F5")


def test_bad_evidence_is_an_error(spark):
    twice = spark.createDataFrame([("a",), ("a",)], "ID_SINAL string")
    with pytest.raises(PySparkException, match="more than once"):
        governance.tag_evidence(twice, "T01").collect()
    status = spark.createDataFrame([("a", "talvez")], "ID_SINAL string, STATUS_VALIDACAO string")
    with pytest.raises(PySparkException, match="validation status"):
        governance.tag_evidence(status, "T01").collect()
    with pytest.raises(ValueError):
        governance.tag_evidence(twice, "T10")
    with pytest.raises(ValueError):
        governance.tag_evidence(spark.range(1), "T01")


def test_context_flags_join_on_their_own_keys(spark):
    matrix = spark.createDataFrame([("u", "f", 2020), ("u", "g", 2020), ("v", "f", 2020)], "UG_ID string, FAVORECIDO_ID string, ANO_TRANSACAO int")
    flags = spark.createDataFrame(
        [("T08", "u", None, 2020), ("T09", "u", "g", 2020), ("T09", "z", "g", 2020)], "TRILHA string, UG_ID string, ENTIDADE string, ANO int"
    )
    out = governance.with_context(matrix, flags, {"T08": ["UG_ID", "ANO_TRANSACAO"], "T09": governance.SUPPLIER_YEAR})
    assert sorted((r["UG_ID"], r["FAVORECIDO_ID"], r["T08"], r["T09"]) for r in out.collect()) == [("u", "f", 1, 0), ("u", "g", 1, 1), ("v", "f", 0, 0)]


def test_strata_equal_the_whole_of_each(spark):
    rng = np.random.default_rng(1)
    rows = [(("x", "y")[int(i % 2)], int(a < 0.4), int(b < 0.5), int(a + b < 0.9)) for i, (a, b) in enumerate(rng.random((600, 2)))]
    matrix = spark.createDataFrame(rows, "S string, A int, B int, C int")
    tables = linalg.by_stratum(matrix, ["A", "B", "C"], "S")
    for value in ("x", "y"):
        part = matrix.filter(f"S = '{value}'")
        for name, alone in (("vif", linalg.variance_inflation), ("condition", linalg.condition_indices), ("pca", linalg.components)):
            mine = tables[name].filter(f"RECORTE_VALOR = '{value}'").drop("RECORTE_COLUNA", "RECORTE_VALOR")
            assert mine.collect() == alone(part, ["A", "B", "C"]).collect()
    assert linalg.by_stratum(matrix.limit(0), ["A", "B"], "S")["vif"].count() == 0


def test_encoding_is_the_first_that_reads(spark, tmp_path):
    for name, data in (("a", "ação".encode()), ("b", "ação".encode("cp1252")), ("c", b"\x81\xe7")):
        (tmp_path / name).write_bytes(data)
    assert [probe.encoding_of(probe.first_bytes(spark, str(tmp_path / n))) for n in "abc"] == ["utf-8-sig", "cp1252", "latin1"]
    assert probe.encoding_of(probe.first_bytes(spark, str(tmp_path / "a"), 2)) == "cp1252"


def test_allowed_documents(spark):
    docs = spark.createDataFrame([(1, "x", True), (2, "y", False), (3, None, None), (4, "y", True)], "ID int, K string, D boolean")
    ids = lambda **a: sorted(r["ID"] for r in text.allowed(docs, default=F.col("D"), **a).collect())
    assert ids(accepted={}) == [1, 4]
    assert ids(accepted={"K": ()}, include_non_default=True) == [1, 2, 3, 4]
    assert ids(accepted={"K": {"y"}}) == [4]
    assert ids(accepted={"K": {"y"}}, include_non_default=True) == [2, 4]


def test_territory(spark):
    long = spark.createDataFrame(
        [(2020, "SP", "TRANSACAO", "M", 1.0), (2020, "AC", "TRANSACAO", "M", 1.0), (2020, "RJ", "TRANSACAO", "M", 3.0), (2021, "SP", "EXTRATO", "M", 9.0)],
        "ANO int, UF string, REFERENCIA_TEMPORAL string, METRICA string, VALOR_METRICA double",
    )
    found = serving.run_territorial("metric", long, reference="transacao", year=2020, metric="m")
    assert [r["UF"] for r in found.collect()] == ["RJ", "AC", "SP"]
    assert [r[0] for r in serving.run_territorial("years", long, reference="EXTRATO").collect()] == [2021]
    assert serving.run_territorial("catalogue", long).count() == 2
    with pytest.raises(ValueError):
        serving.run_territorial("drop", long)
    with pytest.raises(ValueError):
        geography.state_metric(long, "OUTRA", 2020, "M")
    with pytest.raises(ValueError):
        geography.units_of_state(long, long, "XX", 2020)


def test_diagnostic_tables_are_whitelisted(spark):
    tables = {"overlap_x": spark.range(5), "staged": spark.range(5)}
    assert serving.diagnostic_table(tables, "overlap_x", 3).count() == 3
    for name in ("staged", "overlap_y"):
        with pytest.raises(ValueError):
            serving.diagnostic_table(tables, name)
