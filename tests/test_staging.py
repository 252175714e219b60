"""Traps of the text columns, on small rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlight import model
from ledgerlight.functions import exprs as x
from ledgerlight.functions import ranks
from ledgerlight.operators import benford, governance, rules, staging
from ledgerlight.sources import places, probe, raw, sinks


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "cents"),
    [("1.234,56", 123456), ("2,345", 234), ("2,355", 236), ("(R$ 10,00)", -1000), ("", None), ("abc", None), ("-5,5", -550), (None, None), ("7", 700), ("R$\u00a01,05", 105)],
)
def test_cents(spark, text, cents):
    assert one(spark, text, x.cents) == cents


@pytest.mark.parametrize(("text", "code"), [(" 133", "000133"), ("1234567", "1234567"), ("-1", None), ("", None), ("A1", "A1")])
def test_unit_code(spark, text, code):
    assert one(spark, text, x.unit_code) == code


def test_names_dates_digits(spark):
    assert one(spark, "  José   da Silva ", x.folded_name) == "JOSE DA SILVA"
    assert one(spark, "31/02/2020", x.brazilian_date) is None
    assert one(spark, "05/01/2025", x.brazilian_date) == datetime.date(2025, 1, 5)
    assert one(spark, "***.123-**", x.digits) == "123"


def test_staging_of_an_empty_and_a_secret_row(spark):
    values = ["1", "o", "2", "o", "133", "u", "2025", "01", "***123***", "SIGILOSO sigilo", "-1", "", model.NATIONAL, "", "1,00"]
    out = staging.build_staging(spark.createDataFrame([tuple(values)], model.RAW_SCHEMA)).first()
    assert out["UG_ID"] == "000133" and out["EH_SIGILOSO"] and out["PORTADOR_ID_BASELINE"] is None
    assert out["FAVORECIDO_ID"] is None and out["DATA_DT"] is None and out["COMPETENCIA_EXTRATO_REF"] == "202501"
    with pytest.raises(ValueError, match="missing"):
        staging.build_staging(spark.range(1))


def test_limits(spark):
    rows = {r["INICIO"].year: r for r in rules.limits_table(spark).collect()}
    assert rows[2025]["LIMITE_COMPRAS"] == 313628 and rows[2025]["LIMITE_ENGENHARIA"] == 627256


def test_id_text_and_percentile(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.25,), (1.0,)], "v double").withColumn("g", F.lit(1))
    got = ranks.with_average_rank(df, "v", ["g"], "p").select(x.number_text(F.col("v")), "p").collect()
    assert sorted(map(tuple, got)) == [("0.1", 0.25), ("0.25", 0.625), ("0.25", 0.625), ("1.0", 1.0)]


def test_bands_reject_zero(spark):
    with pytest.raises(Exception, match="at least 1"):
        governance.with_bands(spark.createDataFrame([(0,)], "N_COMPRAS_FORNECEDOR long")).collect()


def test_empty_instalments_give_one_row(spark):
    empty = spark.createDataFrame([], "VALOR_CENTAVOS long")
    assert [tuple(r) for r in rules.summarize_instalments(empty).collect()] == [(0, 0, 0, 0)]


def test_digit_grid(spark):
    assert benford.digit_grid(spark, 2).count() == 90


def test_sources_and_sinks(spark, tmp_path):
    header = ";".join(model.RAW_COLUMNS)
    for month in ("202501", "202502"):
        (tmp_path / f"{month}_dados.csv").write_text(header + "\n" + ";".join(["1"] * 13 + ["05/01/2025", "1,50"]) + "\n")
    files = [str(tmp_path / f"{m}_dados.csv") for m in ("202501", "202502")]
    assert raw.check_header(raw.header_of(spark, files[0]))["same_order"]
    both = probe.consolidate(spark, files)
    assert staging.build_staging(both).agg(F.sum("VALOR_CENTAVOS")).first()[0] == 300
    placed = [places.with_places(raw.read_raw(spark, f)).withColumn("COMPETENCIA_ARQUIVO", F.substring("ARQUIVO_ORIGEM", 1, 6)) for f in files]
    ids = {r[0] for df in placed for r in staging.with_transaction_ids(df).select("ID_TRANSACAO").collect()}
    assert ids == {"202501:00000001", "202502:00000001"}
    lines = spark.createDataFrame([('"133","Unidade, nova","SP","26",x',)], "value string")
    assert tuple(raw.parse_registry(lines).first()) == ("000133", "SP", "00026", "Unidade, nova")
    assert [r[0] for r in raw.months(spark, "202411", "202501").collect()] == ["202411", "202412", "202501"]
    with pytest.raises(ValueError):
        sinks.logical_name("x; drop")


def test_stream_of_landed_files(spark, tmp_path):
    from ledgerlight.streaming import ingest

    header = ";".join(model.RAW_COLUMNS)
    land = tmp_path / "land"
    land.mkdir()
    (land / "a.csv").write_text(header + "\n" + ";".join(["1"] * 12 + [model.NATIONAL, "05/01/2025", "1,50"]) + "\n")
    query = ingest.landed(spark, str(land)).select("UG_ID", "VALOR_CENTAVOS").writeStream.format("memory").queryName("landed").start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM landed").collect()] == [("000001", 150)]


def test_names_are_folded_by_compatibility_decomposition(spark):
    from unicodedata import normalize

    from ledgerlight.functions.exprs import folded_name

    names = ["KOVAČ", "josé da  silva", "Łódź", "ñandú", "Ŝukov ā", "Ａ１", None, "-1", "漢字 x", "ż́"]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(names)], "n int, t string").select("n", folded_name(F.col("t")).alias("f")).orderBy("n").collect()
    want = [normalize("NFKD", " ".join((t or "").split()).upper()).encode("ascii", "ignore").decode() for t in names]
    assert [r.f for r in got] == want and want[0] == "KOVAC"


def test_every_character_is_folded_as_its_decomposition(spark):
    """Each code point beside letters, alone and lower-cased, and some texts of several."""
    from unicodedata import normalize

    import pandas as pd

    from ledgerlight.functions.exprs import folded_name

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    decomposed = [c for c in chars if c < "\x80" or normalize("NFKD", c) != c]
    whole = set(chars).difference(decomposed)
    texts = [f"a{c}b" for c in sorted(whole)][::97] + [f"a{c}b" for c in decomposed] + [f"{c} {c}{c}" for c in decomposed]
    texts += ["½ litro nº 5 ™", "ĳ ﬁm Ⅷ", "㎏ a\u3000b\x1cc", "𝐀𝟗 🄐 🅋", "ǆ ǅ ŉ ß"]
    frame = spark.createDataFrame(pd.DataFrame({"n": range(len(texts)), "t": texts})).repartition(8)
    got = frame.select("n", folded_name(F.col("t")).alias("f")).toPandas().sort_values("n")["f"]
    want = [normalize("NFKD", " ".join(t.split()).upper()).encode("ascii", "ignore").decode() for t in texts]
    assert [(t, a, b) for t, a, b in zip(texts, got, want, strict=True) if a != b] == []
    assert list(got)[-5:] == ["12 LITRO No 5 TM", "IJ FIM VIII", "kg A B C", "A9 (A) MV", "DZ DZ N SS"]


def test_names_are_matched_with_no_class_of_characters(spark):
    """A class of hundreds of characters is tried member by member for each character of a name."""
    names = spark.createDataFrame([("José ½",), ("MARIA",), ("nº ﬁ",), (None,)], "t string").select(x.folded_name(F.col("t")).alias("f"))
    plan = names._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" not in plan.lower()
    assert [r.f for r in names.collect()] == ["JOSE 12", "MARIA", "No FI", ""]


def test_staging_makes_no_arrays_of_one_value(spark):
    """Values that an expression names several times have columns of their own."""
    out = staging.build_staging(spark.createDataFrame([], model.RAW_SCHEMA))
    assert "transform(array(" not in out._jdf.queryExecution().optimizedPlan().toString()
