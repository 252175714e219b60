"""Places in files, the register of units, and the published bundle."""

from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerlight import model
from ledgerlight.plans.adapters import TEST_LIMITS, raw_lines
from ledgerlight.plans.build import build_bundle
from ledgerlight.plans.governance_queries import SETTINGS
from ledgerlight.operators import rules
from ledgerlight.sources import bundle, places, registry, sinks

SF = "/root/testdata/sf0.001"


def test_places_over_splits(spark, tmp_path):
    """Files of many splits, two of one name: places are those of the file's lines."""
    for folder, n in (("a", 3000), ("b", 7), ("a/deeper", 50)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text("".join(f"{folder} {i + 1} {'.' * (i % 90)}\n" for i in range(n)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = spark.read.text([str(tmp_path / f / "x.txt") for f in ("a", "b", "a/deeper")])
        rows = places.with_places(lines).collect()
        assert lines.rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert len(rows) == 3057 and {r.ARQUIVO_ORIGEM for r in rows} == {"x.txt"}
    assert all(int(r.value.split(" ")[1]) == r.LINHA for r in rows)


def test_places_move_no_rows(spark, tmp_path):
    """Counts by split and file are moved, not the rows."""
    (tmp_path / "x.txt").write_text("a\nb\nc\n")
    rows = places.with_places(spark.read.text(str(tmp_path / "x.txt")))
    assert sorted((r.value, r.LINHA) for r in rows.collect()) == [("a", 1), ("b", 2), ("c", 3)]
    plan = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert sum("Exchange hashpartitioning" in line for line in plan.splitlines()) <= 2
    assert "SortMergeJoin" not in plan


HEADING = '"UG","TITULO","UF","ORGAO",'
LINES = ['"133","Unidade, nova","SP","26",x', '"000134"," ","RJ","00027",', '"5","Fora, longe",anything, here,"EX","9",']


def register(tmp_path, lines):
    path = tmp_path / "register.txt"
    path.write_text("\n".join(["﻿" + HEADING, *lines]) + "\n", encoding="utf-8")
    return str(path)


def test_register(spark, tmp_path):
    units = registry.read_units(spark, register(tmp_path, LINES), "2025", expected=3)
    got = sorted(map(tuple, units.collect()))
    assert [r[:4] + (r[7],) for r in got] == [("000005", "EX", "00009", "Fora, longe", 4), ("000133", "SP", "00026", "Unidade, nova", 2), ("000134", "RJ", "00027", None, 3)]
    whole = registry.completed(units, {"000900": ("DF", "Manual")}, "2026")
    assert whole.count() == 4 and whole.filter("TIPO_FONTE_UF = 'COMPLEMENTO_MANUAL'").first().LINHA_ORIGEM_SIAFI is None
    with pytest.raises(ValueError, match="000133"):
        registry.completed(units, {"000133": ("DF", "Manual")}, "2026")


@pytest.mark.parametrize(
    "extra,match",
    [
        (["no unit here"], "1 lines can't be read: line 5: no unit here"),
        (['"133","again","SP","26",'], "line 5: unit 000133 again"),
        (['"700","t","XX","26",'], "line 5: XX"),
        (['"700","t","SP","26",'], "4 units instead of 3"),
    ],
)
def test_register_errors_name_the_line(spark, tmp_path, extra, match):
    with pytest.raises(ValueError, match=match):
        registry.read_units(spark, register(tmp_path, LINES + extra), "2025", expected=3)


def test_csv_for_spreadsheets(spark, tmp_path):
    out = tmp_path / "csv"
    sinks.write_csv(spark.createDataFrame([(1.5, "a;b")], "V double, T string").coalesce(1), str(out))
    (part,) = out.glob("*.csv")
    assert part.read_bytes().decode("utf-8") == '﻿V;T\n1,5;"a;b"\n'


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "bundle")
    with bundle.BundleWriter(spark, folder) as out:
        again = out.write("matrix_a", spark.range(10).withColumn("x", F.col("id") * 2), "matrix")
        out.write_all({f"overlap_{n}": again.filter(f"id < {n}") for n in range(3)})
    first = bundle.manifest_of(spark, folder)
    assert {t["name"]: t["rows"] for t in first["tables"]} == {"matrix_a": 10, "overlap_0": 0, "overlap_1": 1, "overlap_2": 2}
    assert first["tables"][0]["columns"] == ["id", "x"] and first["tables"][0]["bytes"] > 0
    with pytest.raises(PySparkException), bundle.BundleWriter(spark, folder) as out:
        out.write("matrix_a", spark.range(3))
        out.write("matrix_b", spark.range(3).select(F.raise_error(F.lit("broken")).alias("x")))
    assert bundle.manifest_of(spark, folder) == first and len(list((tmp_path / "bundle").glob("v-*"))) == 1
    with pytest.raises(ValueError, match="twice"), bundle.BundleWriter(spark, folder) as out:
        out.write("a", spark.range(1))
        out.write("a", spark.range(1))
    with bundle.BundleWriter(spark, folder) as out:
        out.write("matrix_a", spark.range(4))
    assert bundle.open_bundle(spark, folder, views=True)["matrix_a"].count() == 4 and spark.table("v_matrix_a").count() == 4
    bundle.prune(spark, folder, [first["version"], bundle.manifest_of(spark, folder)["version"]])
    assert len(list((tmp_path / "bundle").glob("v-*"))) == 1 and bundle.open_bundle(spark, folder)["matrix_a"].count() == 4
    with pytest.raises(FileNotFoundError):
        bundle.manifest_of(spark, str(tmp_path / "none"))


def test_checks_find_what_changed(spark, tmp_path):
    folder = tmp_path / "bundle"
    with bundle.BundleWriter(spark, str(folder)) as out:
        for name in ("good", "gone", "longer", "broken"):
            out.write(name, spark.range(5))
    (version,) = folder.glob("v-*")
    for part in (version / "gone").glob("*"):
        part.unlink()
    spark.range(2).write.mode("append").parquet(str(version / "longer"))
    for part in (version / "broken").glob("*.parquet"):
        part.write_bytes(b"no parquet")
    got = {r.NOME: r for r in bundle.check_bundle(spark, str(folder)).collect()}
    assert [n for n, r in got.items() if r.OK] == ["good"]
    assert not got["longer"].LINHAS_OK and not got["broken"].LINHAS_OK and not got["gone"].BYTES_OK


def test_text_to_bundle(spark, tmp_path):
    text, folder = str(tmp_path / "text"), str(tmp_path / "bundle")
    raw_lines(spark, SF).drop("ID_TRANSACAO").write.option("sep", ";").option("header", True).csv(text)
    manifest = build_bundle(spark, text, folder, rules.limits_table(spark, TEST_LIMITS), SETTINGS, (1993, 1997))
    assert Counter(t["kind"] for t in manifest["tables"]) == {"diagnostic": 66, "matrix": 2, "fact": 1, "flags": 1}
    tables = bundle.open_bundle(spark, folder)
    staged = tables["staging"]
    assert staged.count() == raw_lines(spark, SF).count() == staged.select("ID_TRANSACAO").distinct().count()
    years = {r.ANO for r in tables["overlap_ug_trails_by_year"].collect()}
    assert years and years <= set(range(1993, 1998))
    assert all(r.OK for r in bundle.check_bundle(spark, folder).collect())
    (tmp_path / "bad.csv").write_text(";".join(model.RAW_COLUMNS[:-1]) + "\n")
    with pytest.raises(ValueError, match="VALOR"):
        build_bundle(spark, str(tmp_path / "bad.csv"), folder)
    assert bundle.manifest_of(spark, folder)["version"] == manifest["version"]
