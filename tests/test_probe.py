"""Layouts of files and their joint reading."""

import pytest

from ledgerlight.sources import probe


def write(path, columns, rows, sep=";", encoding="utf-8"):
    path.write_bytes("\n".join(sep.join(r) for r in [columns, *rows]).encode(encoding) + b"\n")
    return str(path)


def test_delimiters_and_encodings():
    assert [probe.delimiter_of(h) for h in ("a;b,c;d", "a,b", "a\tb\tc,d", "a;b,c")] == [";", ",", "\t", ";"]
    with pytest.raises(ValueError):
        probe.delimiter_of("abc")
    assert probe.encoding_of(b"") == "utf-8-sig" and probe.encoding_of("é".encode()) == "utf-8-sig"
    assert probe.encoding_of("é".encode()[:1]) == "cp1252" and probe.encoding_of(b"\xe9\x81") == "latin1"


def test_a_scan_per_layout(spark, tmp_path):
    """Twelve files of three layouts: three scans, columns by name, months from names, nothing lost."""
    paths = []
    for n in range(12):
        name = tmp_path / f"2024{n + 1:02}_dados.csv"
        rows = [[f"á{n}.{i}", f"b{i}"] for i in range(n + 1)]
        if n % 3 == 0:
            paths.append(write(name, ["A", "B"], rows))
        elif n % 3 == 1:
            paths.append(write(name, ["B", "A"], [r[::-1] for r in rows], "\t", "cp1252"))
        else:
            paths.append(write(name, ["﻿A"], [r[:1] for r in rows], ";", "utf-8"))
    with pytest.raises(ValueError, match="delimiter"):
        probe.layouts(spark, paths)  # a single column has no delimiter
    for n in range(2, 12, 3):
        write(tmp_path / f"2024{n + 1:02}_dados.csv", ["﻿A", "C"], [[f"á{n}.{i}", ""] for i in range(n + 1)])
    found = probe.layouts(spark, paths)
    assert {(k.encoding, k.delimiter, k.columns): len(v) for k, v in found.items()} == {
        ("UTF-8", ";", ("A", "B")): 4, ("windows-1252", "\t", ("B", "A")): 4, ("UTF-8", ";", ("A", "C")): 4,
    }
    whole = probe.consolidate(spark, paths)
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    assert {r.COMPETENCIA_ARQUIVO: r.N_LINHAS for r in probe.file_report(whole).collect()} == {f"2024{n + 1:02}": n + 1 for n in range(12)}
    got = {(r.A, r.B) for r in whole.collect()}
    assert got == {(f"á{n}.{i}", "" if n % 3 == 2 else f"b{i}") for n in range(12) for i in range(n + 1)}
    with pytest.raises(ValueError):
        probe.consolidate(spark, [])


def test_windows_characters(spark, tmp_path):
    path = write(tmp_path / "w.csv", ["Preço €", "B"], [["“5 €”", "…"]], encoding="cp1252")
    (layout,) = probe.layouts(spark, [path])
    got = probe.read_text(spark, path, layout)
    assert got.columns == list(layout.columns) == ["Preço €", "B"] and tuple(got.first()) == ("“5 €”", "…")


def test_only_the_start_is_read(spark, tmp_path):
    path = write(tmp_path / "x.csv", ["A", "B"], [["1", "2"]] * 1000)
    assert len(probe.first_bytes(spark, path, 100)) == 100
    (tmp_path / "empty").mkdir()
    assert probe.first_bytes(spark, str(tmp_path / "empty")) == b""


def test_no_character_is_cut(spark, tmp_path):
    """Wherever the first bytes end, a UTF-8 file stays one."""
    path = tmp_path / "a.csv"
    path.write_bytes("código;valor\nééé;1\nééé;2\n".encode())
    size = path.stat().st_size
    for most in range(14, size + 2):
        layout = probe.layout_of(probe.first_bytes(spark, str(path), most))
        assert (layout.encoding, layout.columns) == ("UTF-8", ("código", "valor"))
    assert len(probe.first_bytes(spark, str(path), size)) == size
