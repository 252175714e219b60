"""The registered secret scan against brute force."""

import hashlib
import re

from ledgerlight.llm import registry, secret_scan


def test_registered_secret_scan_counts_each_kind(spark, tmp_path):
    """Several spans of a kind, one kind without the others, none, and a null text."""
    assign = re.compile(secret_scan.BASE_RULES[0].pattern.replace("(?i)", ""), re.I | re.A)
    texts = ["token=abcdef1 Secret: 'abcdefg' api_key=xyzxyz", "b" * 24 + " " + "c" * 30 + " " + "d" * 24, "AKIA" + "A1" * 8, "AKIA" + "Z" * 15 + " token=abc", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for row in registry.op9_secret_scan(spark, str(tmp_path)).collect():
        text = texts[row.doc_id] or ""
        found = [
            [m.span() for m in assign.finditer(text) if len(m[2]) >= 6],
            [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
            [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
        ]
        assert [row.n_assign, row.n_access, row.n_hex] == [len(f) for f in found]
        spans = sorted((a, k, b) for k, f in enumerate(found) for a, b in f)
        base = ",".join(f"{secret_scan.BASE_RULES[k].kind}:{a}:{b}" for a, k, b in spans)
        assert row.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
