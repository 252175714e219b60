"""Canonical addresses against the standard library's resolution, and the choice of evidence."""

from datetime import datetime
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import web

URLS = [
    "HTTPS://WWW.Example.ORG:443/a/./b/../c/?q=1#x", "http://example.com:80", "http://example.com:8080/a//b", "https://example.com./x/..", "https://example.com/../../y/.",
    "https://user:pw@example.com/a", "https://[2001:db8::1]/a", "https://example.com?q=/../", "ftp://Example.com/%7Ea/..%2f", " https://a.b/c ", "https://a.b/./", "https://a.b/x/../../..//z",
]


def plain(url):
    parts = urlsplit(url.strip())
    host = parts.hostname.rstrip(".").lower()
    host = f"[{host}]" if ":" in host else host
    port = "" if parts.port in (None, {"https": 443, "http": 80}.get(parts.scheme)) else f":{parts.port}"
    path = urlsplit(urljoin("http://x/", "http://x" + (parts.path or "/"))).path or "/"
    out = []
    for n, segment in enumerate(segments := (parts.path or "/")[1:].split("/")):
        if segment in (".", ".."):
            out = out[:-1] if segment == ".." else out
            out += [""] if n == len(segments) - 1 else []
        else:
            out.append(segment)
    path = "/" + "/".join(out)
    return f"{parts.scheme}://{host}{port}{path}" + (f"?{parts.query}" if parts.query else "")


def test_canonical(spark):
    df = spark.createDataFrame([(u,) for u in [*URLS, "nothing", "https://", None, "//a.b/c"]], "u string")
    got = {r.u: r.c for r in df.select("u", web.canonical(F.col("u")).alias("c")).collect()}
    for url in URLS:
        assert got[url] == plain(url), url
    assert got["nothing"] is got["https://"] is got[None] is got["//a.b/c"] is None
    assert got["https://example.com/../../y/."] == "https://example.com/y/" and got["https://example.com./x/.."] == "https://example.com/"
    again = spark.createDataFrame([(c,) for c in got.values() if c], "u string")
    assert again.filter(web.canonical(F.col("u")) != F.col("u")).count() == 0


@pytest.mark.parametrize(
    "url,host",
    [
        ("https://Gov.Example/x", "gov.example"), ("http://gov.example", None), ("https://u@gov.example", None), ("https://localhost/a", None), ("https://a.local", None),
        ("https://10.0.0.1/", None), ("https://172.20.1.1/", None), ("https://172.40.1.1/", "172.40.1.1"), ("https://[::1]/", None), ("https://8.8.8.8/", "8.8.8.8"), ("https://notlocalhost/", "notlocalhost"),
    ],
)
def test_hosts(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(web.usable_host(F.col("u"))).first()[0] == host


def test_evidence(spark):
    day = lambda n: datetime(2026, 1, n)
    rows = [
        (1, "https://a.example/x#1", 1, day(1)), (1, "https://A.example/./x", 4, day(9)), (1, "https://b.gov.br/y", 3, day(5)), (1, "https://c.example/", 2, None),
        (1, "http://plain.example/", 1, day(9)), (1, "https://gov.br.example/", 5, day(9)), (2, "https://gov.br/", 1, day(2)),
    ]
    pages = spark.createDataFrame(rows, "need int, url string, rank int, at timestamp")
    pick = lambda **more: [(r.need, r.POSICAO, r.URL, r.RANK) for r in web.evidence(pages, {"gov.br"}, 3, "need", published="at", **more).orderBy("need", "POSICAO").collect()]
    assert pick() == [(1, 1, "https://b.gov.br/y", 3), (1, 2, "https://c.example/", 2), (1, 3, "https://a.example/x", 4), (2, 1, "https://gov.br/", 1)]
    assert pick(cutoff=F.lit(day(4))) == [(1, 1, "https://b.gov.br/y", 3), (1, 2, "https://a.example/x", 4), (1, 3, "https://gov.br.example/", 5)]
    assert pick(official_only=True) == [(1, 1, "https://b.gov.br/y", 3), (2, 1, "https://gov.br/", 1)]
