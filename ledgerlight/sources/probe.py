"""What delimited files look like, from their first bytes, and how they are read together."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Delimiters and encodings in the order of trial, and the encodings' names in Java.
DELIMITERS = (";", ",", "\t")
ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin1": "ISO-8859-1"}
#: Bytes of a file that are looked at, and files looked at at once.
HEAD_BYTES = 100_000
AT_ONCE = 32
_UNREAD = re.compile("[\udc80-\udcff]")
#: Spark doesn't read windows-1252; it differs from ISO-8859-1 in these characters only.
_WINDOWS = {bytes([b]).decode("latin1"): c for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore"))}


@dataclass(frozen=True)
class Layout:
    """Files of one layout are read by one scan."""

    encoding: str
    delimiter: str
    columns: tuple[str, ...]


def first_bytes(spark: SparkSession, path: str, most: int = HEAD_BYTES) -> bytes:
    """The start of a file, or of the first file with content of a folder; nothing beyond it is read. Where the file goes on, whole lines only, so that no character is cut."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getFileStatus(where).isDirectory():
        inside = sorted((f.getPath().toString(), f.getLen()) for f in files.listStatus(where) if not f.getPath().getName().startswith(("_", ".")))
        where = next((spark._jvm.org.apache.hadoop.fs.Path(p) for p, size in inside if size), None)
        if where is None:
            return b""
    stream = files.open(where)
    try:
        head = bytes(stream.readNBytes(most))
        return head[: head.rfind(b"\n") + 1] or head if len(head) == most and stream.read() >= 0 else head
    finally:
        stream.close()


def encoding_of(head: bytes) -> str:
    """The first known encoding that reads all of the bytes; one that cuts a character at their end doesn't."""
    return next(e for e in ENCODINGS if not _UNREAD.search(head.decode(e, "surrogateescape")))  # latin1 reads anything


def delimiter_of(header: str) -> str:
    """The known delimiter that the header has most often, the earlier of equals."""
    best = max(DELIMITERS, key=header.count)
    if best not in header:
        raise ValueError("the header has no known delimiter")
    return best


def layout_of(head: bytes) -> Layout:
    encoding = encoding_of(head)
    header = head.decode(encoding).lstrip("﻿").splitlines()[:1]
    delimiter = delimiter_of(header[0] if header else "")
    (names,) = csv.reader(header, delimiter=delimiter)
    return Layout(ENCODINGS[encoding], delimiter, tuple(n.strip() for n in names))


def layouts(spark: SparkSession, paths: Sequence[str]) -> dict[Layout, list[str]]:
    """The files of each layout."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        found = list(pool.map(lambda p: layout_of(first_bytes(spark, p)), paths))
    out: dict[Layout, list[str]] = {}
    for layout, path in zip(found, paths, strict=True):
        out.setdefault(layout, []).append(path)
    return out


def read_text(spark: SparkSession, paths: str | Sequence[str], layout: Layout) -> DataFrame:
    """Every column as text; empty cells are empty text. A malformed row is an error."""
    windows = layout.encoding == ENCODINGS["cp1252"]
    read = (
        spark.read.option("header", True)
        .option("sep", layout.delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("encoding", ENCODINGS["latin1"] if windows else layout.encoding)
        .option("inferSchema", False)
        .option("mode", "FAILFAST")
        .csv(paths if isinstance(paths, str) else list(paths))
        .na.fill("")
    )
    if not windows:
        return read
    made = str.maketrans(_WINDOWS)
    return read.select(*(F.translate(f"`{c}`", "".join(_WINDOWS), "".join(_WINDOWS.values())).alias(c.translate(made)) for c in read.columns))


def consolidate(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All files by name of column, one scan per layout; columns that a file lacks are empty. Month and file name are added."""
    if not paths:
        raise ValueError("no files")
    frames = []
    for layout, own in layouts(spark, paths).items():
        df = read_text(spark, own, layout)
        name = df.metadataColumn("_metadata")["file_name"]
        frames.append(df.select("*", F.regexp_extract(name, r"(\d{6})", 1).alias("COMPETENCIA_ARQUIVO"), name.alias("ARQUIVO_ORIGEM")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).na.fill("")


def file_report(consolidated: DataFrame) -> DataFrame:
    """(ARQUIVO_ORIGEM, COMPETENCIA_ARQUIVO, N_LINHAS) of what was read."""
    return consolidated.groupBy("ARQUIVO_ORIGEM", "COMPETENCIA_ARQUIVO").agg(F.count(F.lit(1)).alias("N_LINHAS"))
