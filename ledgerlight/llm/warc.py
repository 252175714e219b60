"""WARC archives with an index that is written first and read from.

``write_archives`` gives each task its own gzip files, one member per record, and
returns the index: file, offset and length of each record with its URL and digest. The
index is a table in the shared folder. ``read_records`` sorts the selected index rows by
file and offset, deals contiguous ranges to tasks, joins neighbouring byte ranges into
one read each, and parses the records. Only selected records are read.

A file bears a random name and only the index of the attempt that succeeded names
it, so tasks that are lost and run again leave no double records.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes (SHA-256 decides), the one
with the largest page_id is a response, and the others revisit it. Defined results: a
payload that is null is empty; null URLs are written as empty and read as null; rows that repeat
the responding page_id are responses too; a null page_id ranks below all others and stays
null. Empty tables give an empty index. Other columns play no part.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, written

REVISIT_BYTES = 1000
#: An archive file is closed when it has grown to this size.
FILE_BYTES = 1 << 30
#: Byte ranges this near to each other are read at once, up to READ_BYTES.
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
#: Archive bytes that a reading task gets.
TASK_BYTES = 16 << 20

#: Groups of equal payloads that are broadcast, 50 bytes each; if there are more, only those of hot payloads are.
BROADCAST_GROUPS = 400_000
MANY = 10_000

INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string"
RECORD = (
    "page_id long, url string, record_type string, refers_to long, "
    "stated_bytes long, stated_digest string, payload binary"
)
_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")


def _record(page_id, url, digest, size, refers_to, payload: bytes) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=_SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Bytes: {size}",
    ]
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(refers_to))}>")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _parse(data: bytes) -> tuple:
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    number = lambda k: int(fields[k]) if fields.get(k) else None
    payload = rest[: int(fields["Content-Length"])]
    return (
        number("X-Page-Id"),
        unquote(fields["WARC-Target-URI"]) or None,
        fields["WARC-Type"],
        number("X-Refers-To-Page-Id"),
        number("X-Payload-Bytes"),
        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        payload,
    )


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        stream, name, at = None, None, 0
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if stream is None or at >= FILE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(f"{root}/{name}", compression=None)
                payload = row["payload"] or b""
                digest = hashlib.sha1(payload).hexdigest()
                data = gzip.compress(
                    _record(row["page_id"], row["url"], digest, len(payload), row["refers_to"], payload), 1, mtime=0
                )
                stream.write(data)
                kind = "response" if row["refers_to"] is None else "revisit"
                index.append((name, at, len(data), row["page_id"], row["url"], digest, kind))
                at += len(data)
            yield _batch(index, _INDEX_ARROW)
        if stream is not None:
            stream.close()

    return write


_INDEX_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
    ]
)
_RECORD_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("stated_bytes", pa.int64()),
        ("stated_digest", pa.string()),
        ("payload", pa.binary()),
    ]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def with_revisits(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> DataFrame:
    """(page_id, url, payload, refers_to): null refers_to for responses."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.when(F.octet_length(payload) >= REVISIT_BYTES, F.unhex(F.sha2(payload, 256))).alias("_same"),
    )
    digests = rows.filter(F.col("_same").isNotNull()).groupBy("_same").agg(F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    groups = written(digests.filter("_n > 1"), "same-payloads")
    n_groups, n_rows = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to")
    columns = ["page_id", "url", "payload"]
    if n_groups <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), "_same", "left").select(*columns, refers)
    # payloads in more than 1 of MANY rows: fewer than MANY of them, settled where they lie; the others make no hot key
    hot = F.col("_n") * MANY > n_rows
    near = rows.join(F.broadcast(groups.filter(hot)), "_same", "left")
    settled = F.col("_same").isNull() | F.col("_n").isNotNull()
    far = near.filter(~settled).drop("_first", "_n").join(groups.filter(~hot), "_same", "left")
    return near.filter(settled).select(*columns, refers).unionByName(far.select(*columns, refers))


def write_archives(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html") -> tuple[str, DataFrame]:
    """Write all pages; returns the archives' folder and the index table."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    store, root = _file_system(folder)
    store.create_dir(root, recursive=True)
    records = with_revisits(pages, id_col, url_col, payload_col)
    return folder, written(records.mapInArrow(_writer(folder), INDEX), "warc-index")


def _reader(folder: str):
    def runs(rows: list[dict]) -> Iterator[list[dict]]:
        run: list[dict] = []
        for row in rows:
            if run and (
                row["file"] != run[-1]["file"]
                or row["offset"] - (run[-1]["offset"] + run[-1]["length"]) > GAP_BYTES
                or row["offset"] + row["length"] - run[0]["offset"] > READ_BYTES
            ):
                yield run
                run = []
            run.append(row)
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file_system(folder)
        opened, source = None, None
        for batch in batches:
            for run in runs(batch.to_pylist()):
                if run[0]["file"] != opened:
                    if source is not None:
                        source.close()
                    opened = run[0]["file"]
                    source = store.open_input_file(f"{root}/{opened}")
                start = run[0]["offset"]
                data = source.read_at(run[-1]["offset"] + run[-1]["length"] - start, start)
                found = [
                    _parse(gzip.decompress(data[r["offset"] - start : r["offset"] - start + r["length"]])) for r in run
                ]
                yield _batch(found, _RECORD_ARROW)
        if source is not None:
            source.close()

    return read


def read_records(folder: str, selected: DataFrame) -> DataFrame:
    """The records that rows of the index (``selected``) point to."""
    size = selected.agg(F.sum("length")).first()[0] or 0
    ranges = (
        selected.select("file", "offset", "length")
        .repartitionByRange(-(-size // TASK_BYTES) or 1, "file", "offset")
        .sortWithinPartitions("file", "offset")
    )
    return ranges.mapInArrow(_reader(folder), RECORD)
