"""A published bundle of tables that readers see whole: the old one or the new one.

Tables go to a version's own folder. Their rows are counted by the job that writes them, so nothing is read back. When the last is written, a manifest
states name, kind, path, rows, ordered columns and bytes of each, and one atomic rename of a small pointer file makes
the version current. A failure before that leaves the former version as it was and removes the unfinished one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .. import model
from .sinks import logical_name

CURRENT, MANIFEST = "CURRENT", "manifest.json"
#: Jobs over small tables that run at once.
AT_ONCE = 8


class _Files:
    """The few file operations that a bundle needs, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self._gateway = spark.sparkContext._gateway
        self._hadoop, self._conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
        root = self._hadoop.Path(folder)
        self._fs = root.getFileSystem(self._conf)
        self.root = self._fs.makeQualified(root).toString().rstrip("/")

    def path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    def bytes_of(self, name: str) -> int | None:
        path = self.path(name)
        return self._fs.getContentSummary(path).getLength() if self._fs.exists(path) else None

    def read(self, name: str) -> str | None:
        path = self.path(name)
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, content: str) -> None:
        stream = self._fs.create(self.path(name), True)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    def replace(self, old: str, new: str) -> None:
        """Rename over what is there, in one step."""
        kind = getattr(self._hadoop, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self.path(old), self.path(new), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class BundleWriter:
    """Write the tables of a new version; leaving the block without an error publishes it."""

    def __init__(self, spark: SparkSession, folder: str, source: dict | None = None):
        self.spark, self.source = spark, source or {}
        self.files = _Files(spark, folder)
        self.version = f"v-{uuid.uuid4().hex}"
        self.tables: list[dict] = []

    def write(self, name: str, df: DataFrame, kind: str = "diagnostic") -> DataFrame:
        """Write a table and return it as it was written."""
        where = f"{self.version}/{logical_name(name)}"
        if any(t["name"] == name for t in self.tables):
            raise ValueError(f"{name} is written twice")
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd").parquet(f"{self.files.root}/{where}")
        self.tables.append(
            {"name": name, "kind": kind, "path": where, "rows": seen.get["rows"], "columns": df.columns, "bytes": self.files.bytes_of(where)}
        )
        return self.spark.read.schema(df.schema).parquet(f"{self.files.root}/{where}")

    def write_all(self, tables: Mapping[str, DataFrame], kind: str = "diagnostic") -> None:
        """Write many small tables, some jobs at a time."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for done in [pool.submit(self.write, name, df, kind) for name, df in tables.items()]:
                done.result()

    def __enter__(self) -> BundleWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.files.delete(self.version)
            return
        manifest = {
            "version": self.version,
            "generated_at_utc": datetime.now(timezone.utc).isoformat(),
            "versions": {"preparation": model.PREPARATION_VERSION, "rules": model.RULES_VERSION},
            "source": self.source,
            "tables": sorted(self.tables, key=lambda t: t["name"]),
        }
        self.files.write(f"{self.version}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False, indent=2))
        pointer = f"{CURRENT}-{self.version}"
        self.files.write(pointer, self.version)
        self.files.replace(pointer, CURRENT)


def manifest_of(spark: SparkSession, folder: str) -> dict:
    """The manifest of the current version."""
    files = _Files(spark, folder)
    if (version := files.read(CURRENT)) is None:
        raise FileNotFoundError(f"no bundle in {folder}")
    return json.loads(files.read(f"{version}/{MANIFEST}"))


def open_bundle(spark: SparkSession, folder: str, views: bool = False) -> dict[str, DataFrame]:
    """The current version's tables by name; with ``views`` also as ``v_name``."""
    root = _Files(spark, folder).root
    found = {t["name"]: spark.read.parquet(f"{root}/{t['path']}") for t in manifest_of(spark, folder)["tables"]}
    for name, df in found.items() if views else ():
        df.createOrReplaceTempView(f"v_{name}")
    return found


def check_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """(NOME, EXISTE, BYTES_OK, LINHAS_OK, COLUNAS_OK, OK) of each table against the manifest. Rows come from the files' footers."""
    files = _Files(spark, folder)

    def check(t: dict) -> tuple:
        size = files.bytes_of(t["path"])
        n, columns = None, None
        if size is not None:
            try:
                df = spark.read.parquet(f"{files.root}/{t['path']}")
                n, columns = df.count(), df.columns
            except Exception:  # noqa: BLE001 - an unreadable table is a finding, whatever the reason
                n = None
        found = (size is not None, size == t["bytes"], n == t["rows"], columns == t["columns"])
        return (t["name"], *found, all(found))

    with ThreadPoolExecutor(AT_ONCE) as pool:
        rows = list(pool.map(check, manifest_of(spark, folder)["tables"]))
    return spark.createDataFrame(rows, "NOME string, EXISTE boolean, BYTES_OK boolean, LINHAS_OK boolean, COLUNAS_OK boolean, OK boolean")


def prune(spark: SparkSession, folder: str, versions: list[str]) -> None:
    """Delete former versions that no reader needs any more; the current one stays."""
    current = manifest_of(spark, folder)["version"]
    for version in versions:
        if version != current and version.startswith("v-") and "/" not in version:
            _Files(spark, folder).delete(version)
