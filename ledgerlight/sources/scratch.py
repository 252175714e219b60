"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"

_LOCAL: dict[str, str] = {}

#: Bytes of packed input that one bucket of a dealt table stands for; a task holds one bucket.
BUCKET = 16 << 20


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names; only a local session may leave that unset."""
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _LOCAL[context.applicationId]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, read again: what follows doesn't depend on how ``df`` was made."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, name: str, keys: Sequence[str], size: int) -> DataFrame:
    """``df`` as a Parquet table in buckets of ``keys``, read again: what is grouped by these keys, or by them and others, isn't moved again.

    ``size``: bytes of what ``df`` is made from. The number of buckets grows with it, so that no task's rows do.
    """
    spark = df.sparkSession
    parts = parts_of(spark, size)
    path = new_folder(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(parts, *keys).write.format("parquet").bucketBy(parts, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def parts_of(spark: SparkSession, size: int) -> int:
    """Parts for rows that are made from ``size`` bytes: a shuffle's own number, or more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))


def size_of(state: tuple) -> int:
    """Bytes of the inputs of a ``state``."""
    return sum(size for _, _, size in state[1:])


def state(spark: SparkSession, *paths: str) -> tuple:
    """What tells a session's intermediate tables apart: the application, and each input's path, time of change and size."""
    out = [spark.sparkContext.applicationId]
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        out.append((name, files.getFileStatus(path).getModificationTime(), files.getContentSummary(path).getLength()))
    return tuple(out)
