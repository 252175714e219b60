"""Reading tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def numbered(docs: DataFrame, name: str = "_row") -> DataFrame:
    """``docs``, a scan of Parquet files, with the place of each row: its file's number and its index in that file.

    Unlike ``monotonically_increasing_id`` it doesn't depend on how a scan splits the files, so that all
    scans of ``docs`` give a row the same place. Only the names of the files are collected. ``docs`` must not
    have a column of the given name.
    """
    spark = docs.sparkSession
    meta = docs.metadataColumn("_metadata")  # also where a column of the table is called that
    files = sorted(r[0] for r in docs.select(meta["file_path"].alias("f")).distinct().collect())
    number, of, path = (free_name(docs, n) for n in ("_file_number", "_file_name", "_file_path"))
    numbers = spark.createDataFrame(list(enumerate(files)), f"`{number}` long, `{of}` string")
    index = free_name(docs, "_file_row")
    placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(index))
    return (
        placed.join(F.broadcast(numbers), F.col(path) == F.col(of))
        .withColumn(name, F.shiftleft(number, 36) + F.col(index))
        .drop(path, index, number, of)
    )


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme.

    A cluster names it in ``spark.checkpoint.dir``; where it doesn't, that is an error. Only a local session,
    as in tests, gets a folder of this machine.
    """
    folder = spark.conf.get(SHARED, None) or spark.sparkContext.getConf().get(SHARED)
    if folder is None:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError(f"{SHARED} must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        folder = _LOCAL[context.applicationId]
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    It cuts the lineage: what is computed from it later survives the loss of
    any executor without computing ``df`` again.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
