"""Incremental forms: a landing folder as a stream, and daily withdrawals with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators.staging import build_staging


def landed(spark: SparkSession, folder: str, sep: str = ";") -> DataFrame:
    """Raw rows of files as they land, staged."""
    raw = spark.readStream.schema(model.RAW_SCHEMA).option("header", True).option("sep", sep).csv(folder).na.fill("")
    return build_staging(raw)


def daily_withdrawals_stream(staged: DataFrame, time: str, card: str = "PORTADOR_ID", late: str = "7 days", least: int = 2) -> DataFrame:
    """Days with at least ``least`` withdrawals of one cardholder in one unit."""
    return (
        staged.filter(F.coalesce(F.col("EH_SAQUE_EFETIVO"), F.lit(False)))
        .withWatermark(time, late)
        .groupBy(F.window(time, "1 day").alias("DIA"), "UG_ID", card)
        .agg(F.count(F.lit(1)).alias("N"), F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS"))
        .filter(F.col("N") >= least)
    )
