"""Connected components of an edge table, by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of ``edges`` (u long, v long) with the smallest node of its component.

    Each round gives a node the smallest label among its neighbours; from the second on, the label of its
    label follows, so that chains shorten by half and more. Stars, the usual case here, need one
    round to see that nothing changes. Minima are formed before the shuffle, labels are tables in the
    shared folder, and only whether something changed comes to the driver. Nulls and loops in
    ``edges`` are left out.
    """
    plain = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    both = written(plain.unionByName(plain.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    labels = written(
        both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("comp")), "labels"
    )
    jump = False
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), F.col("comp").alias("near")), "v")
        nearest = seen.groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        lowered = written(
            labels.join(nearest, "node").select(
                "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
            ),
            "labels",
        )
        drop_written(labels)
        if not lowered.filter("comp <> old").limit(1).count():
            drop_written(both)
            return lowered.select("node", "comp")
        labels = lowered.select("node", "comp")
        if jump:
            onward = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            labels = written(labels.join(onward, "comp").select("node", F.col("next").alias("comp")), "labels")
            drop_written(lowered)
        jump = True
