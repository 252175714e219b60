"""Windows of days over a supplier-year, for every length at once.

Purchases are dealt by supplier-year once, which serves all that follows, and summed per supplier-year, card and day. From there on a supplier-year has at most a few hundred
rows, one per day, however many purchases it has: counts, sums and squares of [day, day + length] come from range frames
over days, and distinct cards from running sums (a card's day counts for the anchors after the card's day before it, so it enters at one
day and leaves after another). Only windows that pass are joined with values again, by buckets of the window's width: a window meets two
buckets at most, and no join key holds more than one supplier's bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as x
from ..functions import ranks
from ..sources import scratch

KEYS = ["UG_ID", "FAVORECIDO_ID", "ANO_TRANSACAO"]


def recurring_purchases(staged: DataFrame, card: str) -> DataFrame:
    """(keys, _CARD, _DAY, _V) of the purchases that windows look at."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in ("DATA_DT", "UG_ID", "ANO_TRANSACAO", card)))
    rows = staged.filter(x.true("EH_COMPRA_NACIONAL") & (F.col("VALOR_CENTAVOS") > 0) & known & x.true("FAVORECIDO_IDENTIFICADO"))
    return rows.select(*KEYS, F.col(card).alias("_CARD"), F.unix_date("DATA_DT").alias("_DAY"), F.col("VALOR_CENTAVOS").alias("_V"))


def _parts(spark: SparkSession) -> int:
    """Parts that supplier-years are dealt to: several times a shuffle's, and stated, so that they aren't put together by their packed size; each row becomes several below."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def window_metrics(rows: DataFrame, lengths: Sequence[int], least: int = 1, dealt: bool = False) -> DataFrame:
    """A row per length and day with purchases: JANELA_DIAS, INICIO, FIM, N, N_PORTADORES, TOTAL_, MIN_, MAX_CENTAVOS, CV over [day, day + length].

    ``rows`` as of ``recurring_purchases``; those of a fact that is ``dealt`` aren't moved. Supplier-years of fewer purchases than ``least``, of which no window can hold so many, go before anything is grouped. The coefficient of variation comes from exact sums of cents and of their squares.
    """
    squares = F.col("_V").cast("decimal(19,0)") * F.col("_V").cast("decimal(19,0)")
    keys = ["_H", *KEYS]  # the number tells nearly all supplier-years apart, so that sorting seldom compares texts
    placed = (rows if dealt else rows.repartition(_parts(rows.sparkSession), *KEYS)).withColumn("_H", F.xxhash64(*KEYS))
    if least > 1:
        placed = placed.withColumn("_ALL", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_ALL") >= least).drop("_ALL")
    card_days = placed.groupBy(*keys, "_CARD", "_DAY").agg(
        F.count(F.lit(1)).alias("n"), F.sum("_V").alias("s"), F.sum(squares).alias("ss"), F.min("_V").alias("lo"), F.max("_V").alias("hi")
    )
    before = F.lag("_DAY").over(Window.partitionBy(*keys, "_CARD").orderBy("_DAY"))
    day = F.col("_DAY")
    names = [f"d{i}" for i in range(len(lengths))]
    nothing = [F.lit(None).cast("bigint").alias(c) for c in ("n", "s")] + [F.lit(None).cast("decimal(38,0)").alias("ss")]
    nothing += [F.lit(None).cast("bigint").alias(c) for c in ("lo", "hi")]
    step = lambda at, values: F.struct(at.alias("day"), *nothing, *(F.lit(v).alias(d) for d, v in zip(names, values, strict=True)))
    own = F.struct(day.alias("day"), "n", "s", "ss", "lo", "hi", *(F.lit(0).alias(d) for d in names))
    enters = [
        step(F.greatest(F.col("_BEFORE") + 1, day - length), [int(i == k) for k in range(len(lengths))]) for i, length in enumerate(lengths)
    ]
    steps = F.explode(F.array(own, *enters, step(day + 1, [-1] * len(lengths))))
    days = (
        card_days.withColumn("_BEFORE", before)
        .select(*keys, steps.alias("e"))
        .groupBy(*keys, "e.day")
        .agg(
            F.sum("e.n").alias("n"), F.sum("e.s").alias("s"), F.sum("e.ss").alias("ss"), F.min("e.lo").alias("lo"), F.max("e.hi").alias("hi"),
            *(F.sum(f"e.{d}").alias(d) for d in names),
        )
    )
    in_days = Window.partitionBy(*keys).orderBy("day")
    so_far = in_days.rangeBetween(Window.unboundedPreceding, 0)

    def metrics(i: int, length: int) -> list[Column]:
        frame = in_days.rangeBetween(0, length)
        return [
            F.sum("n").over(frame).alias(f"N{i}"), F.sum("s").over(frame).alias(f"S{i}"), F.sum("ss").over(frame).alias(f"SS{i}"),
            F.min("lo").over(frame).alias(f"LO{i}"), F.max("hi").over(frame).alias(f"HI{i}"),
            F.max(F.when(F.col("n") > 0, F.col("day"))).over(frame).alias(f"END{i}"), F.sum(names[i]).over(so_far).alias(f"P{i}"),
        ]

    wide = days.select(*KEYS, "day", "n", *(c for i, length in enumerate(lengths) for c in metrics(i, length))).filter("n > 0")

    def one(i: int, length: int) -> Column:
        n, s, ss = F.col(f"N{i}"), F.col(f"S{i}").cast("decimal(19,0)"), F.col(f"SS{i}")
        spread = F.sqrt((n.cast("decimal(10,0)") * ss - s * s).cast("double"))
        return F.struct(
            F.lit(length).alias("JANELA_DIAS"), F.date_from_unix_date("day").alias("INICIO"), F.date_from_unix_date(f"END{i}").alias("FIM"),
            n.alias("N"), F.col(f"P{i}").alias("N_PORTADORES"), F.col(f"S{i}").alias("TOTAL_CENTAVOS"), F.col(f"LO{i}").alias("MIN_CENTAVOS"),
            F.col(f"HI{i}").alias("MAX_CENTAVOS"), (spread / s.cast("double")).alias("CV"),
        )

    return wide.select(*KEYS, F.explode(F.array(*(one(i, w) for i, w in enumerate(lengths)))).alias("w")).select(*KEYS, "w.*")


def _bucket(day: Column, width: int) -> Column:
    return F.floor(day / width).cast("int")


def inside(windows: DataFrame, rows: DataFrame, day: str, width: int) -> DataFrame:
    """Windows (keys, INICIO, FIM, ...) joined with the rows of their supplier-year in [INICIO, FIM]; ``day``: the rows' day number.

    Both sides are dealt to buckets of ``width`` days, so the key is a supplier's bucket. A window that is no longer than ``width`` meets two.
    """
    start, end = F.unix_date("INICIO"), F.unix_date("FIM")
    met = windows.withColumn("_BUCKET", F.explode(F.sequence(_bucket(start, width), _bucket(end, width))))
    dealt = rows.withColumn("_BUCKET", _bucket(F.col(day), width))
    return met.join(dealt, [*KEYS, "_BUCKET"]).filter(F.col(day).between(start, end)).drop("_BUCKET")


def with_quantiles(windows: DataFrame, rows: DataFrame, length: int, tolerance: float) -> DataFrame:
    """Windows of one length with MEDIANA, Q1, Q3, IQR, and SHARE_MEDIANA: the share of purchases within ``tolerance`` of the median.

    Equal values of a day are one row with their number. Only supplier-years that have a window are counted.
    """
    counted = rows.join(windows.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS, "_DAY", "_V").agg(F.count(F.lit(1)).alias("_TIMES"))
    value = F.col("_V").cast("double")
    asked = windows.select(*KEYS, "INICIO", "FIM")
    quantiles = (
        inside(asked, counted, "_DAY", length + 1)
        .groupBy(*KEYS, "INICIO", "FIM")
        .agg(F.percentile(value, F.array(*map(F.lit, (0.25, 0.5, 0.75))), F.col("_TIMES")).alias("q"))
        .select(*KEYS, "INICIO", "FIM", F.col("q")[0].alias("Q1"), F.col("q")[1].alias("MEDIANA"), F.col("q")[2].alias("Q3"))
    )
    near = F.when(F.abs(value - F.col("MEDIANA")) <= tolerance * F.col("MEDIANA"), F.col("_TIMES")).otherwise(0)
    shared = (
        inside(quantiles, counted, "_DAY", length + 1)
        .groupBy(*KEYS, "INICIO")
        .agg(F.first("Q1").alias("Q1"), F.first("MEDIANA").alias("MEDIANA"), F.first("Q3").alias("Q3"), (F.sum(near) / F.sum("_TIMES")).alias("SHARE_MEDIANA"))
    )
    return windows.join(shared, [*KEYS, "INICIO"]).withColumn("IQR", F.col("Q3") - F.col("Q1"))


# The calibration grid (lengths, purchases, cards, coefficients of variation).
LENGTHS = (15, 30, 45, 60)
PURCHASES = (3, 5, 7, 10)
CARDS = (2, 3)
VARIATIONS = (0.05, 0.10, 0.15, 0.20, 0.30)


def calibration_grid(
    metrics: DataFrame,
    lengths: Sequence[int] = LENGTHS,
    least: Sequence[int] = PURCHASES,
    cards: Sequence[int] = CARDS,
    variations: Sequence[float] = VARIATIONS,
) -> DataFrame:
    """A row per combination of thresholds: supplier-years with a window that meets it, and what their best window holds.

    ``metrics`` as of ``window_metrics``. The best window has most purchases, then most cards, least variation, most value and the earliest start. It
    is found by one aggregation of minima, and written, since medians come from ranks of its variations, not from one task's list of them. Combinations that nothing meets have N_GRUPOS 0 and nulls.
    """
    grid = list(product(least, cards, variations))
    combination = F.explode(F.array(*(F.struct(F.lit(n).alias("MIN_N"), F.lit(c).alias("MIN_P"), F.lit(float(v)).alias("MAX_CV")) for n, c, v in grid)))
    met = metrics.filter((F.col("N") >= min(least)) & (F.col("N_PORTADORES") >= min(cards)) & (F.col("CV") <= max(variations)))
    met = met.withColumn("g", combination).filter(
        (F.col("N") >= F.col("g.MIN_N")) & (F.col("N_PORTADORES") >= F.col("g.MIN_P")) & (F.col("CV") <= F.col("g.MAX_CV"))
    )
    order = F.struct((-F.col("N")).alias("n"), (-F.col("N_PORTADORES")).alias("p"), F.col("CV").alias("cv"), (-F.col("TOTAL_CENTAVOS")).alias("t"), "INICIO")
    by = ["JANELA_DIAS", "MIN_N", "MIN_P", "MAX_CV"]
    chosen = met.groupBy("JANELA_DIAS", "g", *KEYS).agg(F.min(order).alias("b"))
    best = scratch.written(chosen.select("JANELA_DIAS", "g.*", "b", F.col("b.cv").alias("_CV")), "best_windows")
    found = best.groupBy(*by).agg(
        F.count(F.lit(1)).alias("N_GRUPOS"),
        F.sum(-F.col("b.n")).alias("TRANSACOES_REPRESENTATIVAS"),
        (F.sum(-F.col("b.t")) / 100).alias("VALOR_REPRESENTATIVO"),
        F.avg("b.cv").alias("CV_MEDIO"),
    )
    medians = ranks.medians(best, "_CV", by, "CV_MEDIANO")
    every = metrics.sparkSession.createDataFrame(
        [(w, n, c, float(v)) for w, (n, c, v) in product(lengths, grid)], "JANELA_DIAS int, MIN_N int, MIN_P int, MAX_CV double"
    )
    return every.join(found, by, "left").join(medians, by, "left").na.fill(0, ["N_GRUPOS"])
