"""The nine rules. All take the staged fact and return DataFrames; the cardholder column is a parameter."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x
from ..functions import ranks
from ..sources import scratch
from . import windows

CARD = "PORTADOR_ID"
UNIT_YEAR = ["UG_ID", "ANO_TRANSACAO"]
#: Keys that a fact may be dealt by beforehand (``scratch.dealt``): supplier-years, repetitions and windows are all of these and others.
DEALT = ["UG_ID", "FAVORECIDO_ID"]


def _known(*columns: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


# T01: purchases on weekends


def on_weekend() -> Column:
    return x.true("EH_COMPRA_EFETIVA") & ~x.true("EH_AJUSTE_CONTESTACAO") & F.weekday("DATA_DT").isin(5, 6)


def weekend_purchases(staged: DataFrame) -> DataFrame:
    return staged.filter(on_weekend()).withColumn("ID_SINAL", x.signal_id("T01", "ID_TRANSACAO"))


def weekend_recurrence(staged: DataFrame, card: str = CARD) -> DataFrame:
    """Unit, cardholder and year over national purchases, with percent rank by year."""
    weekend = F.weekday("DATA_DT").isin(5, 6)
    grouped = (
        staged.filter(x.true("EH_COMPRA_NACIONAL") & _known("DATA_DT", "UG_ID", card))
        .groupBy("UG_ID", card, "ANO_TRANSACAO")
        .agg(
            F.count(F.lit(1)).alias("N_COMPRAS"),
            F.count_if(weekend).alias("N_FIM_SEMANA"),
            F.count_distinct(F.when(weekend, F.col("DATA_DT"))).alias("N_DIAS_FIM_SEMANA"),
            F.coalesce(F.sum(F.when(weekend, F.col("VALOR_CENTAVOS"))), F.lit(0)).alias("CENTAVOS_FIM_SEMANA"),
        )
        .filter("N_FIM_SEMANA > 0")
    )
    shared = grouped.withColumn("SHARE_FIM_SEMANA", x.ratio(F.col("N_FIM_SEMANA"), F.col("N_COMPRAS")))
    return ranks.with_percent_rank(shared, "N_DIAS_FIM_SEMANA", ["ANO_TRANSACAO"], "PERCENT_RANK_ANO")


def summarize_by_year(signals: DataFrame) -> DataFrame:
    return signals.groupBy("ANO_TRANSACAO").agg(
        F.count(F.lit(1)).alias("N_SINAIS"), F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS")
    )


def summarize_recurrence(recurrence: DataFrame) -> DataFrame:
    n = F.col("N_DIAS_FIM_SEMANA")
    return recurrence.groupBy("ANO_TRANSACAO").agg(
        F.count(F.lit(1)).alias("N_PORTADORES"),
        F.median(n).alias("MEDIANA_DIAS"),
        F.max(n).alias("MAX_DIAS"),
        F.avg(n).alias("MEDIA_DIAS"),
    )


# T02: instalments


def has_code(code: str = model.INSTALMENT) -> Column:
    """The code is compared untrimmed."""
    return F.coalesce(F.col("TRANSAÇÃO"), F.lit("")) == code


def instalments(staged: DataFrame, code: str = model.INSTALMENT) -> DataFrame:
    return staged.filter(has_code(code)).withColumn("ID_SINAL", x.signal_id("T02", "ID_TRANSACAO"))


def summarize_instalments(signals: DataFrame) -> DataFrame:
    """One row, of zeros if there is no signal."""
    zero = F.lit(0)
    return signals.agg(
        F.count(F.lit(1)).alias("N_SINAIS"),
        F.coalesce(F.sum("VALOR_CENTAVOS"), zero).alias("TOTAL_CENTAVOS"),
        F.coalesce(F.min("VALOR_CENTAVOS"), zero).alias("MIN_CENTAVOS"),
        F.coalesce(F.max("VALOR_CENTAVOS"), zero).alias("MAX_CENTAVOS"),
    )


# T03 and T04: repetition


def _repeatable(staged: DataFrame, card: str) -> DataFrame:
    return staged.filter(
        x.true("EH_COMPRA_EFETIVA")
        & ~x.true("EH_AJUSTE_CONTESTACAO")
        & (F.col("VALOR_CENTAVOS") > 0)
        & _known("DATA_DT", "UG_ID", card)
        & x.true("FAVORECIDO_IDENTIFICADO")
    )


def repetitions(staged: DataFrame, card: str = CARD, least: int = 2, dealt: bool = False) -> DataFrame:
    """N by unit, card, supplier, day, code and amount, of those whose unit, supplier, day and amount occur ``least`` times: no rarer ones reach a group of T03 or T04.

    Rows are dealt by what T04 groups by, so that T03 and T04 share one shuffle; if the fact is ``dealt`` they stay where they are. Most amounts occur once, so the rare ones go before anything is grouped.
    """
    keys = ["UG_ID", card, "FAVORECIDO_ID", "DATA_DT", "TRANSAÇÃO", "VALOR_CENTAVOS"]
    place = ["UG_ID", "FAVORECIDO_ID", "DATA_DT", "VALOR_CENTAVOS"]
    rows = _repeatable(staged, card).select(*keys)
    rows = rows if dealt else rows.repartition(*place)
    if least > 1:
        own = Window.partitionBy("_H", *place)  # the number tells nearly all places apart, so that sorting seldom compares texts
        rows = rows.withColumn("_H", F.xxhash64(*place)).withColumn("_TIMES", F.count(F.lit(1)).over(own)).filter(F.col("_TIMES") >= least).drop("_H", "_TIMES")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))


def exact_repetition(staged: DataFrame, card: str = CARD, least: int = 2, reinforced: int = 3, found: DataFrame | None = None) -> DataFrame:
    """``found``: ``repetitions`` of the fact that are there already."""
    keys = ["UG_ID", card, "FAVORECIDO_ID", "DATA_DT", "TRANSAÇÃO", "VALOR_CENTAVOS"]
    groups = (repetitions(staged, card, least) if found is None else found).filter(F.col("N") >= least)
    return groups.withColumns(
        {
            "TOTAL_CENTAVOS": F.col("VALOR_CENTAVOS") * F.col("N"),
            "NIVEL_TRIAGEM": F.when(F.col("N") >= reinforced, "REFORCADO").otherwise("ATENCAO"),
            "ID_GRUPO": x.signal_id("T03", *keys),
        }
    )


def exact_repetition_rows(staged: DataFrame, groups: DataFrame, card: str = CARD) -> DataFrame:
    keys = ["UG_ID", card, "FAVORECIDO_ID", "DATA_DT", "TRANSAÇÃO", "VALOR_CENTAVOS"]
    return _repeatable(staged, card).join(groups.select(*keys, "ID_GRUPO"), keys).select("ID_GRUPO", "ID_TRANSACAO")


def repetition_links(staged: DataFrame, card: str = CARD, least: int = 2, levels: tuple[int, int, int] = (2, 3, 5), dealt: bool = False) -> DataFrame:
    """(CODIGO_TRILHA, ID_SINAL, ID_TRANSACAO) of T03's and T04's groups. Groups are counted where their rows are, so no row is moved to meet its group.

    Rows are dealt and the rare ones go as in ``repetitions``.
    """
    keys = ["UG_ID", card, "FAVORECIDO_ID", "DATA_DT", "TRANSAÇÃO", "VALOR_CENTAVOS"]
    place = ["UG_ID", "FAVORECIDO_ID", "DATA_DT", "VALOR_CENTAVOS"]
    rows = _repeatable(staged, card).select(*keys, "ID_TRANSACAO")
    rows = (rows if dealt else rows.repartition(*place)).withColumn("_H", F.xxhash64(*place))
    own, n = Window.partitionBy("_H", *place), F.count(F.lit(1))
    counted = rows.withColumn("_TIMES", n.over(own)).filter(F.col("_TIMES") >= min(2, least)).withColumn("_CARD", F.dense_rank().over(own.orderBy(card)))
    counted = counted.withColumn("_CARDS", F.max("_CARD").over(own)).withColumn("_N", n.over(Window.partitionBy("_H", *keys)))
    link = lambda trail, *parts: F.struct(F.lit(trail).alias("CODIGO_TRILHA"), x.signal_id(trail, *parts).alias("ID_SINAL"))
    same, several = F.col("_N") >= least, (F.col("_TIMES") >= 2) & (F.col("_CARDS") >= levels[0])
    links = F.explode(F.array(F.when(same, link("T03", *keys)), F.when(several, link("T04", *place)))).alias("_LINK")
    return counted.filter(same | several).select(links, "ID_TRANSACAO").filter("_LINK IS NOT NULL").select("_LINK.*", "ID_TRANSACAO")


def secrecy_check(staged: DataFrame, card: str = CARD, secret: str = "EH_SIGILOSO") -> DataFrame:
    """Rows that T03 may group, rows that it does group, and how many of each are secret: one row."""
    groups = exact_repetition(staged, card)
    keys = ["UG_ID", card, "FAVORECIDO_ID", "DATA_DT", "TRANSAÇÃO", "VALOR_CENTAVOS"]
    rows = _repeatable(staged, card).select(*keys, x.true(secret).alias("_SECRET"))
    found = rows.join(groups.select(*keys, F.lit(True).alias("_HIT")), keys, "left")
    hit, hidden = x.true("_HIT"), F.col("_SECRET")
    return found.agg(
        F.count(F.lit(1)).alias("N_ELEGIVEIS"),
        F.count_if(hidden).alias("N_ELEGIVEIS_SIGILOSOS"),
        F.count_if(hit).alias("N_EM_SINAIS"),
        F.count_if(hit & hidden).alias("N_EM_SINAIS_SIGILOSOS"),
    )


def integral_repetition(raw: DataFrame, columns: list[str], secret: str = "EH_SIGILOSO", least: int = 2) -> DataFrame:
    """Rows equal in all given columns; null counts as empty."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    key = F.md5(F.concat_ws("|", *texts).cast("binary"))
    return (
        raw.filter(~x.true(secret))
        .groupBy(key.alias("HASH"))
        .agg(F.count(F.lit(1)).alias("N"), *(F.min(c).alias(c) for c in columns))
        .filter(F.col("N") >= least)
        .withColumn("ID_GRUPO", F.concat(F.lit("T03B_"), F.col("HASH")))
    )


def multi_cardholder(staged: DataFrame, card: str = CARD, levels: tuple[int, int, int] = (2, 3, 5), found: DataFrame | None = None) -> DataFrame:
    """``found``: ``repetitions`` of the fact that are there already."""
    keys = ["UG_ID", "FAVORECIDO_ID", "DATA_DT", "VALOR_CENTAVOS"]
    groups = (
        (repetitions(staged, card) if found is None else found)
        .groupBy(*keys)
        .agg(F.sum("N").alias("N"), F.count_distinct(card).alias("N_PORTADORES"))
        .filter((F.col("N") >= 2) & (F.col("N_PORTADORES") >= levels[0]))
    )
    level = F.when(F.col("N_PORTADORES") >= levels[2], "MUITO_ELEVADO").when(
        F.col("N_PORTADORES") >= levels[1], "ELEVADO"
    )
    return groups.withColumns(
        {
            "TOTAL_CENTAVOS": F.col("VALOR_CENTAVOS") * F.col("N"),
            "NIVEL_TRIAGEM": level.otherwise("ATENCAO"),
            "ID_GRUPO": x.signal_id("T04", *keys),
        }
    )


def multi_cardholder_rows(staged: DataFrame, groups: DataFrame, card: str = CARD) -> DataFrame:
    keys = ["UG_ID", "FAVORECIDO_ID", "DATA_DT", "VALOR_CENTAVOS"]
    return _repeatable(staged, card).join(groups.select(*keys, "ID_GRUPO"), keys).select("ID_GRUPO", "ID_TRANSACAO")


def summarize_groups(groups: DataFrame) -> DataFrame:
    return groups.groupBy("NIVEL_TRIAGEM").agg(
        F.count(F.lit(1)).alias("N_GRUPOS"),
        F.sum("N").alias("N_TRANSACOES"),
        F.sum("TOTAL_CENTAVOS").alias("TOTAL_CENTAVOS"),
    )


# T05: recurring purchases


def passing_windows(rows: DataFrame, days: int = 30, least: int = 5, cards: int = 2, max_cv: float = 0.20, dealt: bool = False) -> DataFrame:
    """Windows of purchases (``windows.recurring_purchases``) that meet the conditions, before their quantiles."""
    metrics = windows.window_metrics(rows, [days], least, dealt).drop("JANELA_DIAS")
    return metrics.filter((F.col("N") >= least) & (F.col("N_PORTADORES") >= cards) & (F.col("CV") <= max_cv))


def recurrence_windows(
    staged: DataFrame,
    card: str = CARD,
    days: int = 30,
    least: int = 5,
    cards: int = 2,
    max_cv: float = 0.20,
    tolerance: float = 0.20,
) -> DataFrame:
    """One row per anchor date that meets the conditions over [date, date + days]."""
    rows = windows.recurring_purchases(staged, card)
    kept = scratch.written(passing_windows(rows, days, least, cards, max_cv), "windows")  # read several times below
    return windows.with_quantiles(kept, rows, days, tolerance).select(
        *windows.KEYS, "INICIO", "FIM", "N", "N_PORTADORES", "TOTAL_CENTAVOS", "MIN_CENTAVOS", "MAX_CENTAVOS", "CV", "MEDIANA", "Q1", "Q3", "IQR", "SHARE_MEDIANA"
    )


def strongest_windows(candidates: DataFrame) -> DataFrame:
    """Of each cluster of overlapping windows, the strongest. A cluster ends where a window starts after all ends so far."""
    keys = ["UG_ID", "FAVORECIDO_ID", "ANO_TRANSACAO"]
    order = Window.partitionBy(*keys).orderBy("INICIO", "FIM", F.desc("N"))
    before = F.max("FIM").over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.coalesce(F.col("INICIO") > before, F.lit(True)).cast("int")
    clustered = candidates.withColumn("_STARTS", starts).withColumn(
        "_CLUSTER", F.sum("_STARTS").over(order.rowsBetween(Window.unboundedPreceding, 0))
    )
    best = Window.partitionBy(*keys, "_CLUSTER").orderBy(
        F.desc("N"), F.desc("N_PORTADORES"), "CV", F.desc("TOTAL_CENTAVOS"), "INICIO"
    )
    return clustered.withColumn("_RN", F.row_number().over(best)).filter("_RN = 1").drop("_STARTS", "_CLUSTER", "_RN")


def recurrence_episodes(candidates: DataFrame, reinforced_cv: float = 0.10, robust: float = 0.80) -> DataFrame:
    """The strongest windows with level, materiality by yearly percentile of value, and id."""
    chosen = strongest_windows(candidates)
    ranked = ranks.with_average_rank(chosen, "TOTAL_CENTAVOS", ["ANO_TRANSACAO"], "PERCENTIL_VALOR_ANO")
    band = F.when(F.col("PERCENTIL_VALOR_ANO") >= 0.90, "ELEVADA").when(F.col("PERCENTIL_VALOR_ANO") >= 0.75, "MODERADA")
    return ranked.withColumns(
        {
            "NIVEL_TRIAGEM": F.when(F.col("CV") <= reinforced_cv, "REFORCADO").otherwise("ATENCAO"),
            "MATERIALIDADE": band.otherwise("BAIXA"),
            "SIMILARIDADE_ROBUSTA": F.col("SHARE_MEDIANA") >= robust,
            "ID_EPISODIO": episode_id(),
        }
    )


def episode_id() -> Column:
    return x.short_signal_id("T05", "UG_ID", "FAVORECIDO_ID", "ANO_TRANSACAO", "INICIO", "FIM", "N", x.number_text(F.col("CV")))


def recurrence_links(staged: DataFrame, card: str = CARD, days: int = 30, least: int = 5, cards: int = 2, max_cv: float = 0.20, dealt: bool = False) -> DataFrame:
    """``recurrence_rows`` of the episodes of ``recurrence_windows``, without the quantiles and ranks that no link needs. The few windows and episodes are written, so that their size is known before rows meet them."""
    kept = scratch.written(passing_windows(windows.recurring_purchases(staged, card), days, least, cards, max_cv, dealt), "windows")
    episodes = strongest_windows(kept).select(*windows.KEYS, "INICIO", "FIM", episode_id().alias("ID_EPISODIO"))
    return recurrence_rows(staged, scratch.written(episodes, "episodes"), card, days)


def recurrence_rows(staged: DataFrame, episodes: DataFrame, card: str = CARD, days: int = 30) -> DataFrame:
    """The purchases of each episode. ``days``, the windows' length, is the width of the buckets that are joined."""
    rows = staged.filter(
        x.true("EH_COMPRA_NACIONAL") & (F.col("VALOR_CENTAVOS") > 0) & _known("DATA_DT", card) & x.true("FAVORECIDO_IDENTIFICADO")
    ).select(*windows.KEYS, F.unix_date("DATA_DT").alias("_DAY"), "ID_TRANSACAO")
    return windows.inside(episodes.select(*windows.KEYS, "INICIO", "FIM", "ID_EPISODIO"), rows, "_DAY", days + 1).select("ID_EPISODIO", "ID_TRANSACAO")


# T06: concentration


def _national(staged: DataFrame, *known: str) -> DataFrame:
    return staged.filter(x.true("EH_COMPRA_NACIONAL") & (F.col("VALOR_CENTAVOS") > 0) & _known(*known))


def supplier_years(staged: DataFrame, signals: Mapping[str, Column] | None = None) -> DataFrame:
    """A row per unit, supplier (or none) and year: its national purchases (N, TOTAL), those of an identified supplier (Q, V), and whether any row meets each condition of ``signals``."""
    national = x.true("EH_COMPRA_NACIONAL") & (F.col("VALOR_CENTAVOS") > 0) & _known(*UNIT_YEAR)
    identified = national & x.true("FAVORECIDO_IDENTIFICADO")
    return staged.groupBy(*UNIT_YEAR, "FAVORECIDO_ID").agg(
        *(F.coalesce(F.bool_or(condition), F.lit(False)).alias(name) for name, condition in (signals or {}).items()),
        F.count_if(national).alias("N"),
        F.sum(F.when(national, F.col("VALOR_CENTAVOS"))).alias("TOTAL"),
        F.count_if(identified).alias("Q"),
        F.sum(F.when(identified, F.col("VALOR_CENTAVOS"))).alias("V"),
    )


def concentration(staged: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``found``: ``supplier_years`` of the fact that are there already."""
    rows = (supplier_years(staged) if found is None else found).filter("N > 0")
    total = rows.groupBy(*UNIT_YEAR).agg(F.sum("N").alias("N_COMPRAS"), F.sum("TOTAL").alias("TOTAL_UG_CENTAVOS"))
    supplier = rows.filter("Q > 0").select(*UNIT_YEAR, "FAVORECIDO_ID", "V", "Q")
    unit = Window.partitionBy(*UNIT_YEAR)
    shares = supplier.withColumns(
        {
            "SHARE": F.col("V") / F.sum("V").over(unit),
            "SHARE_Q": F.col("Q") / F.sum("Q").over(unit),
            "RN": F.row_number().over(unit.orderBy(F.desc("V"), "FAVORECIDO_ID")),
            "RN_Q": F.row_number().over(unit.orderBy(F.desc("Q"), "FAVORECIDO_ID")),
        }
    )
    first = lambda c, rn="RN": F.max(F.when(F.col(rn) == 1, F.col(c)))
    found = shares.groupBy(*UNIT_YEAR).agg(
        F.count(F.lit(1)).alias("N_FORNECEDORES"),
        F.sum("V").alias("TOTAL_IDENTIFICADO_CENTAVOS"),
        F.sum("Q").alias("N_COMPRAS_IDENTIFICADAS"),
        first("FAVORECIDO_ID").alias("TOP1_FAVORECIDO_ID"),
        first("SHARE").alias("TOP1_SHARE_VALOR"),
        first("SHARE_Q").alias("TOP1_SHARE_QTD"),
        F.sum(F.when(F.col("RN") <= 5, F.col("SHARE"))).alias("TOP5_SHARE_VALOR"),
        F.sum(F.col("SHARE") * F.col("SHARE")).alias("HHI"),
        first("FAVORECIDO_ID", "RN_Q").alias("TOP1_FAVORECIDO_QTD"),
        first("SHARE_Q", "RN_Q").alias("TOP1_SHARE_QTD_MAX"),
    )
    return total.join(found, UNIT_YEAR, "left").withColumn(
        "COBERTURA", x.ratio(F.col("TOTAL_IDENTIFICADO_CENTAVOS"), F.col("TOTAL_UG_CENTAVOS"))
    )


def top_suppliers(found: DataFrame) -> DataFrame:
    """Of ``concentration`` over ``supplier_years`` what decides a signal: one aggregation to unit-years, in which no supplier is ranked."""
    identified = F.col("Q") > 0
    first = F.min(F.when(identified, F.struct((-F.col("V")).alias("V"), F.col("FAVORECIDO_ID").alias("ID"))))
    units = found.filter("N > 0").groupBy(*UNIT_YEAR).agg(
        F.sum("N").alias("N_COMPRAS"), F.sum("TOTAL").alias("_TOTAL"), F.count_if(identified).alias("N_FORNECEDORES"), F.sum(F.when(identified, F.col("V"))).alias("_V"), first.alias("_FIRST")
    )
    return units.select(
        *UNIT_YEAR, "N_COMPRAS", "N_FORNECEDORES", F.col("_FIRST.ID").alias("TOP1_FAVORECIDO_ID"), (-F.col("_FIRST.V") / F.col("_V")).alias("TOP1_SHARE_VALOR"),
        x.ratio(F.col("_V"), F.col("_TOTAL")).alias("COBERTURA"),
    )


def concentration_signals(
    indicators: DataFrame,
    purchases: int = 20,
    suppliers: int = 3,
    coverage: float = 0.80,
    levels: tuple[float, float, float] = (0.50, 0.70, 0.80),
) -> DataFrame:
    top = F.col("TOP1_SHARE_VALOR")
    kept = indicators.filter(
        (F.col("N_COMPRAS") >= purchases)
        & (F.col("N_FORNECEDORES") >= suppliers)
        & (F.col("COBERTURA") >= coverage)
        & (top >= levels[0])
    )
    level = F.when(top >= levels[2], "REFORCADO").when(top >= levels[1], "ELEVADO").otherwise("ATENCAO")
    return kept.withColumns({"NIVEL_TRIAGEM": level, "ID_SINAL": x.signal_id("T06", *UNIT_YEAR)})


def concentration_rows(staged: DataFrame, signals: DataFrame) -> DataFrame:
    picked = signals.select(*UNIT_YEAR, F.col("TOP1_FAVORECIDO_ID").alias("FAVORECIDO_ID"), "ID_SINAL")
    return _national(staged, "UG_ID", "ANO_TRANSACAO").join(picked, [*UNIT_YEAR, "FAVORECIDO_ID"]).select("ID_SINAL", "ID_TRANSACAO")


# T07: withdrawals


def effective_withdrawals(staged: DataFrame, card: str) -> DataFrame:
    return staged.filter(x.true("EH_SAQUE_EFETIVO") & _known("DATA_DT", "UG_ID", card, "VALOR_CENTAVOS"))


def daily_withdrawals(staged: DataFrame, card: str = CARD, least: int = 2, reinforced: int = 3) -> DataFrame:
    groups = (
        effective_withdrawals(staged, card)
        .groupBy("UG_ID", card, "ANO_TRANSACAO", "DATA_DT")
        .agg(
            F.count(F.lit(1)).alias("N"),
            F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS"),
            F.max("VALOR_CENTAVOS").alias("MAX_CENTAVOS"),
            F.array_join(F.array_sort(F.collect_set("TRANSAÇÃO")), " | ").alias("CODIGOS"),
        )
        .filter(F.col("N") >= least)
    )
    return groups.withColumns(
        {
            "NIVEL_TRIAGEM": F.when(F.col("N") >= reinforced, "REFORCADO").otherwise("ATENCAO"),
            "ID_EPISODIO": x.signal_id("T07D", "UG_ID", card, "DATA_DT"),
        }
    )


def daily_withdrawal_rows(staged: DataFrame, daily: DataFrame, card: str = CARD) -> DataFrame:
    keys = ["UG_ID", card, "DATA_DT"]
    return effective_withdrawals(staged, card).join(daily.select(*keys, "ID_EPISODIO"), keys).select("ID_EPISODIO", "ID_TRANSACAO")


def withdrawal_recurrence(
    daily: DataFrame, card: str = CARD, days: int = 3, quantile: float = 0.9, comparable: int = 10
) -> DataFrame:
    yearly, limits, first = _yearly_withdrawals(daily, card, days, quantile, comparable)
    ranked = ranks.with_percent_rank(yearly, "N_DIAS", ["ANO_TRANSACAO"], "PERCENT_RANK_ANO")
    return ranked.join(limits, "ANO_TRANSACAO").withColumn("PRIORITARIO", first)


def withdrawal_flags(daily: DataFrame, card: str = CARD, days: int = 3, quantile: float = 0.9, comparable: int = 10) -> DataFrame:
    """The keys of ``withdrawal_signals``, without ranks."""
    yearly, limits, first = _yearly_withdrawals(daily, card, days, quantile, comparable)
    return yearly.join(limits, "ANO_TRANSACAO").filter(first).select("UG_ID", card, "ANO_TRANSACAO")


def _yearly_withdrawals(daily: DataFrame, card: str, days: int, quantile: float, comparable: int) -> tuple[DataFrame, DataFrame, Column]:
    """Cardholder-years, each year's quantile of days, and the condition of priority over both."""
    yearly = daily.groupBy("UG_ID", card, "ANO_TRANSACAO").agg(
        F.count(F.lit(1)).alias("N_DIAS"),
        F.sum("N").alias("N_SAQUES"),
        F.sum("TOTAL_CENTAVOS").alias("TOTAL_CENTAVOS"),
        F.max("N").alias("MAX_DIA"),
        F.min("DATA_DT").alias("PRIMEIRO_DIA"),
        F.max("DATA_DT").alias("ULTIMO_DIA"),
    )
    limits = yearly.groupBy("ANO_TRANSACAO").agg(
        F.count(F.lit(1)).alias("N_COMPARAVEIS"), F.percentile(F.col("N_DIAS").cast("double"), quantile).alias("P90_DIAS")
    )
    first = (F.col("N_DIAS") >= days) & (F.col("N_COMPARAVEIS") >= comparable) & (F.col("N_DIAS") >= F.col("P90_DIAS"))
    return yearly, limits, first


def withdrawal_signals(recurrence: DataFrame, card: str = CARD) -> DataFrame:
    return recurrence.filter("PRIORITARIO").withColumn("ID_SINAL", x.signal_id("T07", "UG_ID", card, "ANO_TRANSACAO"))


def withdrawal_share(staged: DataFrame) -> DataFrame:
    both = x.true("EH_COMPRA_EFETIVA") | x.true("EH_SAQUE_EFETIVO")
    cents = lambda c: F.coalesce(F.sum(F.when(c, F.col("VALOR_CENTAVOS"))), F.lit(0))
    grouped = staged.filter(_known("UG_ID", "ANO_TRANSACAO")).groupBy(*UNIT_YEAR).agg(
        cents(x.true("EH_SAQUE_EFETIVO")).alias("SAQUES_CENTAVOS"), cents(both).alias("OBSERVADO_CENTAVOS")
    )
    return grouped.withColumn("SHARE_SAQUES", x.ratio(F.col("SAQUES_CENTAVOS"), F.col("OBSERVADO_CENTAVOS")))


# T09: dated limits


def limits_table(spark, periods=model.LIMITS) -> DataFrame:
    """One row per period with both limits in cents."""
    values = ", ".join(
        f"(DATE'{a}', DATE'{b}', {p}BD, {w}BD, {share}BD)" for a, b, p, w, share, *_ in periods
    )
    base = spark.sql(f"SELECT * FROM VALUES {values} AS t(INICIO, FIM, COMPRAS, ENGENHARIA, PCT)")
    limit = lambda c: (F.bround(F.col(c) * F.col("PCT"), 2) * 100).cast("bigint")
    return base.select(
        "INICIO", "FIM", limit("COMPRAS").alias("LIMITE_COMPRAS"), limit("ENGENHARIA").alias("LIMITE_ENGENHARIA")
    )


LIMIT_STATUSES = ("ABAIXO_FAIXA", "PROXIMO_LIMITE", "NO_LIMITE", "ACIMA_LIMITE")


def _limit_steps(value: Column, limit: Column, near: float, results: Sequence) -> Column:
    return F.when(value > limit, results[3]).when(value == limit, results[2]).when(value / limit >= near, results[1]).otherwise(results[0])


def limit_status(value: Column, limit: Column, near: float = 0.90) -> Column:
    return _limit_steps(value, limit, near, LIMIT_STATUSES)


def limit_place(value: Column, limit: Column, near: float = 0.90) -> Column:
    """The place of ``limit_status`` in LIMIT_STATUSES."""
    return _limit_steps(value, limit, near, range(len(LIMIT_STATUSES)))


def classify_limits(staged: DataFrame, limits: DataFrame, near: float = 0.90) -> DataFrame:
    """National purchases with their period's limits. Rows of no period are left out; see ``limit_gaps``."""
    rows = _national(staged, "DATA_DT", "ANO_TRANSACAO")
    joined = rows.join(F.broadcast(limits), F.col("DATA_DT").between(F.col("INICIO"), F.col("FIM")))
    v = F.col("VALOR_CENTAVOS")
    done = joined.withColumns(
        {
            "STATUS_COMPRAS": limit_status(v, F.col("LIMITE_COMPRAS"), near),
            "STATUS_ENGENHARIA": limit_status(v, F.col("LIMITE_ENGENHARIA"), near),
        }
    )
    c, e = F.col("STATUS_COMPRAS"), F.col("STATUS_ENGENHARIA")
    either = lambda s: (c == s) | (e == s)
    both = (c == "ACIMA_LIMITE") & (e == "ACIMA_LIMITE")
    status = (
        F.when(both, "ACIMA_AMBOS_CENARIOS")
        .when(either("ACIMA_LIMITE"), "ACIMA_PELO_MENOS_UM_CENARIO")
        .when(either("NO_LIMITE"), "NO_LIMITE_PELO_MENOS_UM_CENARIO")
        .when(either("PROXIMO_LIMITE"), "PROXIMO_LIMITE")
        .otherwise("ABAIXO_FAIXAS")
    )
    level = (
        F.when(both, "REFORCADO")
        .when(either("ACIMA_LIMITE"), "ATENCAO")
        .when(either("NO_LIMITE") | either("PROXIMO_LIMITE"), "INFORMATIVO")
        .otherwise("SEM_SINAL")
    )
    return done.withColumns({"STATUS_T09": status, "NIVEL_TRIAGEM": level}).drop("INICIO", "FIM")


def reaches_limit(limits: DataFrame, near: float = 0.90) -> Column:
    """Whether a national purchase has a signal of T09 in any of its periods, as one condition. The dated limits, a few rows, become part of it."""
    value, day = F.col("VALOR_CENTAVOS"), F.col("DATA_DT")
    close = lambda limit: limit_status(value, F.lit(limit), near) != "ABAIXO_FAIXA"
    held = [day.between(F.lit(p.INICIO), F.lit(p.FIM)) & (close(p.LIMITE_COMPRAS) | close(p.LIMITE_ENGENHARIA)) for p in limits.collect()]
    national = x.true("EH_COMPRA_NACIONAL") & (value > 0) & _known("DATA_DT", "ANO_TRANSACAO")
    return national & reduce(lambda a, b: a | b, held, F.lit(False))


def limit_gaps(staged: DataFrame, limits: DataFrame) -> DataFrame:
    """National purchases that fall in no period."""
    rows = _national(staged, "DATA_DT", "ANO_TRANSACAO")
    return rows.join(F.broadcast(limits), F.col("DATA_DT").between(F.col("INICIO"), F.col("FIM")), "left_anti")


def limit_signals(classified: DataFrame) -> DataFrame:
    return classified.filter("STATUS_T09 <> 'ABAIXO_FAIXAS'").withColumn(
        "ID_SINAL", x.signal_id("T09", "ID_TRANSACAO", "STATUS_COMPRAS", "STATUS_ENGENHARIA")
    )


def limit_scenarios(classified: DataFrame) -> DataFrame:
    """Two rows per purchase."""
    return classified.select(
        "ID_TRANSACAO",
        "VALOR_CENTAVOS",
        F.explode(
            F.array(
                *(
                    F.struct(
                        F.lit(n).alias("CENARIO"), F.col(f"LIMITE_{n}").alias("LIMITE"), F.col(f"STATUS_{n}").alias("STATUS")
                    )
                    for n in ("COMPRAS", "ENGENHARIA")
                )
            )
        ).alias("s"),
    ).select("ID_TRANSACAO", "VALOR_CENTAVOS", "s.*")


def limit_context(classified: DataFrame) -> DataFrame:
    signal = F.col("STATUS_T09") != "ABAIXO_FAIXAS"
    grouped = (
        classified.filter(_known("UG_ID", "FAVORECIDO_ID"))
        .groupBy("UG_ID", "FAVORECIDO_ID", "ANO_TRANSACAO")
        .agg(
            F.count(F.lit(1)).alias("N_COMPRAS"),
            F.count_if(signal).alias("N_SINAIS"),
            F.count_if(F.col("STATUS_T09") == "PROXIMO_LIMITE").alias("N_PROXIMOS"),
            F.count_if(F.col("STATUS_T09") == "ACIMA_AMBOS_CENARIOS").alias("N_ACIMA_AMBOS"),
            F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS"),
            F.coalesce(F.sum(F.when(signal, F.col("VALOR_CENTAVOS"))), F.lit(0)).alias("SINAIS_CENTAVOS"),
            F.max(F.col("VALOR_CENTAVOS") / F.col("LIMITE_COMPRAS")).alias("MAX_RATIO_COMPRAS"),
        )
    )
    return grouped.withColumn("SHARE_SINAIS", x.ratio(F.col("N_SINAIS"), F.col("N_COMPRAS")))
