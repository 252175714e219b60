"""The master table of signals, one contract for all nine rules, and its bridge to transactions."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x
from ..sources import scratch
from . import benford, rules
from .rules import CARD

SIGNAL_COLUMNS = (
    "ID_SINAL", "CODIGO_TRILHA", "VERSAO_REGRA", "NIVEL_TRIAGEM", "CODIGO_UG", "CHAVE_ENTIDADE", "PERIODO_INICIAL", "PERIODO_FINAL",
    "QTD_TRANSACOES", "VALOR_TOTAL_CENTAVOS", "EVIDENCIA_JSON", "PARAMETROS_JSON", "FUNDAMENTO", "LIMITACOES", "TEXTO_CIDADAO",
)


def parameters(settings: Mapping[str, dict] | None = None) -> dict[str, dict]:
    """Each rule's thresholds by their published names: the defaults, or those of ``settings`` as ``primary_outputs`` takes them."""
    own = {t: dict((settings or {}).get(t, {})) for t in (*model.TRAILS, *model.CONTEXTS)}
    t03, t04, t05, t06, t07, t08, t09 = (own[t] for t in ("T03", "T04", "T05", "T06", "T07", "T08", "T09"))
    cards, shares, years = t04.get("levels", (2, 3, 5)), t06.get("levels", (0.50, 0.70, 0.80)), t08.get("years", model.COMPLETE_YEARS)
    return {
        "T01": {"regra": "sábado ou domingo"},
        "T02": {"codigo_exato": model.INSTALMENT},
        "T03": {"min_ocorrencias": t03.get("least", 2), "reforcado_ocorrencias": t03.get("reinforced", 3)},
        "T04": {"min_portadores": cards[0], "reforcado_portadores": cards[1], "muito_elevado_portadores": cards[2]},
        "T05": {
            "min_transacoes": t05.get("least", 5),
            "min_portadores": t05.get("cards", 2),
            "janela_dias": t05.get("days", 30),
            "cv_base": t05.get("max_cv", 0.20),
            "cv_reforcado": 0.10,
        },
        "T06": {
            "min_compras_identificadas": t06.get("purchases", 20),
            "min_fornecedores": t06.get("suppliers", 3),
            "cobertura_min": t06.get("coverage", 0.80),
            "share_base": shares[0],
            "share_reforcado": shares[1],
            "share_muito_elevado": shares[2],
        },
        "T07": {
            "min_saques_dia": 2,
            "reforcado_saques_dia": 3,
            "min_dias_recorrencia": t07.get("days", 3),
            "percentil_priorizacao": t07.get("quantile", 0.90),
            "min_comparaveis_ano": t07.get("comparable", 10),
        },
        "T08": {
            "min_n_nao_aplicar": t08.get("least", 300),
            "min_n_formal": t08.get("formal", 1000),
            "min_ugs_comparaveis": 10,
            "anos_completos_inicio": years[0],
            "anos_completos_fim": years[1],
        },
        "T09": {"faixa_inferior": t09.get("near", 0.90), "faixa_superior": 1.0, "modo": "CENARIOS_PARALELOS_SEM_CATEGORIA"},
    }


def master_signals(outputs: Mapping[str, DataFrame], settings: Mapping[str, dict] | None = None, card: str = CARD, places: int | None = None) -> DataFrame:
    """All signals of ``primary_outputs`` under the fifteen columns of ``SIGNAL_COLUMNS``.

    Evidence is a JSON object per row, parameters one per rule. ``places`` rounds the evidence's fractions to decimals; without it they're doubles.
    A rule without signals adds no rows; rows keep a null unit, supplier or value.
    """
    given = parameters(settings)
    years = (given["T08"]["anos_completos_inicio"], given["T08"]["anos_completos_fim"])

    def number(c: str | Column) -> Column:
        c = (F.col(c) if isinstance(c, str) else c).cast("double")
        return c if places is None else F.round(c, places).cast(f"decimal(28,{places})")

    reais = lambda c: number(F.col(c) / 100)
    status = x.period_status(F.col("ANO_TRANSACAO"), years=years)
    day, year = [F.col("DATA_DT")] * 2, [F.make_date("ANO_TRANSACAO", F.lit(m), F.lit(d)) for m, d in ((1, 1), (12, 31))]
    one = F.lit(1)
    # id, level, entity, period, number of transactions, value, evidence
    shapes = {
        "T01": ("ID_SINAL", None, "FAVORECIDO_ID", day, one, "VALOR_CENTAVOS", {
            "dia_semana": F.element_at(F.array(*map(F.lit, model.WEEKDAYS)), F.weekday("DATA_DT") + 1), "transacao": F.col("TRANSAÇÃO"), "id_transacao": F.col("ID_TRANSACAO"),
        }),
        "T02": ("ID_SINAL", None, "FAVORECIDO_ID", day, one, "VALOR_CENTAVOS", {"transacao": F.col("TRANSAÇÃO"), "id_transacao": F.col("ID_TRANSACAO")}),
        "T03": ("ID_GRUPO", "NIVEL_TRIAGEM", "FAVORECIDO_ID", day, "N", "TOTAL_CENTAVOS", {"portador": F.col(card), "valor_unitario": reais("VALOR_CENTAVOS"), "ocorrencias": F.col("N")}),
        "T04": ("ID_GRUPO", "NIVEL_TRIAGEM", "FAVORECIDO_ID", day, "N", "TOTAL_CENTAVOS", {"n_portadores": F.col("N_PORTADORES"), "valor_unitario": reais("VALOR_CENTAVOS")}),
        "T05": ("ID_EPISODIO", "NIVEL_TRIAGEM", "FAVORECIDO_ID", [F.col("INICIO"), F.col("FIM")], "N", "TOTAL_CENTAVOS", {
            "n_portadores": F.col("N_PORTADORES"), "cv": number("CV"), "share_dentro_faixa_mediana": number("SHARE_MEDIANA"),
            "percentil_materialidade_ano": number("PERCENTIL_VALOR_ANO"), "faixa_materialidade": F.col("MATERIALIDADE"),
            "min_centavos": F.col("MIN_CENTAVOS"), "max_centavos": F.col("MAX_CENTAVOS"),
        }),
        "T06": ("ID_SINAL", "NIVEL_TRIAGEM", "TOP1_FAVORECIDO_ID", year, "N_COMPRAS_IDENTIFICADAS", "TOTAL_IDENTIFICADO_CENTAVOS", {
            "top1_share": number("TOP1_SHARE_VALOR"), "top1_share_qtd": number("TOP1_SHARE_QTD"), "top5_share": number("TOP5_SHARE_VALOR"), "hhi": number("HHI"), "cobertura_valor": number("COBERTURA"),
        }),
        "T07": ("ID_SINAL", None, card, year, "N_SAQUES", "TOTAL_CENTAVOS", {
            "n_dias_multisaque": F.col("N_DIAS"), "n_saques_em_episodios": F.col("N_SAQUES"), "percent_rank_dias": number("PERCENT_RANK_ANO"), "n_comparaveis": F.col("N_COMPARAVEIS"), "status_periodo": status,
        }),
        "T08": ("ID_SINAL", None, F.concat(F.lit("UG:"), "UG_ID"), year, "N_D2", None, {
            "mad_d12": number("MAD_D2"), "percent_rank": number("PERCENTIL_MAD"), "n_ugs_comparaveis": F.col("N_COMPARAVEIS"), "ano": F.col("ANO_TRANSACAO"),
        }),
        "T09": ("ID_SINAL", "NIVEL_TRIAGEM", "FAVORECIDO_ID", day, one, "VALOR_CENTAVOS", {
            "status_t09": F.col("STATUS_T09"), "status_compras": F.col("STATUS_COMPRAS"), "status_engenharia": F.col("STATUS_ENGENHARIA"),
            "ratio_compras": number(F.col("VALOR_CENTAVOS") / F.col("LIMITE_COMPRAS")), "ratio_engenharia": number(F.col("VALOR_CENTAVOS") / F.col("LIMITE_ENGENHARIA")),
            "limite_pv_compras": reais("LIMITE_COMPRAS"), "limite_pv_engenharia": reais("LIMITE_ENGENHARIA"), "status_periodo": status,
        }),
    }
    column = lambda c: F.col(c) if isinstance(c, str) else c

    def part(trail: str, signals: DataFrame) -> DataFrame:
        key, level, entity, (first, last), n, value, evidence = shapes[trail]
        basis, limits, citizen = model.SIGNAL_TEXTS[trail]
        values = (
            F.col(key), F.lit(trail), F.lit(model.RULES_VERSION), F.lit("ATENCAO") if level is None else F.col(level), F.col("UG_ID"), column(entity).cast("string"), first, last,
            column(n).cast("bigint"), F.lit(None).cast("bigint") if value is None else F.col(value),
            F.to_json(F.struct(*(c.alias(name) for name, c in evidence.items())), {"ignoreNullFields": "false"}),
            F.lit(json.dumps(given[trail], ensure_ascii=False)), F.lit(basis), F.lit(limits), F.lit(citizen),
        )
        return signals.select(*(c.alias(name) for name, c in zip(SIGNAL_COLUMNS, values, strict=True)))

    return reduce(DataFrame.unionByName, (part(t, df) for t, df in outputs.items()))


def withdrawal_links(staged: DataFrame, card: str = CARD, **own) -> DataFrame:
    """(ID_SINAL, ID_TRANSACAO) of the withdrawals of the days with several in the years that T07 puts first. These days are few and written, so that their size is known before rows meet them."""
    daily = scratch.written(rules.daily_withdrawals(staged, card).select("UG_ID", card, "ANO_TRANSACAO", "DATA_DT", "N", "TOTAL_CENTAVOS"), "days")
    first = rules.withdrawal_flags(daily, card, **own).withColumn("ID_SINAL", x.signal_id("T07", "UG_ID", card, "ANO_TRANSACAO"))
    keys = ["UG_ID", card, "DATA_DT"]
    days = scratch.written(daily.join(first, ["UG_ID", card, "ANO_TRANSACAO"]).select(*keys, "ID_SINAL"), "linked_days")
    return rules.effective_withdrawals(staged, card).join(days, keys).select("ID_SINAL", "ID_TRANSACAO")


_STATUSES = rules.LIMIT_STATUSES
#: The pairs of T09's statuses in the order of their marks.
_PAIRS = list(product(_STATUSES, _STATUSES))
#: The marks of each rule whose signals are transactions. The first pair, of which both are below, is no signal.
_MARKS = {"T01": [0], "T02": [1], "T09": list(range(3, 2 + len(_PAIRS)))}


def _as_it_is(c: Column) -> Column:
    return c


def direct_marks(staged: DataFrame, limits: DataFrame, near: float = 0.90, parts: int | None = None, named: Callable[[Column], Column] = _as_it_is) -> DataFrame:
    """(ID_TRANSACAO, MARCAS): of the transactions that are signals of T01, T02 or T09 themselves, a row per id with a bit per link. So links are distinct before their texts are made, and only ids are moved, to ``parts`` parts."""
    value = F.col("VALOR_CENTAVOS")
    national = x.true("EH_COMPRA_NACIONAL") & (value > 0) & F.col("ANO_TRANSACAO").isNotNull()
    dated = staged.join(F.broadcast(limits), national & F.col("DATA_DT").between(F.col("INICIO"), F.col("FIM")), "left")
    pair = len(_STATUSES) * rules.limit_place(value, F.col("LIMITE_COMPRAS"), near) + rules.limit_place(value, F.col("LIMITE_ENGENHARIA"), near)
    bits = F.array(F.lit(0), *(F.lit(1 << n) for n in _MARKS["T09"]))
    found = [F.when(rules.on_weekend(), 1).otherwise(0), F.when(rules.has_code(), 2).otherwise(0), F.when(F.col("INICIO").isNotNull(), F.element_at(bits, pair + 1)).otherwise(0)]
    marked = dated.select(named(F.col("ID_TRANSACAO")).alias("ID_TRANSACAO"), reduce(Column.bitwiseOR, found).alias("MARCAS")).filter("MARCAS <> 0")
    placed = marked if parts is None else marked.repartition(parts, "ID_TRANSACAO")
    return placed.groupBy("ID_TRANSACAO").agg(F.bit_or("MARCAS").alias("MARCAS"))


def direct_links(marks: DataFrame) -> DataFrame:
    """The rows of ``direct_marks`` under the bridge's columns, a row per link."""
    trail = {n: t for t, ns in _MARKS.items() for n in ns}
    each = F.explode(F.array(*(F.when(F.col("MARCAS").bitwiseAND(F.lit(1 << n)) != 0, n) for n in trail)))
    links = marks.select("ID_TRANSACAO", each.alias("_N")).filter("_N IS NOT NULL")
    n = F.col("_N")
    by_trail = lambda made: F.when(n == 0, made["T01"]).when(n == 1, made["T02"]).otherwise(made["T09"])
    status = [F.element_at(F.array(*(F.lit(p[k]) for p in _PAIRS)), F.greatest(n - 1, F.lit(1))) for k in (0, 1)]
    ids = {"T01": x.signal_id("T01", "ID_TRANSACAO"), "T02": x.signal_id("T02", "ID_TRANSACAO"), "T09": x.signal_id("T09", "ID_TRANSACAO", *status)}
    return links.select(
        by_trail({t: F.lit(t) for t in _MARKS}).alias("CODIGO_TRILHA"), by_trail(ids).alias("ID_SINAL"), "ID_TRANSACAO", by_trail({t: F.lit(model.ROLES[t]) for t in _MARKS}).alias("PAPEL_NO_SINAL")
    )


def group_links(
    staged: DataFrame,
    drill: DataFrame | None = None,
    card: str = CARD,
    settings: Mapping[str, dict] | None = None,
    dealt: bool = False,
    named: Callable[[Column], Column] = _as_it_is,
) -> DataFrame:
    """The bridge's rows of T03 to T08, whose signals hold several transactions, from what decides a link alone: no table of signals is made."""
    own = {**dict.fromkeys((*model.TRAILS, *model.CONTEXTS), {}), **(settings or {})}
    recurring = {k: v for k, v in own["T05"].items() if k != "tolerance"}
    several = rules.repetition_links(staged, card, own["T03"].get("least", 2), own["T04"].get("levels", (2, 3, 5)), dealt)
    top = scratch.written(rules.concentration_signals(rules.top_suppliers(rules.supplier_years(staged)), **own["T06"]), "concentrated")
    found = {
        "T05": rules.recurrence_links(staged, card, **recurring, dealt=dealt),
        "T06": rules.concentration_rows(staged, top),
        "T07": withdrawal_links(staged, card, **own["T07"]),
    }
    if drill is not None:
        forensic = {"least": 300, "formal": 1000, "years": model.COMPLETE_YEARS, **own["T08"]}
        units = benford.benford_flags(staged, forensic["least"], forensic["formal"], forensic["years"])
        units = scratch.written(units.select("UG_ID", "ANO_TRANSACAO", benford.deviation_id().alias("ID_SINAL")), "deviating")
        found["T08"] = drill.join(units, ["UG_ID", "ANO_TRANSACAO"])
    parts = [df.select(F.lit(t).alias("CODIGO_TRILHA"), F.col(next(c for c in model.EVIDENCE_IDS if c in df.columns)).alias("ID_SINAL"), "ID_TRANSACAO") for t, df in found.items()]
    role = reduce(lambda done, t: done.when(F.col("CODIGO_TRILHA") == t, model.ROLES[t]), list(found), F.when(F.col("CODIGO_TRILHA").isin("T03", "T04"), model.ROLES["T03"]))
    links = reduce(DataFrame.unionByName, parts, several).withColumn("ID_TRANSACAO", named(F.col("ID_TRANSACAO")))
    return links.distinct().withColumn("PAPEL_NO_SINAL", role)


def master_bridge(
    staged: DataFrame,
    limits: DataFrame,
    drill: DataFrame | None = None,
    card: str = CARD,
    settings: Mapping[str, dict] | None = None,
    dealt: bool = False,
    parts: int | None = None,
    named: Callable[[Column], Column] = _as_it_is,
) -> tuple[DataFrame, DataFrame]:
    """The bridge of all nine rules in two tables, for ``bridge`` and ``summary_of``: ``direct_marks`` and ``group_links``.

    T08 is linked to the transactions of ``drill`` (UG_ID, ANO_TRANSACAO, ID_TRANSACAO) in its unit-years, and to none
    without it. ``settings`` as ``primary_outputs`` takes them; ``dealt``: whether the fact is dealt by unit and supplier; ``parts`` as of ``direct_marks``.
    ``named`` makes an id's text where the fact keeps ID_TRANSACAO in another form; only links get it. Transactions with a null id are left out by no rule.
    """
    return direct_marks(staged, limits, **(settings or {}).get("T09", {}), parts=parts, named=named), group_links(staged, drill, card, settings, dealt, named)


def bridge(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """(CODIGO_TRILHA, ID_SINAL, ID_TRANSACAO, PAPEL_NO_SINAL) of all nine rules, distinct."""
    return direct_links(marks).unionByName(groups)


def summary_of(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """``bridge_summary`` of ``bridge``. A direct link is a bit of its transaction and a signal of its own, so these are counted without their texts; a null and an empty id name the same signal."""
    unnamed = F.coalesce(F.col("ID_TRANSACAO"), F.lit("")) == ""

    def counted(trail: str, marks: list[int]) -> Column:
        own = F.col("MARCAS").bitwiseAND(F.lit(sum(1 << n for n in marks)))
        n, once = F.bit_count(own).cast("bigint"), F.bit_count(F.bit_or(F.when(unnamed, own))).cast("bigint")
        some = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        signals = some(F.sum(F.when(~unnamed, n))) + some(once)
        values = {"N_VINCULOS": some(F.sum(n)), "N_SINAIS": signals, "N_TRANSACOES": F.count_if((own != 0) & F.col("ID_TRANSACAO").isNotNull())}
        return F.struct(F.lit(trail).alias("CODIGO_TRILHA"), F.lit(model.ROLES[trail]).alias("PAPEL_NO_SINAL"), *(c.alias(k) for k, c in values.items()))

    direct = marks.agg(F.array(*(counted(t, ns) for t, ns in _MARKS.items())).alias("_EACH")).select(F.inline("_EACH")).filter("N_VINCULOS > 0")
    return direct.unionByName(bridge_summary(groups))


def bridge_summary(bridge: DataFrame) -> DataFrame:
    """Links, distinct signals and distinct transactions by rule."""
    return bridge.groupBy("CODIGO_TRILHA", "PAPEL_NO_SINAL").agg(
        F.count(F.lit(1)).alias("N_VINCULOS"), F.count_distinct("ID_SINAL").alias("N_SINAIS"), F.count_distinct("ID_TRANSACAO").alias("N_TRANSACOES")
    )
