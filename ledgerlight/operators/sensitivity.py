"""How many signals each rule gives under other thresholds, as one table of scenarios.

A rule's base is read once: its metric is counted by the step of the threshold list that it reaches, and the number at or above each
threshold is a suffix sum of those few counts. Withdrawals are counted by year and number of days, from which every scenario takes its own
quantile of the year.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x
from ..sources import scratch
from . import benford, primary, rules, windows
from .rules import CARD

# The scenarios of each rule's thresholds.
THRESHOLDS = {
    "T03": (2, 3, 4, 5),
    "T04": (2, 3, 4, 5),
    "T06": (0.40, 0.50, 0.60, 0.70, 0.80),
    "T07_DIAS": (3, 5, 10),
    "T07_PERCENTIS": (0.75, 0.80, 0.90, 0.95),
    "T09": (0.80, 0.85, 0.90, 0.95),
}
# Populations of the first-digit diagnostics, by the multiple of cents that they leave out.
POPULATIONS = {
    "A_TODOS_GE10": 0, "B_CENTAVOS_NAO_ZERO": 100, "C_NAO_MULTIPLO_R5": 500, "D_NAO_MULTIPLO_R10": 1000, "E_NAO_MULTIPLO_R100": 10_000,
}
# Parameter, metric and unit of each rule's scenarios.
CONTRACT = {
    "T01": ("definicao_final_semana", "N_SINAIS", "TRANSACOES"),
    "T02": ("codigo_transacao", "N_SINAIS", "TRANSACOES"),
    "T03": ("min_ocorrencias", "N_GRUPOS_SINALIZADOS", "GRUPOS_T03"),
    "T04": ("min_portadores", "N_GRUPOS_SINALIZADOS", "GRUPOS_T04"),
    "T05": ("regra_final_deduplicada", "N_EPISODIOS_FINAIS", "EPISODIOS_T05"),
    "T06": ("top1_share", "N_UG_ANO_SINALIZADOS", "UG_ANO"),
    "T07": ("min_dias_percentil", "N_PORTADOR_ANO_PRIORIZADOS", "PORTADOR_ANO"),
    "T08": ("populacao_sensibilidade_arredondamento", "N_POPULACAO_D12", "TRANSACOES_ANALISADAS_BENFORD"),
    "T09": ("faixa_proximidade", "N_TRANSACOES_PROXIMAS", "TRANSACOES"),
}


def counts_at_or_above(base: DataFrame, value: Column, thresholds: Sequence[float], apart: Column | None = None) -> DataFrame:
    """(LIMIAR, N, N_APART): rows whose value reaches each threshold, and rows that ``apart`` sets apart, which no threshold counts.

    One aggregation into one group per step of the list, then sums over the steps.
    """
    steps = sorted(thresholds)
    levels = F.array(*(F.lit(float(t)) for t in steps))
    own = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    reached = F.size(F.filter(levels, lambda t: value.cast("double") >= t))
    counted = base.groupBy(F.when(own, -1).otherwise(reached).alias("_STEP")).agg(F.count(F.lit(1)).alias("_N"))
    summed = counted.agg(
        *(F.coalesce(F.sum(F.when(F.col("_STEP") > i, F.col("_N"))), F.lit(0)).alias(f"_{i}") for i in range(len(steps))),
        F.coalesce(F.sum(F.when(F.col("_STEP") == -1, F.col("_N"))), F.lit(0)).alias("N_APART"),
    )
    rows = F.array(*(F.struct(F.lit(float(t)).alias("LIMIAR"), F.col(f"_{i}").alias("N")) for i, t in enumerate(steps)))
    return summed.select(F.explode(rows).alias("r"), "N_APART").select("r.LIMIAR", "r.N", "N_APART")


def withdrawal_scenarios(daily: DataFrame, days: Sequence[int], quantiles: Sequence[float], card: str = CARD, comparable: int = 10) -> DataFrame:
    """(DIAS, PERCENTIL, N): cardholder-years with at least so many days and at least the year's quantile of days; few comparable ones don't count."""
    yearly = daily.groupBy("UG_ID", card, "ANO_TRANSACAO").agg(F.count(F.lit(1)).alias("DIAS"))
    counted = yearly.groupBy("ANO_TRANSACAO", "DIAS").agg(F.count(F.lit(1)).alias("N"))  # a few hundred rows a year
    limits = counted.groupBy("ANO_TRANSACAO").agg(
        F.sum("N").alias("_YEAR"), F.percentile(F.col("DIAS").cast("double"), F.array(*map(F.lit, quantiles)), F.col("N")).alias("_Q")
    )
    met = lambda d, i: (F.col("DIAS") >= d) & (F.col("DIAS") >= F.col("_Q")[i])
    cells = [(d, i, q) for d in days for i, q in enumerate(quantiles)]
    summed = counted.join(limits.filter(F.col("_YEAR") >= comparable), "ANO_TRANSACAO").agg(
        *(F.coalesce(F.sum(F.when(met(d, i), F.col("N"))), F.lit(0)).alias(f"_{n}") for n, (d, i, _) in enumerate(cells))
    )
    rows = F.array(*(F.struct(F.lit(d).alias("DIAS"), F.lit(q).alias("PERCENTIL"), F.col(f"_{n}").alias("N")) for n, (d, _, q) in enumerate(cells)))
    return summed.select(F.explode(rows).alias("r")).select("r.*")


def population_scenarios(staged: DataFrame, populations: Mapping[str, int] = POPULATIONS) -> DataFrame:
    """(CENARIO, N, MAD) of two first digits over national purchases, without multiples of a number of cents."""
    v = F.col("VALOR_CENTAVOS")
    own = F.array(*((F.lit(name) if not cents else F.when(v % cents != 0, F.lit(name))) for name, cents in populations.items()))
    rows = staged.filter(x.true("EH_COMPRA_NACIONAL") & (v > 0)).select("VALOR_CENTAVOS", F.explode(F.filter(own, lambda s: s.isNotNull())).alias("CENARIO"))
    found = benford.conformity(benford.digit_table(rows, 2, ["CENARIO"]), 2, ["CENARIO"])
    return found.select("CENARIO", F.col("N_D2").alias("N"), F.col("MAD_D2").alias("MAD"))


def _text(value: float) -> str:
    return f"{value:.2f}" if isinstance(value, float) else str(value)


def _scenarios(rows: DataFrame, trail: str, value: Column, n: Column, control: str, baseline: Column, total: Column | None = None, second=None) -> DataFrame:
    parameter, metric, unit = CONTRACT[trail]
    name, other = second or (None, F.lit(None).cast("double"))
    return rows.select(
        F.lit(trail).alias("TRILHA"), F.lit(parameter).alias("PARAMETRO"), value.alias("VALOR_CENARIO"), F.lit(metric).alias("METRICA"),
        F.lit(unit).alias("UNIDADE_CONTAGEM"), n.cast("bigint").alias("VALOR_METRICA"), F.lit(name).cast("string").alias("METRICA_SECUNDARIA"),
        other.cast("double").alias("VALOR_METRICA_SECUNDARIA"), (n if total is None else total).cast("bigint").alias("N_SINAIS_TOTAL_CENARIO"),
        F.lit(control != "DIAGNOSTICO_NAO_PARAMETRO").alias("COMPARAVEL_COM_BASELINE"), F.lit(control).alias("TIPO_CONTROLE"), baseline.alias("BASELINE"),
    )


def contract(
    staged: DataFrame, limits: DataFrame, card: str = CARD, settings: Mapping[str, dict] | None = None, thresholds: Mapping[str, Sequence] = THRESHOLDS, dealt: bool = False
) -> DataFrame:
    """All scenarios of all nine rules with the baseline's number of signals; VARIACAO_SINAIS_N is null where the two don't compare.

    ``settings`` gives the baseline's thresholds, as for ``primary_outputs``; ``thresholds`` the scenarios'. ``dealt``: whether the fact is dealt by unit and supplier.
    """
    own = {**dict.fromkeys(model.EVIDENCE, {}), **(settings or {})}
    near = float(own["T09"].get("near", 0.90))
    classified = rules.classify_limits(staged, limits, near)
    concentration = scratch.written(rules.concentration(staged), "concentration")
    daily = scratch.written(rules.daily_withdrawals(staged, card), "withdrawals")
    found = primary.shared_repetitions(staged, card, own, dealt)
    forensic = {"least": 300, "formal": 1000, "years": model.COMPLETE_YEARS, **own["T08"]}
    outputs = {  # as many rows as the rules' signals, without evidence that isn't counted
        "T01": staged.filter(rules.on_weekend()),
        "T02": staged.filter(rules.has_code()),
        "T03": rules.exact_repetition(staged, card, **own["T03"], found=found),
        "T04": rules.multi_cardholder(staged, card, **own["T04"], found=found),
        "T05": rules.strongest_windows(rules.passing_windows(windows.recurring_purchases(staged, card), **{k: v for k, v in own["T05"].items() if k != "tolerance"}, dealt=dealt)),
        "T06": rules.concentration_signals(concentration, **own["T06"]),
        "T07": rules.withdrawal_flags(daily, card, **own["T07"]),
        "T08": benford.benford_flags(staged, forensic["least"], forensic["formal"], forensic["years"]),
        "T09": classified.filter("STATUS_T09 <> 'ABAIXO_FAIXAS'"),
    }
    counted = reduce(
        DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("N_SINAIS_BASELINE")).select(F.lit(t).alias("TRILHA"), "N_SINAIS_BASELINE") for t, df in outputs.items())
    )
    base = lambda t: counted.filter(F.col("TRILHA") == t)
    n, limit = F.col("N"), F.col("LIMIAR")

    def stepped(trail: str, df: DataFrame, value: Column, usual: float, **more) -> DataFrame:
        steps = thresholds[trail]
        name = F.element_at(F.create_map(*(c for t in steps for c in (F.lit(float(t)), F.lit(_text(t))))), limit)
        return _scenarios(counts_at_or_above(df, value, steps, more.pop("apart", None)), trail, name, n, "EXPERIMENTAL", F.abs(limit - usual) < 1e-9, **more)

    suppliers = {"purchases": 20, "suppliers": 3, "coverage": 0.80, **{k: v for k, v in own["T06"].items() if k != "levels"}}
    share = own["T06"].get("levels", (0.50,))[0]
    eligible = concentration.filter(
        (F.col("N_COMPRAS") >= suppliers["purchases"]) & (F.col("N_FORNECEDORES") >= suppliers["suppliers"]) & (F.col("COBERTURA") >= suppliers["coverage"])
    )
    days, quantile = own["T07"].get("days", 3), own["T07"].get("quantile", 0.9)
    withdrawals = withdrawal_scenarios(daily, thresholds["T07_DIAS"], thresholds["T07_PERCENTIS"], card, own["T07"].get("comparable", 10))
    fixed = F.col("STATUS_COMPRAS").isin("NO_LIMITE", "ACIMA_LIMITE") | F.col("STATUS_ENGENHARIA").isin("NO_LIMITE", "ACIMA_LIMITE")
    nearest = F.greatest(F.col("VALOR_CENTAVOS") / F.col("LIMITE_COMPRAS"), F.col("VALOR_CENTAVOS") / F.col("LIMITE_ENGENHARIA"))
    t05 = {"days": 30, "least": 5, "cards": 2, "max_cv": 0.20, **own["T05"]}
    rule = f"{t05['days']}d|N>={t05['least']}|port>={t05['cards']}|CV<={t05['max_cv']:.2f}"
    signals, yes = F.col("N_SINAIS_BASELINE"), F.lit(True)
    parts = [
        _scenarios(base("T01"), "T01", F.lit("SABADO_DOMINGO"), signals, "BLOQUEADO", yes),
        _scenarios(base("T02"), "T02", F.lit(model.INSTALMENT), signals, "BLOQUEADO", yes),
        stepped("T03", outputs["T03"], n, own["T03"].get("least", 2)),
        stepped("T04", outputs["T04"], F.col("N_PORTADORES"), own["T04"].get("levels", (2,))[0]),
        _scenarios(base("T05"), "T05", F.lit(rule), signals, "BASELINE_METODOLOGICA", yes),
        stepped("T06", eligible, F.col("TOP1_SHARE_VALOR"), share),
        _scenarios(
            withdrawals, "T07", F.concat(F.col("DIAS").cast("string"), F.lit("|"), F.format_number("PERCENTIL", 2)), n, "EXPERIMENTAL",
            (F.col("DIAS") == days) & (F.abs(F.col("PERCENTIL") - quantile) < 1e-9),
        ),
        _scenarios(
            population_scenarios(staged), "T08", F.col("CENARIO"), n, "DIAGNOSTICO_NAO_PARAMETRO", F.col("CENARIO") == next(iter(POPULATIONS)),
            total=F.lit(None), second=("MAD_D12", F.col("MAD")),
        ),
        stepped("T09", classified, nearest, near, apart=fixed, total=n + F.col("N_APART"), second=("N_FIXOS_NO_LIMITE_OU_ACIMA", F.col("N_APART"))),
    ]
    joined = reduce(DataFrame.unionByName, parts).join(F.broadcast(counted), "TRILHA")
    return joined.withColumn(
        "VARIACAO_SINAIS_N", F.when(F.col("COMPARAVEL_COM_BASELINE"), F.col("N_SINAIS_TOTAL_CENARIO") - F.col("N_SINAIS_BASELINE"))
    )
