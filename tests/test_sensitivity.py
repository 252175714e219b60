"""Scenario counts against loops over the rows."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerlight.operators import rules, sensitivity
from ledgerlight.plans.adapters import TEST_LIMITS, both
from ledgerlight.plans.governance_queries import SETTINGS
from ledgerlight.sources import scratch


def test_steps_count_what_reaches_each_threshold(spark):
    rng = np.random.default_rng(2)
    values = [None, *rng.random(300).tolist(), 0.5, 0.75]
    rows = spark.createDataFrame([(v, i % 7 == 0) for i, v in enumerate(values)], "v double, a boolean")
    got = {r.LIMIAR: (r.N, r.N_APART) for r in sensitivity.counts_at_or_above(rows, F.col("v"), (0.75, 0.5, 2), F.col("a")).collect()}
    kept = [v for i, v in enumerate(values) if i % 7 and v is not None]
    apart = sum(i % 7 == 0 for i in range(len(values)))
    assert got == {t: (sum(v >= t for v in kept), apart) for t in (0.5, 0.75, 2.0)}
    none = sensitivity.counts_at_or_above(rows.filter("false"), F.col("v"), (1,)).collect()
    assert [(r.LIMIAR, r.N, r.N_APART) for r in none] == [(1.0, 0, 0)]


def test_withdrawals_take_each_scenarios_own_quantile(spark):
    rng = np.random.default_rng(5)
    rows = []
    for year, cards in ((2019, 40), (2020, 25), (2021, 9)):
        for c in range(cards):
            rows += [("u", f"c{c}", year, date(year, 1, 1) + timedelta(days=n)) for n in range(int(rng.integers(1, 14)))]
    daily = spark.createDataFrame(rows, "UG_ID string, PORTADOR_ID string, ANO_TRANSACAO int, DATA_DT date")
    got = {(r.DIAS, r.PERCENTIL): r.N for r in sensitivity.withdrawal_scenarios(daily, (3, 10), (0.75, 0.9)).collect()}
    yearly = pd.DataFrame(rows, columns=["u", "c", "y", "d"]).groupby(["y", "c"]).size()
    for (days, q), n in got.items():
        want = 0
        for _, own in yearly.groupby("y"):
            if len(own) >= 10:
                want += int(((own >= days) & (own >= own.quantile(q))).sum())
        assert n == want
    assert len(got) == 4 and sum(got.values()) > 0


def test_populations_leave_out_multiples(spark):
    cents = [1_000, 1_250, 1_500, 2_000, 2_001, 10_000, 999, 30_000]
    rows = spark.createDataFrame([(c, True) for c in cents] + [(1_111, False)], "VALOR_CENTAVOS bigint, EH_COMPRA_NACIONAL boolean")
    got = {r.CENARIO: r.N for r in sensitivity.population_scenarios(rows).collect()}
    assert got == {
        name: sum(c >= 1_000 and (not m or c % m != 0) for c in cents) for name, m in sensitivity.POPULATIONS.items()
    }


def test_contract_makes_no_evidence(spark, monkeypatch):
    fact, limits = both(spark, "/root/testdata/sf0.001"), rules.limits_table(spark, TEST_LIMITS)
    names, written = [], scratch.written
    monkeypatch.setattr(scratch, "written", lambda df, name: names.append(name) or written(df, name))
    sensitivity.contract(fact, limits, settings=SETTINGS)
    assert sorted(names) == ["concentration", "digits", "repetitions", "withdrawals"]
