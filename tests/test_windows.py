"""Windows over days against a loop over purchases."""

from collections import defaultdict
from datetime import date, timedelta

import numpy as np
import pytest

from ledgerlight.operators import rules, windows

FACT = (
    "UG_ID string, FAVORECIDO_ID string, ANO_TRANSACAO int, PORTADOR_ID string, DATA_DT date, VALOR_CENTAVOS bigint, ID_TRANSACAO string, "
    "EH_COMPRA_NACIONAL boolean, FAVORECIDO_IDENTIFICADO boolean"
)


@pytest.fixture(scope="module")
def purchases():
    """Two suppliers of a unit, one of them busy, over a year; amounts near 100.00."""
    rng = np.random.default_rng(11)
    rows = []
    for n in range(700):
        day = date(2020, 1, 1) + timedelta(days=int(rng.choice([rng.integers(0, 366), rng.integers(40, 60)])))
        rows.append(("u", "f" if n % 5 else "g", 2020, f"c{rng.integers(0, 9)}", day, int(10_000 * rng.lognormal(0, 0.15)), str(n), True, True))
    rows += [rows[0][:6] + ("t1", True, True), ("u", "f", 2020, None, date(2020, 2, 1), 10_000, "t2", True, True)]
    rows += [("u", "f", 2020, "c1", date(2020, 2, 1), 10_000, "t3", False, True), ("u", "h", 2020, "c1", date(2020, 2, 1), 1 << 33, "t4", True, True)]
    return rows


@pytest.fixture(scope="module")
def fact(spark, purchases):
    return spark.createDataFrame(purchases, FACT)


def plain_windows(purchases, length):
    groups = defaultdict(list)
    for u, f, y, c, d, v, i, national, _ in purchases:
        if national and c is not None:
            groups[u, f, y].append((d, c, v, i))
    out = {}
    for key, rows in groups.items():
        for start in {d for d, *_ in rows}:
            own = [r for r in rows if start <= r[0] <= start + timedelta(days=length)]
            v = np.array([r[2] for r in own], dtype=float)
            out[(*key, start)] = {
                "FIM": max(r[0] for r in own), "N": len(own), "N_PORTADORES": len({r[1] for r in own}), "TOTAL_CENTAVOS": int(v.sum()),
                "MIN_CENTAVOS": v.min(), "MAX_CENTAVOS": v.max(), "CV": v.std() / v.mean(), "values": v, "ids": {r[3] for r in own},
            }
    return out


def test_every_length_at_once(fact, purchases):
    rows = windows.recurring_purchases(fact, "PORTADOR_ID")
    got = windows.window_metrics(rows, (3, 15, 30, 366)).collect()
    for length in (3, 15, 30, 366):
        want = plain_windows(purchases, length)
        own = {(r.UG_ID, r.FAVORECIDO_ID, r.ANO_TRANSACAO, r.INICIO): r for r in got if r.JANELA_DIAS == length}
        assert own.keys() == want.keys()
        for key, w in want.items():
            row = own[key]
            assert (row.FIM, row.N, row.N_PORTADORES, row.TOTAL_CENTAVOS, row.MIN_CENTAVOS, row.MAX_CENTAVOS) == tuple(
                w[k] for k in ("FIM", "N", "N_PORTADORES", "TOTAL_CENTAVOS", "MIN_CENTAVOS", "MAX_CENTAVOS")
            )
            assert row.CV == pytest.approx(w["CV"], abs=1e-12)


def test_equal_values_do_not_vary(spark):
    rows = [("u", "f", 2020, f"c{n}", date(2020, 1, 1 + n), 999_999_999_999, str(n), True, True) for n in range(9)]
    metrics = windows.window_metrics(windows.recurring_purchases(spark.createDataFrame(rows, FACT), "PORTADOR_ID"), [30])
    assert {r.CV for r in metrics.collect()} == {0.0}


def test_candidates_have_quantiles_and_rows(fact, purchases):
    got = rules.recurrence_windows(fact, days=10, least=4, cards=3, max_cv=0.15, tolerance=0.1).collect()
    want = {k: w for k, w in plain_windows(purchases, 10).items() if w["N"] >= 4 and w["N_PORTADORES"] >= 3 and w["CV"] <= 0.15}
    assert len(want) > 20 and {(r.UG_ID, r.FAVORECIDO_ID, r.ANO_TRANSACAO, r.INICIO) for r in got} == want.keys()
    for r in got:
        v = want[r.UG_ID, r.FAVORECIDO_ID, r.ANO_TRANSACAO, r.INICIO]["values"]
        q1, middle, q3 = np.quantile(v, (0.25, 0.5, 0.75))
        assert (r.Q1, r.MEDIANA, r.Q3, r.IQR) == pytest.approx((q1, middle, q3, q3 - q1))
        assert r.SHARE_MEDIANA == pytest.approx((np.abs(v - middle) <= 0.1 * middle).mean())
    episodes = rules.recurrence_episodes(rules.recurrence_windows(fact, days=10, least=4, cards=3, max_cv=0.15))
    found = defaultdict(set)
    for r in rules.recurrence_rows(fact, episodes, days=10).collect():
        found[r.ID_EPISODIO].add(r.ID_TRANSACAO)
    chosen = episodes.collect()
    assert found == {e.ID_EPISODIO: want[e.UG_ID, e.FAVORECIDO_ID, e.ANO_TRANSACAO, e.INICIO]["ids"] for e in chosen} and chosen


def test_no_join_key_holds_more_than_a_bucket(fact):
    rows = windows.recurring_purchases(fact, "PORTADOR_ID")
    kept = windows.window_metrics(rows, [30]).select(*windows.KEYS, "INICIO", "FIM")
    plan = windows.inside(kept, rows, "_DAY", 31)._jdf.queryExecution().optimizedPlan().toString()
    assert "_BUCKET" in next(line for line in plan.splitlines() if "Join Inner" in line)


def test_grid_takes_the_best_window_of_each_supplier(fact, purchases):
    lengths, least, cards, variations = (5, 20), (3, 60), (2, 3), (0.1, 0.2)
    metrics = windows.window_metrics(windows.recurring_purchases(fact, "PORTADOR_ID"), lengths)
    got = windows.calibration_grid(metrics, lengths, least, cards, variations).collect()
    assert len(got) == 16
    for r in got:
        best = {}
        for (u, f, y, start), w in plain_windows(purchases, r.JANELA_DIAS).items():
            if w["N"] >= r.MIN_N and w["N_PORTADORES"] >= r.MIN_P and w["CV"] <= r.MAX_CV:
                key = (-w["N"], -w["N_PORTADORES"], w["CV"], -w["TOTAL_CENTAVOS"], start)
                best[u, f, y] = min(best.get((u, f, y), key), key)
        assert r.N_GRUPOS == len(best)
        assert r.TRANSACOES_REPRESENTATIVAS == (-sum(b[0] for b in best.values()) if best else None)
        assert r.CV_MEDIANO == (pytest.approx(float(np.median([b[2] for b in best.values()]))) if best else None)
