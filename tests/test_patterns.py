"""Tables from the pattern cube against numpy over the matrix's own rows."""

from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from ledgerlight import model
from ledgerlight.operators import patterns

BANDS = ("1", "2", "3-4")


@pytest.fixture(scope="module")
def rows():
    """Correlated flags; T02 is rare, T03 constant, T06 equals T05."""
    rng = np.random.default_rng(7)
    n = 1500
    base = rng.random((n, 3))
    flags = pd.DataFrame(
        {
            "T01": base[:, 0] < 0.4, "T02": rng.random(n) < 0.01, "T03": np.zeros(n, bool), "T04": base[:, 0] + 0.5 * base[:, 1] < 0.6,
            "T05": base[:, 1] < 0.3, "T06": base[:, 1] < 0.3, "T07": base[:, 1] + base[:, 2] < 0.7,
        }
    ).astype("int32")
    return flags.assign(ANO_TRANSACAO=rng.integers(2013, 2016, n), BANDA_EXPOSICAO=rng.choice(BANDS, n), DECIL_EXPOSICAO=rng.integers(1, 4, n))


def families(rows):
    core = {f: [t for t in m if t in model.TRAILS] for f, m in model.FAMILIES.items()}
    return rows.assign(**{f: rows[m].max(axis=1) for f, m in core.items() if m})


@pytest.fixture(scope="module")
def cube(spark, rows):
    return patterns.pattern_cube(spark.createDataFrame(rows), model.TRAILS, "UG_ANO", "BANDA_EXPOSICAO")


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def phi(a, b):
    return None if a.std() == 0 or b.std() == 0 else pytest.approx(float(np.corrcoef(a, b)[0, 1]), abs=1e-9)


@pytest.mark.parametrize("by,column", [(None, None), ("ANO", "ANO_TRANSACAO"), ("RECORTE", "BANDA_EXPOSICAO")])
def test_pairs_margins_and_eligibility(rows, cube, by, column):
    keys = [by] if by else []
    pairs = table(patterns.overlap(cube, by), *keys, "REGRA_A", "REGRA_B")
    margins = table(patterns.marginality(cube, by), *keys, "REGRA_OU_FAMILIA")
    eligible = table(patterns.eligibility(cube, by), *keys, "REGRA_OU_FAMILIA")
    for value, own in [(None, rows)] if by is None else rows.groupby(column):
        at = (value,) if by else ()
        for a, b in combinations(model.TRAILS, 2):
            got, x, y = pairs[(*at, a, b)], own[a].to_numpy(), own[b].to_numpy()
            assert (got.N_UNIVERSO, got.N_A, got.N_B, got.INTERSECAO, got.A_APENAS, got.B_APENAS, got.NENHUMA, got.UNIAO) == (
                len(own), x.sum(), y.sum(), (x & y).sum(), (x & ~y & 1).sum(), (y & ~x & 1).sum(), ((x | y) == 0).sum(), (x | y).sum(),
            )
            assert got.PHI == phi(x, y)
            assert got.JACCARD == (None if not (x | y).any() else pytest.approx((x & y).sum() / (x | y).sum()))
            assert got.P_B_DADO_A == (None if not x.any() else pytest.approx(y[x == 1].mean()))
        union = own[list(model.TRAILS)].max(axis=1)
        for f in model.TRAILS:
            others = own[[t for t in model.TRAILS if t != f]].max(axis=1)
            m, e = margins[(*at, f)], eligible[(*at, f)]
            assert (m.N_UNIAO_MOTOR, m.N_SINALIZADOS, m.N_EXCLUSIVOS, m.N_UNIAO_SEM_REGRA) == (union.sum(), own[f].sum(), ((own[f] == 1) & (others == 0)).sum(), others.sum())
            assert m.PERDA_UNIDADES_SE_REMOVER == m.N_EXCLUSIVOS and m.ZERO_EXCLUSIVOS == (m.N_EXCLUSIVOS == 0)
            k, n = int(own[f].sum()), len(own)
            status = "SEM_VARIACAO" if k in (0, n) else "SUFICIENTE" if min(k, n - k) >= 30 else "DIAGNOSTICO_ESTATISTICO_INSUFICIENTE"
            assert (e.N_POSITIVOS, e.N_NEGATIVOS, e.ELEGIBILIDADE_DIAGNOSTICO_ESTATISTICO) == (k, n - k, status)


def usable(own):
    return [f for f in model.TRAILS if min(own[f].sum(), (1 - own[f]).sum()) >= 30]


@pytest.mark.parametrize("by", [None, "RECORTE"])
def test_inflation_against_least_squares(rows, cube, by):
    got = table(patterns.inflation(cube, by), *(["RECORTE_VALOR"] if by else []), "REGRA_OU_FAMILIA")
    for value, own in [(None, rows)] if by is None else rows.groupby("BANDA_EXPOSICAO"):
        used = usable(own)
        for f in model.TRAILS:
            row = got[(*((value,) if by else ()), f)]
            assert row.N_VARIAVEIS_ELEGIVEIS_MODELO == len(used)
            if f not in used:
                assert row.VIF is None and row.STATUS_VIF.startswith("NAO_CALCULADO_")
                continue
            x = np.column_stack([np.ones(len(own)), own[[g for g in used if g != f]]])
            left = own[f] - x @ np.linalg.lstsq(x, own[f], rcond=None)[0]
            r2 = 1 - (left**2).sum() / ((own[f] - own[f].mean()) ** 2).sum()
            assert row.R2_AUXILIAR == pytest.approx(r2, abs=1e-9)
            if f in ("T05", "T06"):
                assert row.STATUS_VIF == "DEPENDENCIA_LINEAR_PERFEITA" and row.VIF == float("inf")
            else:
                assert row.VIF == pytest.approx(1 / (1 - r2))


@pytest.mark.parametrize("by", [None, "RECORTE"])
def test_components_against_the_correlation_of_rows(rows, cube, by):
    keys = ["RECORTE_VALOR"] if by else []
    parts, loads = patterns.components(cube, by)
    parts, loads = table(parts, *keys, "COMPONENTE"), table(loads, *keys, "COMPONENTE", "REGRA_OU_FAMILIA")
    conditions = table(patterns.conditions(cube, by), *keys, "COMPONENTE")
    for value, own in [(None, rows)] if by is None else rows.groupby("BANDA_EXPOSICAO"):
        at, used = (value,) if by else (), usable(own)
        r = np.corrcoef(own[used].to_numpy().T)
        values = np.sort(np.linalg.eigvalsh(r))[::-1]
        for k, v in enumerate(values):
            part, condition = parts[(*at, f"PC{k + 1}")], conditions[(*at, f"D{k + 1}")]
            assert part.AUTOVALOR == pytest.approx(max(v, 0), abs=1e-9) and part.VARIANCIA_EXPLICADA == pytest.approx(max(v, 0) / len(used), abs=1e-9)
            assert condition.SINGULAR == (v <= 1e-12) and (condition.SINGULAR or condition.INDICE_CONDICAO == pytest.approx((values[0] / v) ** 0.5))
            weights = np.array([loads[(*at, f"PC{k + 1}", f)].PESO_COMPONENTE for f in used])
            assert r @ weights == pytest.approx(max(v, 0) * weights, abs=1e-8) and weights[np.abs(weights).argmax()] > 0
        assert all(loads[(*at, f"PC{len(used)}", f)].COMUNALIDADE_ACUMULADA == pytest.approx(1) for f in used)


def test_families_are_unions_of_rules(spark, rows, cube):
    alone = patterns.pattern_cube(spark.createDataFrame(families(rows)), ("F1", "F2", "F3", "F4"), "UG_ANO", "BANDA_EXPOSICAO")
    made = cube.grouped({f: m for f, m in model.FAMILIES.items() if f not in ("F5", "F6")})
    assert made.flags == alone.flags and made.kind == "FAMILIA"
    assert sorted(map(tuple, made.counts.collect())) == sorted(map(tuple, alone.counts.collect()))


def test_all_tables_read_each_matrix_once(spark, rows):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows)
    matrix = df.mapInArrow(counted, df.schema)
    tables = patterns.diagnostic_tables(matrix, matrix)
    assert len(tables) == 66
    got = {name: t.collect() for name, t in tables.items()}
    assert read.value == 2 * len(rows)
    assert len(got["overlap_ug_trails_by_year"]) == 3 * 21 and len(got["marginal_supplier_families_by_exposure"]) == 3 * 3
    assert {r.RECORTE_COLUNA for r in got["multicollinearity_ug_families_vif_by_exposure"]} == {"DECIL_EXPOSICAO"}
    assert {r.TIPO for r in got["marginal_ug_families_by_decile"]} == {"TRILHA"}


def test_flags_other_than_0_and_1_are_an_error(spark):
    bad = spark.createDataFrame([(2, 2020, "1")], "T01 int, ANO_TRANSACAO int, BANDA_EXPOSICAO string")
    with pytest.raises(PySparkException, match="0 or 1"):
        patterns.pattern_cube(bad, ["T01"], "u", "BANDA_EXPOSICAO")
    none = spark.createDataFrame([(None, 2020, None)], bad.schema)
    cube = patterns.pattern_cube(none, ["T01"], "u", "BANDA_EXPOSICAO")
    assert patterns.marginality(cube).first().N_SINALIZADOS == 0 and patterns.marginality(cube, "RECORTE").count() == 0
    assert patterns.inflation(cube).first().STATUS_VIF == "NAO_CALCULADO_SEM_VARIACAO" and patterns.conditions(cube).count() == 0
