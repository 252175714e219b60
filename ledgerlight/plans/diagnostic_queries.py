"""Diagnostics of complete years from the pattern cubes, with DuckDB counterparts that count the matrices' rows."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import model
from ..operators import governance, linalg, patterns, primary, rules, sensitivity
from .adapters import BOTH_SQL, TEST_LIMITS, dealt, events
from .governance_queries import _REPEATABLE, _TRAILS_SQL, FLAGS, FLAGS_SQL, SETTINGS, UNIT_FLAGS, _body, _supplier_matrix, _unit_matrix
from .rule_queries import EV, LI, T05_EPISODES_SQL, T06_SQL, T07_SQL, T09_SQL, _benford_sql, r

#: The test tables' years that count as complete.
YEARS = (1993, 1997)
#: Source, flags and stratum of each cube in SQL.
_CUBES = {
    "supplier_trails": ("sy", FLAGS, "BANDA_EXPOSICAO"),
    "supplier_families": ("sy", ["F1", "F2", "F3"], "BANDA_EXPOSICAO"),
    "ug_trails": ("uy", UNIT_FLAGS, "DECIL_EXPOSICAO"),
    "ug_families": ("uy", ["F1", "F2", "F3", "F4"], "DECIL_EXPOSICAO"),
}
_BASE = f"""{FLAGS_SQL}, sy AS MATERIALIZED (SELECT * FROM sm WHERE ANO_TRANSACAO BETWEEN {YEARS[0]} AND {YEARS[1]}),
uy AS MATERIALIZED (SELECT * FROM um WHERE ANO_TRANSACAO BETWEEN {YEARS[0]} AND {YEARS[1]})"""


def _cubes(spark, d) -> dict[str, patterns.Cube]:
    complete = (primary.complete_years(m(spark, d), YEARS) for m in (_supplier_matrix, _unit_matrix))
    return patterns.diagnostic_cubes(*complete)


def _all(spark, d, table, cuts=(None, "RECORTE"), only=tuple(_CUBES)) -> DataFrame:
    """A kind of table of every cube, over all units and by cut, as one."""
    parts = []
    for name, cube in _cubes(spark, d).items():
        for by in cuts if name in only else ():
            made = table(cube, by)
            value = F.lit("") if by is None else F.col(by if by in made.columns else "RECORTE_VALOR").cast("string")
            parts.append(made.withColumns({"CUBO": F.lit(name), "CORTE": value}).drop("ANO", "RECORTE", "RECORTE_COLUNA", "RECORTE_VALOR", "UNIDADE_ANALISE", "TIPO"))
    return reduce(DataFrame.unionByName, parts)


def _overlap_sql(cuts, only=tuple(_CUBES)) -> str:
    parts = [
        f"SELECT '{name}' AS CUBO, {_value(by, stratum)} AS CORTE, '{a}' AS REGRA_A, '{b}' AS REGRA_B, count(*) AS N, sum({a})::BIGINT AS NA, "
        f"sum({b})::BIGINT AS NB, sum({a} * {b})::BIGINT AS N11 FROM {source} GROUP BY 2"
        for name, (source, flags, stratum) in _CUBES.items()
        if name in only
        for by in cuts
        for a, b in combinations(flags, 2)
    ]
    enough = lambda k: f"({k} >= 30 AND N - {k} >= 30)"
    return f"""{_BASE}, pr AS ({" UNION ALL ".join(parts)})
SELECT CUBO, CORTE, REGRA_A, REGRA_B, N AS N_UNIVERSO, NA AS N_A, NB AS N_B, {enough("NA")} AS ELEGIVEL_A_NO_RECORTE, {enough("NB")} AS ELEGIVEL_B_NO_RECORTE,
  CASE WHEN {enough("NA")} AND {enough("NB")} THEN 'SUFICIENTE' ELSE 'CAUTELA_RARIDADE_NO_RECORTE' END AS DIAGNOSTICO_PAR_NO_RECORTE,
  N11 AS INTERSECAO, NA - N11 AS A_APENAS, NB - N11 AS B_APENAS, N - NA - NB + N11 AS NENHUMA, NA + NB - N11 AS UNIAO,
  round(N11::DOUBLE / nullif(NA + NB - N11, 0), 6) AS JACCARD,
  round((N::DOUBLE * N11 - NA::DOUBLE * NB) / nullif(sqrt(NA::DOUBLE * (N - NA) * NB * (N - NB)), 0), 6) AS PHI,
  round(N11::DOUBLE / nullif(NA, 0), 6) AS P_B_DADO_A, round(N11::DOUBLE / nullif(NB, 0), 6) AS P_A_DADO_B FROM pr"""


def _value(by, stratum) -> str:
    return {None: "''", "ANO": "ANO_TRANSACAO::VARCHAR", "RECORTE": f"{stratum}::VARCHAR"}[by]


def _marginal_sql() -> str:
    parts = []
    for (name, (source, flags, stratum)), by in product(_CUBES.items(), (None, "RECORTE")):
        for f in flags:
            others = f"greatest({', '.join(g for g in flags if g != f)})"
            parts.append(
                f"SELECT '{name}' AS CUBO, {_value(by, stratum)} AS CORTE, '{f}' AS REGRA_OU_FAMILIA, count(*) AS N_UNIVERSO, sum(greatest({', '.join(flags)}))::BIGINT AS N_UNIAO_MOTOR, "
                f"sum({f})::BIGINT AS N_SINALIZADOS, count(*) FILTER ({f} = 1 AND {others} = 0) AS N_EXCLUSIVOS, sum({others})::BIGINT AS N_UNIAO_SEM_REGRA FROM {source} GROUP BY 2"
            )
    return f"""{_BASE} SELECT *, round(N_EXCLUSIVOS::DOUBLE / nullif(N_SINALIZADOS, 0), 6) AS CONTRIBUICAO_MARGINAL_PCT,
  N_UNIAO_MOTOR - N_UNIAO_SEM_REGRA AS PERDA_UNIDADES_SE_REMOVER, N_EXCLUSIVOS = 0 AS ZERO_EXCLUSIVOS FROM ({" UNION ALL ".join(parts)})"""


def _positives_sql(cubes=None) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS CUBO, {_value(by, stratum)} AS CORTE, {i} AS ord, '{f}' AS FLAG, count(*) AS n, sum({f})::BIGINT AS k FROM {source} GROUP BY 2"
        for (name, (source, flags, stratum)), by in product((cubes or _CUBES).items(), (None, "RECORTE"))
        for i, f in enumerate(flags)
    )


_STATUS = "CASE WHEN k IN (0, n) THEN 'SEM_VARIACAO' WHEN k >= 30 AND n - k >= 30 THEN 'SUFICIENTE' ELSE 'DIAGNOSTICO_ESTATISTICO_INSUFICIENTE' END"


def inverse_sql(base: str, cubes: dict | None = None) -> str:
    """CTEs that regress each eligible flag of a group on the group's other ones, by sweeping these out of the correlation matrix, a pivot a round.

    A pivot that the ones before it leave nothing of depends on them and is passed over. ``po`` has every flag with its n and k, ``el`` the eligible ones
    numbered in their group, and ``vif`` what is left of each flag's variance (1 - R2), 0 for a perfect dependence.
    """
    crossed = " UNION ALL ".join(
        f"SELECT '{name}' AS CUBO, {_value(by, stratum)} AS CORTE, '{a}' AS A, '{b}' AS B, sum({a} * {b})::BIGINT AS n11 FROM {source} GROUP BY 2"
        for (name, (source, flags, stratum)), by in product((cubes or _CUBES).items(), (None, "RECORTE"))
        for a, b in product(flags, flags)
    )
    return f"""{base.replace("WITH ", "WITH RECURSIVE ", 1)}, po AS MATERIALIZED ({_positives_sql(cubes)}),
el AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY CUBO, CORTE ORDER BY ord) AS i, count(*) OVER (PARTITION BY CUBO, CORTE) AS m FROM po WHERE k >= 30 AND n - k >= 30),
cr AS MATERIALIZED ({crossed}),
c0 AS MATERIALIZED (SELECT a.CUBO, a.CORTE, a.m, a.i, b.i AS j, (n11 - a.k::DOUBLE * b.k / a.n) / sqrt((a.k - a.k::DOUBLE * a.k / a.n) * (b.k - b.k::DOUBLE * b.k / b.n)) AS v
  FROM el a JOIN el b ON a.CUBO = b.CUBO AND a.CORTE = b.CORTE JOIN cr ON cr.CUBO = a.CUBO AND cr.CORTE = a.CORTE AND cr.A = a.FLAG AND cr.B = b.FLAG),
gj AS (SELECT 0 AS s, c0.*, f.i AS f FROM c0 JOIN el f USING (CUBO, CORTE)
  UNION ALL
  SELECT x.s + 1, x.CUBO, x.CORTE, x.m, x.i, x.j, CASE WHEN x.s + 1 = x.f OR p.v <= {patterns.TINY} THEN x.v ELSE x.v - c.v * q.v / p.v END, x.f
  FROM gj x JOIN gj p ON p.CUBO = x.CUBO AND p.CORTE = x.CORTE AND p.f = x.f AND p.i = x.s + 1 AND p.j = x.s + 1
    JOIN gj q ON q.CUBO = x.CUBO AND q.CORTE = x.CORTE AND q.f = x.f AND q.i = x.s + 1 AND q.j = x.j
    JOIN gj c ON c.CUBO = x.CUBO AND c.CORTE = x.CORTE AND c.f = x.f AND c.i = x.i AND c.j = x.s + 1
  WHERE x.s < x.m),
vif AS (SELECT CUBO, CORTE, i, CASE WHEN v <= {patterns.TINY} THEN 0 ELSE v END AS v FROM gj WHERE s = m AND i = f AND j = f)"""


_INFLATED = "CASE WHEN v = 0 THEN 'inf'::DOUBLE ELSE round(1 / v, 6) END"


QUERIES = {
    "PIP-04-years": (
        lambda s, d: r(_all(s, d, patterns.overlap, ("ANO",), ("supplier_trails", "ug_trails")), "JACCARD", "PHI", "P_B_DADO_A", "P_A_DADO_B"),
        _overlap_sql(("ANO",), ("supplier_trails", "ug_trails")),
    ),
    "PIP-04-overlap": (
        lambda s, d: r(_all(s, d, patterns.overlap), "JACCARD", "PHI", "P_B_DADO_A", "P_A_DADO_B"),
        _overlap_sql((None, "RECORTE")),
    ),
    "PIP-04-marginal": (lambda s, d: r(_all(s, d, patterns.marginality), "CONTRIBUICAO_MARGINAL_PCT"), _marginal_sql()),
    "PIP-04-eligibility": (
        lambda s, d: r(_all(s, d, patterns.eligibility), "PREVALENCIA"),
        f"""{_BASE}, po AS ({_positives_sql()}) SELECT CUBO, CORTE, FLAG AS REGRA_OU_FAMILIA, n AS N_UNIVERSO, k AS N_POSITIVOS, n - k AS N_NEGATIVOS,
  round(k::DOUBLE / n, 6) AS PREVALENCIA, {_STATUS} AS ELEGIBILIDADE_DIAGNOSTICO_ESTATISTICO, {_STATUS} = 'SUFICIENTE' AS ELEGIVEL_PCA_VIF FROM po""",
    ),
    "PIP-04-vif": (
        lambda s, d: r(_all(s, d, patterns.inflation), "R2_AUXILIAR", "TOLERANCIA", "VIF"),
        f"""{inverse_sql(_BASE)}, ps AS (SELECT CUBO, CORTE, FLAG, n AS nn, {_STATUS} AS st, count(*) FILTER (k >= 30 AND n - k >= 30) OVER (PARTITION BY CUBO, CORTE) AS ms FROM po)
SELECT CUBO, CORTE, FLAG AS REGRA_OU_FAMILIA, nn AS N_UNIVERSO, ms::INT AS N_VARIAVEIS_ELEGIVEIS_MODELO, round(1 - v, 6) AS R2_AUXILIAR, round(v, 6) AS TOLERANCIA,
  {_INFLATED} AS VIF, CASE WHEN v IS NULL THEN 'NAO_CALCULADO_' || st WHEN v = 0 THEN 'DEPENDENCIA_LINEAR_PERFEITA' ELSE 'CALCULADO' END AS STATUS_VIF
FROM ps LEFT JOIN (SELECT CUBO, CORTE, FLAG, v FROM el JOIN vif USING (CUBO, CORTE, i)) USING (CUBO, CORTE, FLAG)""",
    ),
    "PIP-04-condition": (lambda s, d: r(_all(s, d, patterns.conditions), "AUTOVALOR", "PROPORCAO_AUTOVALOR", "INDICE_CONDICAO"), None),
    "PIP-04-components": (lambda s, d: _all(s, d, lambda c, by: patterns.components(c, by)[0]), None),
    "PIP-04-loadings": (lambda s, d: _all(s, d, lambda c, by: patterns.components(c, by)[1]), None),
}

# Inflation straight from a matrix: the same inverse in SQL

_SUPPLIER = {"all": ("sm", FLAGS, "BANDA_EXPOSICAO")}
_INFLATION = f""", fl AS (SELECT CUBO, CORTE, FLAG, k >= 30 AND n - k >= 30 AS ok, count(*) FILTER (k >= 30 AND n - k >= 30) OVER (PARTITION BY CUBO, CORTE) AS ms FROM po),
fv AS (SELECT CORTE, FLAG, CASE WHEN ok AND ms > 1 THEN 'ELEGIVEL' ELSE 'INELEGIVEL' END AS STATUS, CASE WHEN ms > 1 THEN round(1 - v, 6) END AS R2, CASE WHEN ms > 1 THEN {_INFLATED} END AS VIF
  FROM fl LEFT JOIN (SELECT CUBO, CORTE, FLAG, v FROM el JOIN vif USING (CUBO, CORTE, i)) USING (CUBO, CORTE, FLAG))"""
QUERIES["MLA-01"] = (
    lambda s, d: r(linalg.variance_inflation(_supplier_matrix(s, d), FLAGS), "R2", "VIF"),
    f"{inverse_sql(FLAGS_SQL, _SUPPLIER)}{_INFLATION} SELECT FLAG, STATUS, R2, VIF FROM fv WHERE CORTE = ''",
)
QUERIES["MLA-04"] = (
    lambda s, d: r(linalg.by_stratum(_supplier_matrix(s, d), FLAGS, "BANDA_EXPOSICAO")["vif"], "R2", "VIF"),
    f"{inverse_sql(FLAGS_SQL, _SUPPLIER)}{_INFLATION} SELECT 'BANDA_EXPOSICAO' AS RECORTE_COLUNA, CORTE AS RECORTE_VALOR, FLAG, STATUS, R2, VIF FROM fv WHERE CORTE <> ''",
)

# The sensitivity contract over both facts

_SCENARIOS = {**sensitivity.THRESHOLDS, "T06": (0.03, 0.05, 0.10, 0.15)}


def _contract(spark, d):
    staged = dealt(spark, d)
    return r(sensitivity.contract(staged, rules.limits_table(spark, TEST_LIMITS), settings=SETTINGS, thresholds=_SCENARIOS, dealt=True), "VALOR_METRICA_SECUNDARIA")


def _one(trail, value, n, control="EXPERIMENTAL", baseline="FALSE", total=None, second="NULL", other="NULL", source="") -> str:
    parameter, metric, unit = sensitivity.CONTRACT[trail]
    comparable = control != "DIAGNOSTICO_NAO_PARAMETRO"
    return (
        f"SELECT '{trail}' AS TRILHA, '{parameter}' AS PARAMETRO, {value} AS VALOR_CENARIO, '{metric}' AS METRICA, '{unit}' AS UNIDADE_CONTAGEM, ({n})::BIGINT AS VALOR_METRICA, "
        f"{second}::VARCHAR AS METRICA_SECUNDARIA, round(({other})::DOUBLE, 6) AS VALOR_METRICA_SECUNDARIA, ({total or n})::BIGINT AS N_SINAIS_TOTAL_CENARIO, "
        f"{comparable} AS COMPARAVEL_COM_BASELINE, '{control}' AS TIPO_CONTROLE, {baseline} AS BASELINE {source}"
    )


def _contract_sql() -> str:
    text = sensitivity._text
    t05 = T05_EPISODES_SQL.rpartition("\nSELECT")[0]
    scenarios = [
        _one("T01", "'SABADO_DOMINGO'", "SELECT count(*) FROM t01", "BLOQUEADO", "TRUE"),
        _one("T02", f"'{model.INSTALMENT}'", "SELECT count(*) FROM t02", "BLOQUEADO", "TRUE"),
        _one("T05", "'3d|N>=5|port>=2|CV<=0.60'", "SELECT n FROM e5", "BASELINE_METODOLOGICA", "TRUE"),
    ]
    for trail, source, usual in (("T03", "g3", 2), ("T04", "g4", 2), ("T06", "g6", 0.05)):
        scenarios += [_one(trail, f"'{text(t)}'", f"SELECT count(*) FROM {source} WHERE v >= {t}", baseline=str(t == usual)) for t in _SCENARIOS[trail]]
    for days, q in product(_SCENARIOS["T07_DIAS"], _SCENARIOS["T07_PERCENTIS"]):
        limit = f"SELECT ANO_TRANSACAO, quantile_cont(N_DIAS::DOUBLE, {q}) AS lim FROM g7 GROUP BY ALL HAVING count(*) >= 10"
        n = f"SELECT count(*) FROM g7 JOIN ({limit}) USING (ANO_TRANSACAO) WHERE N_DIAS >= {days} AND N_DIAS >= lim"
        scenarios.append(_one("T07", f"'{days}|{q:.2f}'", n, baseline=str((days, q) == (3, 0.9))))
    scenarios.append(
        _one("T08", "CENARIO", "N_D2", "DIAGNOSTICO_NAO_PARAMETRO", "CENARIO = 'A_TODOS_GE10'", "NULL", "'MAD_D12'", "MAD_D2", "FROM g8")
    )
    for near in _SCENARIOS["T09"]:
        close = f"SELECT count(*) FROM g9 WHERE NOT fixed AND v >= {near}"
        held = "SELECT count(*) FROM g9 WHERE fixed"
        scenarios.append(_one("T09", f"'{near:.2f}'", close, baseline=str(near == 0.9), total=f"({close}) + ({held})", second="'N_FIXOS_NO_LIMITE_OU_ACIMA'", other=held))
    kinds = ", ".join(f"('{name}', {cents})" for name, cents in sensitivity.POPULATIONS.items())
    counts = " UNION ALL ".join(f"SELECT 'T0{i}' AS TRILHA, count(*) AS N_SINAIS_BASELINE FROM t0{i}" for i in range(1, 10) if i != 5)
    return f"""WITH {BOTH_SQL}, {_TRAILS_SQL},
e5 AS (SELECT count(*) AS n FROM (WITH {_body(t05, EV)} SELECT * FROM ranked)),
g3 AS (SELECT count(*) AS v {_REPEATABLE} GROUP BY UG_ID, PORTADOR_ID, FAVORECIDO_ID, DATA_DT, TRANSACAO, VALOR_CENTAVOS HAVING count(*) >= 2),
g4 AS (SELECT count(DISTINCT PORTADOR_ID) AS v {_REPEATABLE} GROUP BY UG_ID, FAVORECIDO_ID, DATA_DT, VALOR_CENTAVOS HAVING count(*) >= 2 AND count(DISTINCT PORTADOR_ID) >= 2),
g6 AS (WITH {_body(T06_SQL, LI)} SELECT TOP1_SHARE_VALOR AS v FROM ind WHERE N_COMPRAS >= 20 AND N_FORNECEDORES >= 3 AND COBERTURA >= 0.8),
g7 AS (WITH {_body(T07_SQL, EV)} SELECT ANO_TRANSACAO, N_DIAS FROM yearly),
g8 AS (WITH rows AS (SELECT s.CENARIO, VALOR_CENTAVOS FROM stg CROSS JOIN (VALUES {kinds}) s(CENARIO, m)
  WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0 AND (m = 0 OR VALOR_CENTAVOS % nullif(m, 0) <> 0)), {_benford_sql(2, "CENARIO")} SELECT CENARIO, N_D2, MAD_D2 FROM m2),
g9 AS (WITH {_body(T09_SQL, LI)} SELECT greatest(VALOR_CENTAVOS::DOUBLE / LIMITE_COMPRAS, VALOR_CENTAVOS::DOUBLE / LIMITE_ENGENHARIA) AS v,
  C IN ('NO_LIMITE', 'ACIMA_LIMITE') OR E IN ('NO_LIMITE', 'ACIMA_LIMITE') AS fixed FROM cls),
bl AS ({counts} UNION ALL SELECT 'T05', n FROM e5)
SELECT *, CASE WHEN COMPARAVEL_COM_BASELINE THEN N_SINAIS_TOTAL_CENARIO - N_SINAIS_BASELINE END AS VARIACAO_SINAIS_N FROM ({" UNION ALL ".join(scenarios)}) JOIN bl USING (TRILHA)"""


QUERIES["GOV-06-contract"] = (_contract, _contract_sql())

# Validation rates over a stratified sample of purchases

_VALIDATED = {0: "CONFIRMADO", 1: "JUSTIFICADO", 2: "FALSO_POSITIVO", 3: "EM_ANALISE"}


def _validated(spark, d):
    """The sample of GOV-08 with a level, a stratum and a status made from the event's number, and the strata's populations."""
    rows = events(spark, d).filter("EH_COMPRA_NACIONAL").withColumn("ESTRATO", F.substring("ID_TRANSACAO", -1, 1))
    sample = governance.stratified_sample(rows, "UG_ID", "ESTRATO", "ID_TRANSACAO")
    status = F.element_at(F.create_map(*(c for k, v in _VALIDATED.items() for c in (F.lit(k), F.lit(v)))), (F.col("ID_TRANSACAO").cast("int") % 11 % 4).cast("int"))
    populations = rows.groupBy("UG_ID", "ESTRATO").agg(F.count(F.lit(1)).alias("N_POP_ESTRATO"))
    return sample.withColumns({"STATUS_VALIDACAO": status, "NIVEL_TRIAGEM": F.when(F.col("VALOR_CENTAVOS") >= 5000, "ELEVADO").otherwise("ATENCAO")}), populations


_VALIDATED_SQL = f"""{EV}, rw AS (SELECT *, right(ID_TRANSACAO, 1) AS ESTRATO, sha256('sample|' || ID_TRANSACAO) AS hs FROM stg WHERE EH_COMPRA_NACIONAL),
pl AS (SELECT *, row_number() OVER (PARTITION BY UG_ID, ESTRATO ORDER BY hs, ID_TRANSACAO) AS p FROM rw), tn AS (SELECT *, row_number() OVER (PARTITION BY UG_ID ORDER BY p, ESTRATO) AS t FROM pl WHERE p <= 30),
va AS (SELECT *, CASE WHEN VALOR_CENTAVOS >= 5000 THEN 'ELEVADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM,
  CASE ID_TRANSACAO::INT % 11 % 4 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _VALIDATED.items())} END AS STATUS_VALIDACAO FROM tn WHERE t <= 30),
po AS (SELECT UG_ID, ESTRATO, count(*)::DOUBLE AS pn FROM rw GROUP BY ALL)"""
_DECIDED_SQL = f"STATUS_VALIDACAO IN ({', '.join(f"'{s}'" for s in governance.DECIDED)})"
QUERIES["AGG-40b"] = (
    lambda s, d: r(governance.validation_rates(_validated(s, d)[0], ["UG_ID", "NIVEL_TRIAGEM"]), "TAXA_CONFIRMACAO", "IC95_INF", "IC95_SUP"),
    f"""{_VALIDATED_SQL}, g AS (SELECT UG_ID, NIVEL_TRIAGEM, count(*) AS N_VALIDACOES, count(*) FILTER ({_DECIDED_SQL}) AS N_DECIDIDOS, count(*) FILTER (STATUS_VALIDACAO = 'CONFIRMADO') AS N_CONFIRMADOS FROM va GROUP BY ALL),
w AS (SELECT *, nullif(N_DECIDIDOS, 0)::DOUBLE AS n, N_CONFIRMADOS / n AS p, 1.959963984540054::DOUBLE AS z FROM g)
SELECT UG_ID, NIVEL_TRIAGEM, N_VALIDACOES, N_DECIDIDOS, N_CONFIRMADOS, round(p, 6) AS TAXA_CONFIRMACAO, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS IC95_INF,
  round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS IC95_SUP FROM w""",
)
QUERIES["AGG-40c"] = (
    lambda s, d: r(governance.weighted_rates(*_validated(s, d), "UG_ID", "ESTRATO"), "TAXA_CONFIRMACAO_PONDERADA", "ERRO_PADRAO", "IC95_INF", "IC95_SUP"),
    f"""{_VALIDATED_SQL}, h AS (SELECT UG_ID, ESTRATO, count(*)::DOUBLE AS n, avg((STATUS_VALIDACAO = 'CONFIRMADO')::INT) AS p FROM va WHERE {_DECIDED_SQL} GROUP BY ALL),
v AS (SELECT h.*, pn, CASE WHEN n >= pn THEN 0 WHEN n > 1 THEN pn * pn * (1 - n / pn) * p * (1 - p) / (n - 1) END AS s FROM h JOIN (SELECT UG_ID, ESTRATO, pn FROM po) USING (UG_ID, ESTRATO)),
a AS (SELECT UG_ID, sum(p * pn) / sum(pn) AS t, count(*) AS k, sum(pn)::BIGINT AS pop, CASE WHEN count(*) = count(s) THEN sqrt(sum(s)) / sum(pn) END AS e FROM v GROUP BY UG_ID)
SELECT UG_ID, round(t, 6) AS TAXA_CONFIRMACAO_PONDERADA, k AS N_ESTRATOS_COM_DECISAO, pop AS POPULACAO_REPRESENTADA, round(e, 6) AS ERRO_PADRAO,
  CASE WHEN e IS NOT NULL THEN round(greatest(0, t - 1.959963984540054 * e), 6) END AS IC95_INF, CASE WHEN e IS NOT NULL THEN round(least(1, t + 1.959963984540054 * e), 6) END AS IC95_SUP FROM a""",
)
