"""Staging, the nine rules and the first-digit diagnostics over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as x
from ..operators import benford, rules, staging
from .adapters import EVENTS_SQL, LIMITS_SQL, LINES_SQL, STEADY, STEADY_SQL, TEST_LIMITS, _table, events, lines, raw_lines

LI, EV = f"WITH {LINES_SQL}", f"WITH {EVENTS_SQL}"


def r(df, *columns, places: int = 6):
    """Doubles rounded, so that both engines agree."""
    return df.withColumns({c: F.round(c, places) for c in columns})


def _ids(kind: str, prefix: str) -> str:
    return f"'{prefix}_' || md5(concat_ws('|', '{prefix}', '1.2.0', {kind}))"


def _staged_text(spark, d):
    keep = (
        "ID_TRANSACAO UG_ID NOME_PORTADOR_NORMALIZADO PORTADOR_ID_BASELINE PORTADOR_ID FAVORECIDO_ID DATA_DT ANO_EXTRATO_REF "
        "MES_EXTRATO_REF COMPETENCIA_EXTRATO_REF VALOR_CENTAVOS VALOR_NUM EH_COMPRA_EFETIVA EH_SAQUE_EFETIVO EH_SIGILOSO"
    ).split()
    return staging.build_staging(raw_lines(spark, d)).select(*keep)


_CODES = "CASE l_returnflag || l_linestatus WHEN 'NO' THEN FALSE ELSE TRUE END"
STAGED_TEXT_SQL = f"""
WITH t AS (
  SELECT *, lpad(c_nationkey::VARCHAR, 6, '0') AS ug, o_custkey::VARCHAR AS card,
    CASE WHEN o_custkey % 9 = 0 THEN 'PORTADOR SIGILOSO: SIGILO' ELSE 'JOSE ' || c_mktsegment END AS nm,
    round(l_extendedprice * 100)::BIGINT AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ID_TRANSACAO, ug AS UG_ID, nm AS NOME_PORTADOR_NORMALIZADO,
  CASE WHEN o_custkey % 9 <> 0 THEN card END AS PORTADOR_ID_BASELINE, ug || '|' || card || '|' || nm AS PORTADOR_ID,
  CASE WHEN l_suppkey % 10 <> 0 AND l_suppkey % 11 <> 0 THEN l_suppkey::VARCHAR END AS FAVORECIDO_ID,
  CASE WHEN l_linenumber <> 7 THEN l_shipdate::DATE END AS DATA_DT,
  CASE WHEN year(l_shipdate) >= 2000 THEN year(l_shipdate)::INT END AS ANO_EXTRATO_REF, month(l_shipdate)::INT AS MES_EXTRATO_REF,
  CASE WHEN year(l_shipdate) >= 2000 THEN strftime(l_shipdate, '%Y%m') END AS COMPETENCIA_EXTRATO_REF,
  CASE WHEN l_linenumber = 6 THEN -cents ELSE cents END AS VALOR_CENTAVOS,
  (CASE WHEN l_linenumber = 6 THEN -cents ELSE cents END)::DOUBLE / 100 AS VALOR_NUM,
  {_CODES} AS EH_COMPRA_EFETIVA, NOT ({_CODES}) AS EH_SAQUE_EFETIVO, o_custkey % 9 = 0 AS EH_SIGILOSO
FROM t"""


def _calendar(spark, d):
    return staging.with_calendar(lines(spark, d)).groupBy("MES_TRANSACAO", "DIA_SEMANA").agg(F.count(F.lit(1)).alias("N"))


def _folded(spark, d):
    folded = x.folded_name(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", F.length(folded).alias("N"), F.md5(folded.cast("binary")).alias("MD5"))


#: For texts without compatibility characters, which DuckDB can't decompose; it has no capitals for ß either.
FOLDED_SQL = r"""SELECT doc_id, length(f)::INT AS N, md5(f) AS MD5
FROM (SELECT doc_id, regexp_replace(strip_accents(upper(trim(regexp_replace(replace(coalesce(text, ''), 'ß', 'SS'), '\s+', ' ', 'g')))), '[^\x00-\x7F]', '', 'g') AS f FROM documents)"""


def _weekend(spark, d):
    return rules.weekend_purchases(lines(spark, d)).select("ID_SINAL", "ID_TRANSACAO", "UG_ID", "VALOR_CENTAVOS")


def _t05(spark, d):
    return rules.recurrence_windows(events(spark, d), days=3, max_cv=0.6)


def _t05_episodes(spark, d):
    out = rules.recurrence_episodes(_t05(spark, d), reinforced_cv=0.4)
    return r(out, "CV", "MEDIANA", "Q1", "Q3", "IQR", "SHARE_MEDIANA", "PERCENTIL_VALOR_ANO").drop("ID_EPISODIO")


T05_SQL = f"""{EV}, elig AS (
  SELECT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS AS V FROM stg
  WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0 AND FAVORECIDO_IDENTIFICADO AND DATA_DT IS NOT NULL
), anchors AS (SELECT DISTINCT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, DATA_DT AS INICIO FROM elig),
stats AS (
  SELECT a.UG_ID, a.FAVORECIDO_ID, a.ANO_TRANSACAO, INICIO, max(DATA_DT) AS FIM, count(*) AS N,
    count(DISTINCT PORTADOR_ID) AS N_PORTADORES, sum(V)::BIGINT AS TOTAL_CENTAVOS, min(V) AS MIN_CENTAVOS, max(V) AS MAX_CENTAVOS,
    stddev_pop(V::DOUBLE) / avg(V::DOUBLE) AS CV, quantile_cont(V::DOUBLE, 0.5) AS MEDIANA,
    quantile_cont(V::DOUBLE, 0.25) AS Q1, quantile_cont(V::DOUBLE, 0.75) AS Q3, list(V::DOUBLE) AS vs
  FROM anchors a JOIN elig e ON a.UG_ID = e.UG_ID AND a.FAVORECIDO_ID = e.FAVORECIDO_ID AND a.ANO_TRANSACAO = e.ANO_TRANSACAO
    AND e.DATA_DT BETWEEN INICIO AND INICIO + INTERVAL 3 DAY
  GROUP BY ALL
), cand AS (
  SELECT * EXCLUDE (vs), Q3 - Q1 AS IQR,
    len([v FOR v IN vs IF abs(v - MEDIANA) <= 0.2 * MEDIANA]) / N::DOUBLE AS SHARE_MEDIANA
  FROM stats WHERE N >= 5 AND N_PORTADORES >= 2 AND CV <= 0.6)"""
_T05_COLUMNS = """UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, INICIO, FIM, N, N_PORTADORES, TOTAL_CENTAVOS, MIN_CENTAVOS, MAX_CENTAVOS,
  round(CV, 6) AS CV, round(MEDIANA, 6) AS MEDIANA, round(Q1, 6) AS Q1, round(Q3, 6) AS Q3, round(IQR, 6) AS IQR,
  round(SHARE_MEDIANA, 6) AS SHARE_MEDIANA"""
T05_EPISODES_SQL = f"""{T05_SQL}, marked AS (
  SELECT *, CASE WHEN INICIO > max(FIM) OVER (PARTITION BY UG_ID, FAVORECIDO_ID, ANO_TRANSACAO ORDER BY INICIO, FIM, N DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS s FROM cand
), clustered AS (
  SELECT *, sum(s) OVER (PARTITION BY UG_ID, FAVORECIDO_ID, ANO_TRANSACAO ORDER BY INICIO, FIM, N DESC ROWS UNBOUNDED PRECEDING) AS c FROM marked
), best AS (
  SELECT *, row_number() OVER (PARTITION BY UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, c
    ORDER BY N DESC, N_PORTADORES DESC, CV, TOTAL_CENTAVOS DESC, INICIO) AS rn FROM clustered
), ranked AS (
  SELECT *, (rank() OVER (PARTITION BY ANO_TRANSACAO ORDER BY TOTAL_CENTAVOS)
    + (count(*) OVER (PARTITION BY ANO_TRANSACAO, TOTAL_CENTAVOS) - 1) / 2.0) / count(*) OVER (PARTITION BY ANO_TRANSACAO) AS p
  FROM best WHERE rn = 1)
SELECT {_T05_COLUMNS}, round(p::DOUBLE, 6) AS PERCENTIL_VALOR_ANO, CASE WHEN CV <= 0.4 THEN 'REFORCADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM,
  CASE WHEN p >= 0.9 THEN 'ELEVADA' WHEN p >= 0.75 THEN 'MODERADA' ELSE 'BAIXA' END AS MATERIALIDADE,
  SHARE_MEDIANA >= 0.8 AS SIMILARIDADE_ROBUSTA FROM ranked"""

T06_SQL = f"""{LI}, rows AS (SELECT * FROM stg WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0),
tot AS (SELECT UG_ID, ANO_TRANSACAO, count(*) AS N_COMPRAS, sum(VALOR_CENTAVOS)::BIGINT AS TOTAL_UG_CENTAVOS FROM rows GROUP BY ALL),
sup AS (SELECT UG_ID, ANO_TRANSACAO, FAVORECIDO_ID, sum(VALOR_CENTAVOS)::BIGINT AS V, count(*) AS Q FROM rows WHERE FAVORECIDO_IDENTIFICADO GROUP BY ALL),
sh AS (SELECT *, V::DOUBLE / sum(V) OVER u AS SHARE, Q::DOUBLE / sum(Q) OVER u AS SHARE_Q,
    row_number() OVER (PARTITION BY UG_ID, ANO_TRANSACAO ORDER BY V DESC, FAVORECIDO_ID) AS RN,
    row_number() OVER (PARTITION BY UG_ID, ANO_TRANSACAO ORDER BY Q DESC, FAVORECIDO_ID) AS RN_Q
  FROM sup WINDOW u AS (PARTITION BY UG_ID, ANO_TRANSACAO)),
f AS (SELECT UG_ID, ANO_TRANSACAO, count(*) AS N_FORNECEDORES, sum(V)::BIGINT AS TOTAL_IDENTIFICADO_CENTAVOS, sum(Q)::BIGINT AS N_COMPRAS_IDENTIFICADAS,
    max(CASE WHEN RN = 1 THEN FAVORECIDO_ID END) AS TOP1_FAVORECIDO_ID, max(CASE WHEN RN = 1 THEN SHARE END) AS TOP1_SHARE_VALOR,
    max(CASE WHEN RN = 1 THEN SHARE_Q END) AS TOP1_SHARE_QTD, sum(CASE WHEN RN <= 5 THEN SHARE END) AS TOP5_SHARE_VALOR, sum(SHARE * SHARE) AS HHI,
    max(CASE WHEN RN_Q = 1 THEN FAVORECIDO_ID END) AS TOP1_FAVORECIDO_QTD, max(CASE WHEN RN_Q = 1 THEN SHARE_Q END) AS TOP1_SHARE_QTD_MAX
  FROM sh GROUP BY ALL),
ind AS (SELECT tot.*, f.* EXCLUDE (UG_ID, ANO_TRANSACAO), TOTAL_IDENTIFICADO_CENTAVOS::DOUBLE / TOTAL_UG_CENTAVOS AS COBERTURA
  FROM tot LEFT JOIN f USING (UG_ID, ANO_TRANSACAO))"""
_T06_ROUND = ["TOP1_SHARE_VALOR", "TOP1_SHARE_QTD", "TOP5_SHARE_VALOR", "HHI", "TOP1_SHARE_QTD_MAX", "COBERTURA"]
_T06_SELECT = "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _T06_ROUND) + ")"


def _t06(spark, d):
    return r(rules.concentration(lines(spark, d)), *_T06_ROUND)


def _t06_signals(spark, d):
    found = rules.concentration_signals(rules.concentration(lines(spark, d)), levels=(0.02, 0.03, 0.05))
    return found.select("UG_ID", "ANO_TRANSACAO", "NIVEL_TRIAGEM", "ID_SINAL")


def _t06_rows(spark, d):
    staged = lines(spark, d)
    return rules.concentration_rows(staged, rules.concentration_signals(rules.concentration(staged), levels=(0.02, 0.03, 0.05)))


T07_SQL = f"""{EV}, daily AS (
  SELECT UG_ID, PORTADOR_ID, ANO_TRANSACAO, DATA_DT, count(*) AS N, sum(VALOR_CENTAVOS)::BIGINT AS TOTAL_CENTAVOS, max(VALOR_CENTAVOS) AS MAX_CENTAVOS,
    string_agg(DISTINCT TRANSACAO, ' | ' ORDER BY TRANSACAO) AS CODIGOS
  FROM stg WHERE EH_SAQUE_EFETIVO GROUP BY ALL HAVING count(*) >= 2
), yearly AS (
  SELECT UG_ID, PORTADOR_ID, ANO_TRANSACAO, count(*) AS N_DIAS, sum(N)::BIGINT AS N_SAQUES, sum(TOTAL_CENTAVOS)::BIGINT AS TOTAL_CENTAVOS,
    max(N) AS MAX_DIA, min(DATA_DT) AS PRIMEIRO_DIA, max(DATA_DT) AS ULTIMO_DIA FROM daily GROUP BY ALL
), lims AS (SELECT ANO_TRANSACAO, count(*) AS N_COMPARAVEIS, quantile_cont(N_DIAS::DOUBLE, 0.9) AS P90_DIAS FROM yearly GROUP BY ALL),
rec AS (SELECT yearly.*, percent_rank() OVER (PARTITION BY yearly.ANO_TRANSACAO ORDER BY N_DIAS) AS PERCENT_RANK_ANO, N_COMPARAVEIS, P90_DIAS,
    N_DIAS >= 3 AND N_COMPARAVEIS >= 10 AND N_DIAS >= P90_DIAS AS PRIORITARIO FROM yearly JOIN lims USING (ANO_TRANSACAO))"""


def _daily(spark, d):
    return rules.daily_withdrawals(events(spark, d))


def _classified(spark, d):
    return rules.classify_limits(lines(spark, d), rules.limits_table(spark, TEST_LIMITS))


def _case_status(limit: str) -> str:
    return (
        f"CASE WHEN VALOR_CENTAVOS > {limit} THEN 'ACIMA_LIMITE' WHEN VALOR_CENTAVOS = {limit} THEN 'NO_LIMITE' "
        f"WHEN VALOR_CENTAVOS::DOUBLE / {limit} >= 0.9 THEN 'PROXIMO_LIMITE' ELSE 'ABAIXO_FAIXA' END"
    )


T09_SQL = f"""{LI}, {LIMITS_SQL}, c1 AS (
  SELECT stg.*, LIMITE_COMPRAS, LIMITE_ENGENHARIA, {_case_status("LIMITE_COMPRAS")} AS C, {_case_status("LIMITE_ENGENHARIA")} AS E
  FROM stg JOIN lim ON DATA_DT BETWEEN INICIO AND FIM WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0
), cls AS (
  SELECT *, CASE WHEN C = 'ACIMA_LIMITE' AND E = 'ACIMA_LIMITE' THEN 'ACIMA_AMBOS_CENARIOS'
      WHEN 'ACIMA_LIMITE' IN (C, E) THEN 'ACIMA_PELO_MENOS_UM_CENARIO' WHEN 'NO_LIMITE' IN (C, E) THEN 'NO_LIMITE_PELO_MENOS_UM_CENARIO'
      WHEN 'PROXIMO_LIMITE' IN (C, E) THEN 'PROXIMO_LIMITE' ELSE 'ABAIXO_FAIXAS' END AS STATUS_T09,
    CASE WHEN C = 'ACIMA_LIMITE' AND E = 'ACIMA_LIMITE' THEN 'REFORCADO' WHEN 'ACIMA_LIMITE' IN (C, E) THEN 'ATENCAO'
      WHEN 'NO_LIMITE' IN (C, E) OR 'PROXIMO_LIMITE' IN (C, E) THEN 'INFORMATIVO' ELSE 'SEM_SINAL' END AS NIVEL_TRIAGEM
  FROM c1)"""


def _benford_sql(places: int, by: str = "UG_ID, ANO_TRANSACAO", source: str = "rows") -> str:
    low, high, least = 10 ** (places - 1), 10**places - 1, benford.LEAST[places]
    on = " AND ".join(f"t.{c.strip()} = c.{c.strip()}" for c in by.split(","))
    cols = ", ".join(f"t.{c.strip()}" for c in by.split(","))
    return f"""c{places} AS (SELECT {by}, left(VALOR_CENTAVOS::VARCHAR, {places})::INT AS DIGITO, count(*) AS OBSERVADOS
    FROM {source} WHERE VALOR_CENTAVOS >= {least} GROUP BY ALL),
  t{places} AS (SELECT {by}, sum(OBSERVADOS)::BIGINT AS N FROM c{places} GROUP BY ALL),
  d{places} AS (SELECT {cols}, g.DIGITO, t.N, coalesce(c.OBSERVADOS, 0) AS OBSERVADOS, log10(1 + 1 / g.DIGITO::DOUBLE) AS ESPERADO,
      coalesce(c.OBSERVADOS, 0)::DOUBLE / t.N AS PROPORCAO
    FROM t{places} t CROSS JOIN (SELECT range::INT AS DIGITO FROM range({low}, {high + 1})) g
    LEFT JOIN c{places} c ON {on} AND c.DIGITO = g.DIGITO),
  m{places} AS (SELECT {by}, max(N) AS N_D{places}, avg(abs(PROPORCAO - ESPERADO)) AS MAD_D{places},
      sum(pow(OBSERVADOS - ESPERADO * N, 2) / (ESPERADO * N)) AS QUI2_D{places} FROM d{places} GROUP BY ALL)"""


def _mad_case(places: int) -> str:
    return "CASE " + " ".join(f"WHEN MAD_D{places} <= {v} THEN '{t}'" for v, t in benford.MAD_LIMITS[places]) + " ELSE 'Não conformidade' END"


_ROWS = "rows AS (SELECT * FROM stg WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0)"
T08_SQL = f"""{LI}, {_ROWS}, {_benford_sql(1)}, {_benford_sql(2)},
s AS (SELECT UG_ID, ANO_TRANSACAO, count(*) AS N, count(DISTINCT VALOR_CENTAVOS) AS VALORES_UNICOS, min(VALOR_CENTAVOS) AS MIN_CENTAVOS,
    quantile_cont(VALOR_CENTAVOS::DOUBLE, 0.5) AS MEDIANA_CENTAVOS, avg(VALOR_CENTAVOS::DOUBLE) AS MEDIA_CENTAVOS, max(VALOR_CENTAVOS) AS MAX_CENTAVOS
  FROM rows GROUP BY ALL),
ind AS (SELECT s.*, x.* EXCLUDE (UG_ID, ANO_TRANSACAO), y.* EXCLUDE (UG_ID, ANO_TRANSACAO),
    CASE WHEN N < 300 THEN 'NAO_APLICAR' WHEN N < 1000 THEN 'EXPLORATORIO' WHEN N < 3000 THEN 'FORMAL' ELSE 'FORMAL_ROBUSTEZ_MAIOR' END AS STATUS_AMOSTRA
  FROM s LEFT JOIN (SELECT *, {_mad_case(1)} AS CLASSE_D1 FROM m1 WHERE N_D1 >= 100) x USING (UG_ID, ANO_TRANSACAO)
  LEFT JOIN (SELECT *, {_mad_case(2)} AS CLASSE_D2 FROM m2 WHERE N_D2 >= 100) y USING (UG_ID, ANO_TRANSACAO))"""
_T08_ROUND = ["MEDIANA_CENTAVOS", "MEDIA_CENTAVOS", "MAD_D1", "QUI2_D1", "MAD_D2", "QUI2_D2"]
T08_RANK_SQL = f"""{T08_SQL}, rk AS (
  SELECT UG_ID, ANO_TRANSACAO, MAD_D2, count(*) OVER y AS N_COMPARAVEIS, quantile_cont(MAD_D2, 0.9) OVER y AS P90_MAD,
    (rank() OVER (PARTITION BY ANO_TRANSACAO ORDER BY MAD_D2) + (count(*) OVER (PARTITION BY ANO_TRANSACAO, MAD_D2) - 1) / 2.0)
      / count(*) OVER y AS PERCENTIL_MAD
  FROM ind WHERE N_D2 >= 100 AND ANO_TRANSACAO BETWEEN 1990 AND 2010 WINDOW y AS (PARTITION BY ANO_TRANSACAO)),
ranked AS (SELECT *, N_COMPARAVEIS >= 10 AS ANO_VALIDO, N_COMPARAVEIS >= 10 AND MAD_D2 >= P90_MAD AS TOP_DECIL, MAD_D2 > 0.0022 AS NAO_CONFORME FROM rk)"""


def _indicators(spark, d):
    return benford.unit_year_indicators(lines(spark, d), least=100)


def _ranked(spark, d):
    return benford.rank_units(_indicators(spark, d), formal=100, years=(1990, 2010))


def _ranked_out(spark, d):
    columns = "UG_ID ANO_TRANSACAO MAD_D2 N_COMPARAVEIS P90_MAD PERCENTIL_MAD ANO_VALIDO TOP_DECIL NAO_CONFORME".split()
    return r(_ranked(spark, d).select(*columns), "MAD_D2", "P90_MAD", "PERCENTIL_MAD")


def _national(spark, d):
    return lines(spark, d).filter("EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0")


def _z(spark, d):
    table = benford.z_statistic(benford.digit_table(_national(spark, d), 2, ["ANO_TRANSACAO"]))
    return r(table, "ESPERADO", "PROPORCAO", "Z").drop("Z_SIGNIFICATIVO")


def _scenarios(spark, d):
    rows = benford.without_round_values(events(spark, d).filter("VALOR_CENTAVOS > 0"))
    return r(benford.conformity(benford.digit_table(rows, 1, ["CENARIO"]), 1, ["CENARIO"]), "MAD_D1", "QUI2_D1")


QUERIES = {
    "PRJ-01": (_staged_text, STAGED_TEXT_SQL),
    "PRJ-04": (_folded, FOLDED_SQL),
    "PRJ-20": (
        _calendar,
        f"{LI} SELECT month(DATA_DT)::INT AS MES_TRANSACAO, dayofweek(DATA_DT)::INT AS DIA_SEMANA, count(*) AS N FROM stg GROUP BY ALL",
    ),
    "FLT-01": (
        _weekend,
        f"{LI} SELECT {_ids('ID_TRANSACAO', 'T01')} AS ID_SINAL, ID_TRANSACAO, UG_ID, VALOR_CENTAVOS FROM stg WHERE EH_COMPRA_EFETIVA AND dayofweek(DATA_DT) IN (0, 6)",
    ),
    "AGG-01": (
        lambda s, d: r(rules.weekend_recurrence(lines(s, d)), "SHARE_FIM_SEMANA", "PERCENT_RANK_ANO"),
        f"""{LI}, g AS (SELECT UG_ID, PORTADOR_ID, ANO_TRANSACAO, count(*) AS N_COMPRAS, count(*) FILTER (w) AS N_FIM_SEMANA,
  count(DISTINCT CASE WHEN w THEN DATA_DT END) AS N_DIAS_FIM_SEMANA, sum(CASE WHEN w THEN VALOR_CENTAVOS ELSE 0 END)::BIGINT AS CENTAVOS_FIM_SEMANA
  FROM (SELECT *, dayofweek(DATA_DT) IN (0, 6) AS w FROM stg WHERE EH_COMPRA_NACIONAL) GROUP BY 1, 2, 3 HAVING count(*) FILTER (w) > 0)
SELECT *, round(N_FIM_SEMANA::DOUBLE / N_COMPRAS, 6) AS SHARE_FIM_SEMANA,
  round(percent_rank() OVER (PARTITION BY ANO_TRANSACAO ORDER BY N_DIAS_FIM_SEMANA), 6) AS PERCENT_RANK_ANO FROM g""",
    ),
    "AGG-02": (
        lambda s, d: rules.summarize_by_year(rules.weekend_purchases(lines(s, d))),
        f"{LI} SELECT ANO_TRANSACAO, count(*) AS N_SINAIS, sum(VALOR_CENTAVOS)::BIGINT AS TOTAL_CENTAVOS FROM stg WHERE EH_COMPRA_EFETIVA AND dayofweek(DATA_DT) IN (0, 6) GROUP BY ALL",
    ),
    "AGG-02b": (
        lambda s, d: r(rules.summarize_recurrence(rules.weekend_recurrence(lines(s, d))), "MEDIA_DIAS"),
        f"""{LI}, g AS (SELECT UG_ID, PORTADOR_ID, ANO_TRANSACAO, count(DISTINCT DATA_DT) AS n FROM stg
  WHERE EH_COMPRA_NACIONAL AND dayofweek(DATA_DT) IN (0, 6) GROUP BY ALL)
SELECT ANO_TRANSACAO, count(*) AS N_PORTADORES, median(n)::DOUBLE AS MEDIANA_DIAS, max(n) AS MAX_DIAS, round(avg(n), 6) AS MEDIA_DIAS FROM g GROUP BY ALL""",
    ),
    "FLT-02": (
        lambda s, d: rules.instalments(lines(s, d)).select("ID_SINAL", "VALOR_CENTAVOS"),
        f"{LI} SELECT {_ids('ID_TRANSACAO', 'T02')} AS ID_SINAL, VALOR_CENTAVOS FROM stg WHERE TRANSACAO = 'CPP LOJISTA TRF P/FATURA - REAL'",
    ),
    "AGG-02c": (
        lambda s, d: rules.summarize_instalments(rules.instalments(lines(s, d))),
        f"""{LI} SELECT count(*) AS N_SINAIS, coalesce(sum(VALOR_CENTAVOS), 0)::BIGINT AS TOTAL_CENTAVOS, coalesce(min(VALOR_CENTAVOS), 0) AS MIN_CENTAVOS,
  coalesce(max(VALOR_CENTAVOS), 0) AS MAX_CENTAVOS FROM stg WHERE TRANSACAO = 'CPP LOJISTA TRF P/FATURA - REAL'""",
    ),
    "AGG-03": (
        lambda s, d: rules.exact_repetition(events(s, d)).withColumnRenamed("TRANSAÇÃO", "TRANSACAO"),
        f"""{EV}, g AS (SELECT UG_ID, PORTADOR_ID, FAVORECIDO_ID, DATA_DT, TRANSACAO, VALOR_CENTAVOS, count(*) AS N
  FROM stg WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_IDENTIFICADO GROUP BY ALL HAVING count(*) >= 2)
SELECT *, VALOR_CENTAVOS * N AS TOTAL_CENTAVOS, CASE WHEN N >= 3 THEN 'REFORCADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM,
  {_ids('UG_ID, PORTADOR_ID, FAVORECIDO_ID, DATA_DT, TRANSACAO, VALOR_CENTAVOS', 'T03')} AS ID_GRUPO FROM g""",
    ),
    "JON-01": (
        lambda s, d: rules.exact_repetition_rows(events(s, d), rules.exact_repetition(events(s, d))).select("ID_TRANSACAO"),
        f"""{EV} SELECT ID_TRANSACAO FROM (SELECT *, count(*) OVER (PARTITION BY UG_ID, PORTADOR_ID, FAVORECIDO_ID, DATA_DT, TRANSACAO, VALOR_CENTAVOS) AS n
  FROM stg WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_IDENTIFICADO) WHERE n >= 2""",
    ),
    "AGG-04": (
        lambda s, d: rules.integral_repetition(events(s, d), ["UG_ID", "PORTADOR_ID", "DATA_DT", "VALOR_CENTAVOS"]),
        f"""{EV} SELECT md5(concat_ws('|', UG_ID, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS)) AS HASH, count(*) AS N, UG_ID, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS,
  'T03B_' || md5(concat_ws('|', UG_ID, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS)) AS ID_GRUPO
FROM stg WHERE NOT EH_SIGILOSO GROUP BY UG_ID, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS HAVING count(*) >= 2""",
    ),
    "AGG-05": (
        lambda s, d: rules.multi_cardholder(events(s, d)).drop("ID_GRUPO"),
        f"""{EV}, g AS (SELECT UG_ID, FAVORECIDO_ID, DATA_DT, VALOR_CENTAVOS, count(*) AS N, count(DISTINCT PORTADOR_ID) AS N_PORTADORES
  FROM stg WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_IDENTIFICADO GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT PORTADOR_ID) >= 2)
SELECT *, VALOR_CENTAVOS * N AS TOTAL_CENTAVOS,
  CASE WHEN N_PORTADORES >= 5 THEN 'MUITO_ELEVADO' WHEN N_PORTADORES >= 3 THEN 'ELEVADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM FROM g""",
    ),
    "AGG-06": (
        lambda s, d: rules.summarize_groups(rules.multi_cardholder(events(s, d))),
        f"""{EV}, g AS (SELECT VALOR_CENTAVOS, count(*) AS N, count(DISTINCT PORTADOR_ID) AS P FROM stg WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_IDENTIFICADO
  GROUP BY UG_ID, FAVORECIDO_ID, DATA_DT, VALOR_CENTAVOS HAVING count(*) >= 2 AND count(DISTINCT PORTADOR_ID) >= 2)
SELECT CASE WHEN P >= 5 THEN 'MUITO_ELEVADO' WHEN P >= 3 THEN 'ELEVADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM, count(*) AS N_GRUPOS,
  sum(N)::BIGINT AS N_TRANSACOES, sum(VALOR_CENTAVOS * N)::BIGINT AS TOTAL_CENTAVOS FROM g GROUP BY ALL""",
    ),
    "WIN-06": (
        lambda s, d: r(_t05(s, d), "CV", "MEDIANA", "Q1", "Q3", "IQR", "SHARE_MEDIANA"),
        f"{T05_SQL} SELECT {_T05_COLUMNS} FROM cand",
    ),
    "WIN-06b": (
        lambda s, d: r(rules.recurrence_windows(events(s, d, STEADY)), "CV", "MEDIANA", "Q1", "Q3", "IQR", "SHARE_MEDIANA"),
        f"{T05_SQL.replace(EV, f'WITH {STEADY_SQL}', 1).replace('INTERVAL 3 DAY', 'INTERVAL 30 DAY').replace('CV <= 0.6', 'CV <= 0.2')} SELECT {_T05_COLUMNS} FROM cand",
    ),
    "WIN-07": (_t05_episodes, T05_EPISODES_SQL),
    "JON-02": (
        lambda s, d: rules.recurrence_rows(events(s, d), rules.recurrence_episodes(_t05(s, d))).groupBy("ID_TRANSACAO").agg(F.count(F.lit(1)).alias("N")),
        T05_EPISODES_SQL.rpartition("\nSELECT")[0]
        + """ SELECT ID_TRANSACAO, count(*) AS N FROM stg e JOIN ranked k ON e.UG_ID = k.UG_ID AND e.FAVORECIDO_ID = k.FAVORECIDO_ID
  AND e.ANO_TRANSACAO = k.ANO_TRANSACAO AND e.DATA_DT BETWEEN k.INICIO AND k.FIM WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0 GROUP BY ALL""",
    ),
    "AGG-07": (_t06, f"{T06_SQL} {_T06_SELECT} FROM ind"),
    "AGG-08": (
        _t06_signals,
        f"""{T06_SQL} SELECT UG_ID, ANO_TRANSACAO, CASE WHEN TOP1_SHARE_VALOR >= 0.05 THEN 'REFORCADO' WHEN TOP1_SHARE_VALOR >= 0.03 THEN 'ELEVADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM,
  {_ids('UG_ID, ANO_TRANSACAO', 'T06')} AS ID_SINAL FROM ind WHERE N_COMPRAS >= 20 AND N_FORNECEDORES >= 3 AND COBERTURA >= 0.8 AND TOP1_SHARE_VALOR >= 0.02""",
    ),
    "JON-03": (
        _t06_rows,
        f"""{T06_SQL} SELECT {_ids('rows.UG_ID, rows.ANO_TRANSACAO', 'T06')} AS ID_SINAL, ID_TRANSACAO FROM rows JOIN ind ON rows.UG_ID = ind.UG_ID
  AND rows.ANO_TRANSACAO = ind.ANO_TRANSACAO AND rows.FAVORECIDO_ID = TOP1_FAVORECIDO_ID
WHERE N_COMPRAS >= 20 AND N_FORNECEDORES >= 3 AND COBERTURA >= 0.8 AND TOP1_SHARE_VALOR >= 0.02""",
    ),
    "AGG-09": (
        lambda s, d: _daily(s, d),
        f"""{T07_SQL} SELECT *, CASE WHEN N >= 3 THEN 'REFORCADO' ELSE 'ATENCAO' END AS NIVEL_TRIAGEM, {_ids('UG_ID, PORTADOR_ID, DATA_DT', 'T07D')} AS ID_EPISODIO FROM daily""",
    ),
    "JON-04": (
        lambda s, d: rules.daily_withdrawal_rows(events(s, d), _daily(s, d)),
        f"""{T07_SQL} SELECT {_ids('e.UG_ID, e.PORTADOR_ID, e.DATA_DT', 'T07D')} AS ID_EPISODIO, ID_TRANSACAO FROM stg e JOIN daily k
  ON e.UG_ID = k.UG_ID AND e.PORTADOR_ID = k.PORTADOR_ID AND e.DATA_DT = k.DATA_DT WHERE EH_SAQUE_EFETIVO""",
    ),
    "AGG-10": (
        lambda s, d: r(rules.withdrawal_recurrence(_daily(s, d)), "PERCENT_RANK_ANO", "P90_DIAS"),
        f"{T07_SQL} SELECT * REPLACE (round(PERCENT_RANK_ANO, 6) AS PERCENT_RANK_ANO, round(P90_DIAS, 6) AS P90_DIAS) FROM rec",
    ),
    "AGG-11": (
        lambda s, d: rules.withdrawal_signals(rules.withdrawal_recurrence(_daily(s, d))).select("ID_SINAL", "N_DIAS"),
        f"{T07_SQL} SELECT {_ids('UG_ID, PORTADOR_ID, ANO_TRANSACAO', 'T07')} AS ID_SINAL, N_DIAS FROM rec WHERE PRIORITARIO",
    ),
    "AGG-12": (
        lambda s, d: r(rules.withdrawal_share(lines(s, d)), "SHARE_SAQUES"),
        f"""{LI} SELECT UG_ID, ANO_TRANSACAO, sum(CASE WHEN EH_SAQUE_EFETIVO THEN VALOR_CENTAVOS ELSE 0 END)::BIGINT AS SAQUES_CENTAVOS,
  sum(VALOR_CENTAVOS)::BIGINT AS OBSERVADO_CENTAVOS, round(sum(CASE WHEN EH_SAQUE_EFETIVO THEN VALOR_CENTAVOS ELSE 0 END)::DOUBLE / sum(VALOR_CENTAVOS), 6) AS SHARE_SAQUES
FROM stg WHERE EH_SAQUE_EFETIVO OR EH_COMPRA_EFETIVA GROUP BY ALL""",
    ),
    "AGG-13": (
        lambda s, d: r(_indicators(s, d), *_T08_ROUND),
        f"{T08_SQL} SELECT * REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in _T08_ROUND) + ") FROM ind",
    ),
    "WIN-03": (
        _ranked_out,
        f"{T08_RANK_SQL} SELECT * REPLACE (round(MAD_D2, 6) AS MAD_D2, round(P90_MAD, 6) AS P90_MAD, round(PERCENTIL_MAD::DOUBLE, 6) AS PERCENTIL_MAD) FROM ranked",
    ),
    "AGG-15b": (
        lambda s, d: benford.benford_signals(_ranked(s, d)).select("UG_ID", "ANO_TRANSACAO"),
        f"{T08_RANK_SQL} SELECT UG_ID, ANO_TRANSACAO FROM ranked WHERE TOP_DECIL",
    ),
    "AGG-14": (
        lambda s, d: r(benford.persistence(_ranked(s, d)), "MAD_MEDIO", "MAD_MAX", "RATIO"),
        f"""{T08_RANK_SQL} SELECT UG_ID, count(DISTINCT ANO_TRANSACAO) AS ANOS_COMPARAVEIS, count(*) FILTER (TOP_DECIL) AS ANOS_TOP_DECIL, min(ANO_TRANSACAO) AS PRIMEIRO_ANO,
  max(ANO_TRANSACAO) AS ULTIMO_ANO, round(avg(MAD_D2), 6) AS MAD_MEDIO, round(max(MAD_D2), 6) AS MAD_MAX,
  round(count(*) FILTER (TOP_DECIL) / count(DISTINCT ANO_TRANSACAO)::DOUBLE, 6) AS RATIO,
  count(DISTINCT ANO_TRANSACAO) >= 3 AND count(*) FILTER (TOP_DECIL) / count(DISTINCT ANO_TRANSACAO)::DOUBLE >= 0.5 AS ELEVADA
FROM ranked WHERE ANO_VALIDO GROUP BY ALL""",
    ),
    "AGG-15": (
        lambda s, d: r(benford.summation(lines(s, d)), "PROPORCAO", "DESVIO", places=8),
        f"""{LI}, {_ROWS}, s AS (SELECT left(VALOR_CENTAVOS::VARCHAR, 2)::INT AS DIGITO, sum(VALOR_CENTAVOS)::BIGINT AS v FROM rows WHERE VALOR_CENTAVOS >= 1000 GROUP BY ALL)
SELECT g.range::INT AS DIGITO, coalesce(v, 0) AS SOMA_CENTAVOS, round(coalesce(v, 0)::DOUBLE / (SELECT sum(v) FROM s), 8) AS PROPORCAO,
  round(coalesce(v, 0)::DOUBLE / (SELECT sum(v) FROM s) - 1 / 90::DOUBLE, 8) AS DESVIO FROM range(10, 100) g LEFT JOIN s ON g.range = s.DIGITO""",
    ),
    "AGG-24": (
        _scenarios,
        f"""{EV}, rows AS (SELECT s.CENARIO, VALOR_CENTAVOS FROM stg CROSS JOIN (VALUES ('TODOS', 0), ('SEM_MULTIPLOS_1', 100), ('SEM_MULTIPLOS_10', 1000),
  ('SEM_MULTIPLOS_50', 5000), ('SEM_MULTIPLOS_100', 10000)) s(CENARIO, m) WHERE VALOR_CENTAVOS > 0 AND (m = 0 OR VALOR_CENTAVOS % nullif(m, 0) <> 0)),
{_benford_sql(1, "CENARIO")} SELECT CENARIO, N_D1, round(MAD_D1, 6) AS MAD_D1, round(QUI2_D1, 6) AS QUI2_D1, {_mad_case(1)} AS CLASSE_D1 FROM m1""",
    ),
    "AGG-25": (
        _z,
        f"""{LI}, {_ROWS}, {_benford_sql(2, "ANO_TRANSACAO")} SELECT ANO_TRANSACAO, DIGITO, N, OBSERVADOS, round(ESPERADO, 6) AS ESPERADO, round(PROPORCAO, 6) AS PROPORCAO,
  round((CASE WHEN 1 / (2 * N::DOUBLE) < abs(PROPORCAO - ESPERADO) THEN abs(PROPORCAO - ESPERADO) - 1 / (2 * N::DOUBLE) ELSE abs(PROPORCAO - ESPERADO) END)
    / sqrt(ESPERADO * (1 - ESPERADO) / N), 6) AS Z FROM d2""",
    ),
    "AGG-26": (
        lambda s, d: benford.duplicated_values(events(s, d).filter("VALOR_CENTAVOS > 0")),
        f"""{EV} SELECT VALOR_CENTAVOS, CASE WHEN VALOR_CENTAVOS >= 1000 THEN left(VALOR_CENTAVOS::VARCHAR, 2)::INT END AS DIGITO, count(*) AS N
FROM stg WHERE VALOR_CENTAVOS > 0 GROUP BY ALL HAVING count(*) >= 2 ORDER BY N DESC, VALOR_CENTAVOS LIMIT 10000""",
    ),
    "JON-05": (
        lambda s, d: _classified(s, d).select("ID_TRANSACAO", "LIMITE_COMPRAS", "LIMITE_ENGENHARIA", "STATUS_COMPRAS", "STATUS_ENGENHARIA", "STATUS_T09", "NIVEL_TRIAGEM"),
        f"{T09_SQL} SELECT ID_TRANSACAO, LIMITE_COMPRAS, LIMITE_ENGENHARIA, C AS STATUS_COMPRAS, E AS STATUS_ENGENHARIA, STATUS_T09, NIVEL_TRIAGEM FROM cls",
    ),
    "FLT-11": (
        lambda s, d: rules.limit_signals(_classified(s, d)).select("ID_SINAL", "STATUS_T09"),
        f"{T09_SQL} SELECT {_ids('ID_TRANSACAO, C, E', 'T09')} AS ID_SINAL, STATUS_T09 FROM cls WHERE STATUS_T09 <> 'ABAIXO_FAIXAS'",
    ),
    "SET-03": (
        lambda s, d: rules.limit_scenarios(_classified(s, d)),
        f"""{T09_SQL} SELECT ID_TRANSACAO, VALOR_CENTAVOS, 'COMPRAS' AS CENARIO, LIMITE_COMPRAS AS LIMITE, C AS STATUS FROM cls
UNION ALL SELECT ID_TRANSACAO, VALOR_CENTAVOS, 'ENGENHARIA', LIMITE_ENGENHARIA, E FROM cls""",
    ),
    "SET-07": (
        lambda s, d: rules.limit_scenarios(_classified(s, d)).groupBy("CENARIO", "STATUS").agg(F.count(F.lit(1)).alias("N")),
        f"""{T09_SQL} SELECT 'COMPRAS' AS CENARIO, C AS STATUS, count(*) AS N FROM cls GROUP BY ALL
UNION ALL SELECT 'ENGENHARIA', E, count(*) FROM cls GROUP BY ALL""",
    ),
    "AGG-16": (
        lambda s, d: r(rules.limit_context(_classified(s, d)), "MAX_RATIO_COMPRAS", "SHARE_SINAIS"),
        f"""{T09_SQL} SELECT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, count(*) AS N_COMPRAS, count(*) FILTER (STATUS_T09 <> 'ABAIXO_FAIXAS') AS N_SINAIS,
  count(*) FILTER (STATUS_T09 = 'PROXIMO_LIMITE') AS N_PROXIMOS, count(*) FILTER (STATUS_T09 = 'ACIMA_AMBOS_CENARIOS') AS N_ACIMA_AMBOS,
  sum(VALOR_CENTAVOS)::BIGINT AS TOTAL_CENTAVOS, coalesce(sum(CASE WHEN STATUS_T09 <> 'ABAIXO_FAIXAS' THEN VALOR_CENTAVOS END), 0)::BIGINT AS SINAIS_CENTAVOS,
  round(max(VALOR_CENTAVOS / LIMITE_COMPRAS::DOUBLE), 6) AS MAX_RATIO_COMPRAS, round(count(*) FILTER (STATUS_T09 <> 'ABAIXO_FAIXAS') / count(*)::DOUBLE, 6) AS SHARE_SINAIS
FROM cls WHERE FAVORECIDO_ID IS NOT NULL GROUP BY ALL""",
    ),
}
