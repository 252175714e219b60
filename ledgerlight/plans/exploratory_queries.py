"""Descriptive and identity tables, calibration, master tables and text classification over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import exploratory as ex
from ..operators import rules, windows
from .adapters import BOTH_SQL, _table, both, events, lines
from .rule_queries import EV, LI, T07_SQL, r

_DIST = ["MEDIA", "MEDIANA", "DESVIO", "ASSIMETRIA", "P99", "SHARE_INTEIROS", "SHARE_DEZENAS"]
CASCADE = [("A", ["thion", "erat"]), ("B", ["\\bde\\b"]), ("C", ["\\bder\\b|\\bdie\\b"])]


def _grid(spark, d):
    rows = windows.recurring_purchases(both(spark, d), "PORTADOR_ID")
    return r(windows.calibration_grid(windows.window_metrics(rows, windows.LENGTHS)), "VALOR_REPRESENTATIVO", "CV_MEDIO", "CV_MEDIANO")


def _values(values) -> str:
    return ", ".join(f"({v})" for v in values)


GRID_SQL = f"""WITH {BOTH_SQL}, e AS (SELECT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, PORTADOR_ID, DATA_DT, VALOR_CENTAVOS AS V FROM stg
  WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS > 0 AND FAVORECIDO_IDENTIFICADO AND DATA_DT IS NOT NULL AND PORTADOR_ID IS NOT NULL),
a AS (SELECT DISTINCT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, DATA_DT AS INICIO, w FROM e CROSS JOIN (VALUES {_values(windows.LENGTHS)}) l(w)),
m AS (SELECT UG_ID, FAVORECIDO_ID, ANO_TRANSACAO, INICIO, w, count(*) AS K, count(DISTINCT PORTADOR_ID) AS Q, sum(V)::BIGINT AS T, stddev_pop(V::DOUBLE) / avg(V::DOUBLE) AS CV
  FROM a JOIN e USING (UG_ID, FAVORECIDO_ID, ANO_TRANSACAO) WHERE DATA_DT BETWEEN INICIO AND INICIO + to_days(w::INT) GROUP BY ALL HAVING count(*) >= 3 AND count(DISTINCT PORTADOR_ID) >= 2),
g AS (SELECT w, n, p, c::DOUBLE AS c FROM (VALUES {_values(windows.LENGTHS)}) x(w), (VALUES {_values(windows.PURCHASES)}) y(n), (VALUES {_values(windows.CARDS)}) z(p), (VALUES {_values(windows.VARIATIONS)}) v(c)),
b AS (SELECT g.*, m.* EXCLUDE (w), row_number() OVER (PARTITION BY g.w, g.n, g.p, g.c, UG_ID, FAVORECIDO_ID, ANO_TRANSACAO ORDER BY K DESC, Q DESC, CV, T DESC, INICIO) AS rn
  FROM g JOIN m ON g.w = m.w AND K >= g.n AND Q >= g.p AND CV <= g.c)
SELECT g.w AS JANELA_DIAS, g.n AS MIN_N, g.p AS MIN_P, g.c AS MAX_CV, count(b.UG_ID) AS N_GRUPOS, sum(K)::BIGINT AS TRANSACOES_REPRESENTATIVAS, round(sum(T) / 100.0, 6) AS VALOR_REPRESENTATIVO,
  round(avg(CV), 6) AS CV_MEDIO, round(median(CV), 6) AS CV_MEDIANO FROM g LEFT JOIN (SELECT w, n, p, c, K, T, CV, UG_ID FROM b WHERE rn = 1) b USING (w, n, p, c) GROUP BY ALL"""


def _signals(spark, d):
    staged = events(spark, d)
    daily = rules.daily_withdrawals(staged)
    many = rules.multi_cardholder(staged).withColumn("ANO_TRANSACAO", F.year("DATA_DT"))
    return ex.master_signals(
        {
            "T07": (daily, "ID_EPISODIO", {"n": F.col("N"), "total": F.col("TOTAL_CENTAVOS")}),
            "T04": (many, "ID_GRUPO", {"n": F.col("N"), "portadores": F.col("N_PORTADORES")}),
        }
    ).drop("ID_SINAL")


def _bridge(spark, d):
    staged = events(spark, d)
    bridge = ex.master_bridge(
        {
            "T07": (rules.daily_withdrawal_rows(staged, rules.daily_withdrawals(staged)), "ID_EPISODIO"),
            "T04": (rules.multi_cardholder_rows(staged, rules.multi_cardholder(staged)), "ID_GRUPO"),
        }
    )
    return bridge.groupBy("TRILHA").agg(F.count(F.lit(1)).alias("N"), F.count_distinct("ID_SINAL").alias("N_SINAIS"))


def _agreement(spark, d):
    """The words of each turn against those of the turn before it, both whole."""
    c = _table(spark, d, "conversations").filter("text IS NOT NULL")
    words = F.array_distinct(F.split("text", " "))
    turns = c.groupBy("conv_id", "turn").agg(F.max("text").alias("text")).select("conv_id", "turn", words.alias("p"))
    pairs = turns.withColumn("e", F.lag("p").over(Window.partitionBy("conv_id").orderBy("turn"))).filter("e IS NOT NULL")
    return r(ex.set_agreement(pairs, "p", "e").groupBy("conv_id").agg(F.count_if("EXATO").alias("N_EXATO"), F.avg("PRECISAO").alias("PRECISAO"), F.avg("COBERTURA").alias("COBERTURA")), "PRECISAO", "COBERTURA")


AGREEMENT_SQL = """WITH t AS (SELECT conv_id, turn, list_distinct(string_split(max(text), ' ')) AS p FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
w AS (SELECT conv_id, p, lag(p) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t),
c AS (SELECT conv_id, len(p) AS n, len(e) AS m, len(list_intersect(p, e)) AS k FROM w WHERE e IS NOT NULL)
SELECT conv_id, count(*) FILTER (k = n AND k = m) AS N_EXATO, round(avg(k / n::DOUBLE), 6) AS PRECISAO, round(avg(k / m::DOUBLE), 6) AS COBERTURA FROM c GROUP BY ALL"""


def _routes(spark, d):
    routed = _table(spark, d, "documents").select(ex.route(F.col("text"), CASCADE, "D").alias("ROTA"))
    return routed.groupBy("ROTA").agg(F.count(F.lit(1)).alias("N"))


T04_SQL = f"""m AS (SELECT UG_ID, FAVORECIDO_ID, DATA_DT, VALOR_CENTAVOS, count(*) AS N, count(DISTINCT PORTADOR_ID) AS P FROM stg
  WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_IDENTIFICADO GROUP BY ALL HAVING count(*) >= 2 AND count(DISTINCT PORTADOR_ID) >= 2)"""
DIST_SQL = """count(*) AS N, round(avg(VALOR_CENTAVOS::DOUBLE), 6) AS MEDIA, round(median(VALOR_CENTAVOS::DOUBLE), 6) AS MEDIANA, round(stddev_pop(VALOR_CENTAVOS::DOUBLE), 6) AS DESVIO,
  round(skewness(VALOR_CENTAVOS::DOUBLE), 6) AS ASSIMETRIA, min(VALOR_CENTAVOS)::DOUBLE AS MINIMO, max(VALOR_CENTAVOS)::DOUBLE AS MAXIMO,
  round(quantile_cont(VALOR_CENTAVOS::DOUBLE, 0.99), 6) AS P99, round(avg((VALOR_CENTAVOS % 100 = 0)::INT), 6) AS SHARE_INTEIROS, round(avg((VALOR_CENTAVOS % 1000 = 0)::INT), 6) AS SHARE_DEZENAS"""

#: ``\\b`` beside a letter, where letters beyond ASCII count too, as they do in the cascade's patterns; DuckDB's own knows ASCII only.
_EDGE = "[^\\pL\\p{Nd}_]"


def _whole(*words: str) -> str:
    return f"(^|{_EDGE})({'|'.join(words)})($|{_EDGE})"


QUERIES = {
    "AGG-22": (lambda s, d: ex.by_code(lines(s, d)), f"{LI} SELECT TRANSACAO AS CODIGO, count(*) AS N, sum(VALOR_CENTAVOS)::BIGINT AS TOTAL_CENTAVOS FROM stg GROUP BY ALL"),
    "AGG-22b": (lambda s, d: r(ex.value_distribution(lines(s, d), ["ANO_TRANSACAO"]), *_DIST), f"{LI} SELECT ANO_TRANSACAO, {DIST_SQL} FROM stg GROUP BY ALL"),
    "AGG-22c": (lambda s, d: ex.frequent_values(events(s, d)), f"{EV} SELECT VALOR_CENTAVOS, count(*) AS N FROM stg GROUP BY ALL ORDER BY N DESC, VALOR_CENTAVOS LIMIT 200"),
    "AGG-23": (
        lambda s, d: r(ex.benford_suitability(events(s, d)), "MEDIA", "MEDIANA", "ASSIMETRIA", "ORDENS", "SHARE_TOP"),
        f"""{EV} SELECT count(*) AS N, count(DISTINCT VALOR_CENTAVOS) AS UNICOS, round(avg(VALOR_CENTAVOS::DOUBLE), 6) AS MEDIA, round(median(VALOR_CENTAVOS::DOUBLE), 6) AS MEDIANA,
  round(skewness(VALOR_CENTAVOS::DOUBLE), 6) AS ASSIMETRIA, round(log10(max(VALOR_CENTAVOS)::DOUBLE / min(VALOR_CENTAVOS)), 6) AS ORDENS,
  round((SELECT sum(n) FROM (SELECT count(*) AS n FROM stg GROUP BY VALOR_CENTAVOS ORDER BY n DESC, VALOR_CENTAVOS LIMIT 5))::DOUBLE / count(*), 6) AS SHARE_TOP FROM stg""",
    ),
    "AGG-27": (
        lambda s, d: ex.drill_down(lines(s, d).filter("EH_COMPRA_NACIONAL"), [10, 20, 35, 99], 5),
        f"""{LI}, g AS (SELECT left(VALOR_CENTAVOS::VARCHAR, 2)::INT AS DIGITO, VALOR_CENTAVOS, count(*) AS N, count(DISTINCT UG_ID) AS N_UG, count(DISTINCT FAVORECIDO_ID) AS N_FORNECEDORES,
  count(DISTINCT PORTADOR_ID) AS N_PORTADORES FROM stg WHERE EH_COMPRA_NACIONAL AND VALOR_CENTAVOS >= 1000 AND left(VALOR_CENTAVOS::VARCHAR, 2) IN ('10', '20', '35', '99') GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY DIGITO ORDER BY N DESC, VALOR_CENTAVOS)::INT AS ORDEM FROM g) WHERE ORDEM <= 5""",
    ),
    "GOV-07": (_grid, GRID_SQL),
    "SET-10-daily": (
        _signals,
        f"""{T07_SQL}, {T04_SQL} SELECT 'T07' AS TRILHA, CASE WHEN N >= 3 THEN 'REFORCADO' ELSE 'ATENCAO' END AS NIVEL, UG_ID, ANO_TRANSACAO AS ANO,
  '{{"n":' || N || ',"total":' || TOTAL_CENTAVOS || '}}' AS EVIDENCIA FROM daily
UNION ALL SELECT 'T04', CASE WHEN P >= 5 THEN 'MUITO_ELEVADO' WHEN P >= 3 THEN 'ELEVADO' ELSE 'ATENCAO' END, UG_ID, year(DATA_DT)::INT,
  '{{"n":' || N || ',"portadores":' || P || '}}' FROM m""",
    ),
    "SET-08-daily": (
        _bridge,
        f"""{T07_SQL}, {T04_SQL} SELECT 'T07' AS TRILHA, sum(N)::BIGINT AS N, count(*) AS N_SINAIS FROM daily UNION ALL SELECT 'T04', sum(N)::BIGINT, count(*) FROM m""",
    ),
    "JON-13": (
        lambda s, d: ex.compare_counts(
            lines(s, d).filter("ANO_TRANSACAO < 1998").groupBy("ANO_TRANSACAO").agg(F.count(F.lit(1)).alias("N")),
            lines(s, d).filter("ANO_TRANSACAO > 1995 AND EH_COMPRA_NACIONAL").groupBy("ANO_TRANSACAO").agg(F.count(F.lit(1)).alias("N")),
            "ANO_TRANSACAO",
            "N",
        ),
        f"""{LI} SELECT coalesce(a.y, b.y) AS ANO_TRANSACAO, a.n AS ATUAL, b.n AS ESPERADO, a.n IS NOT DISTINCT FROM b.n AS IGUAL
FROM (SELECT ANO_TRANSACAO AS y, count(*) AS n FROM stg WHERE ANO_TRANSACAO < 1998 GROUP BY 1) a
FULL JOIN (SELECT ANO_TRANSACAO AS y, count(*) AS n FROM stg WHERE ANO_TRANSACAO > 1995 AND EH_COMPRA_NACIONAL GROUP BY 1) b ON a.y = b.y""",
    ),
    "EVL-03": (_agreement, AGREEMENT_SQL),
    "EVL-05": (
        lambda s, d: r(ex.modal_share(_table(s, d, "events"), "user_id", "event_type"), "ESTABILIDADE"),
        """SELECT user_id, round(max(n) / sum(n)::DOUBLE, 6) AS ESTABILIDADE, sum(n)::BIGINT AS N
FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY ALL""",
    ),
    "TXT-08": (
        _routes,
        f"""SELECT CASE WHEN regexp_matches(t, 'thion|erat') THEN 'A' WHEN regexp_matches(t, '{_whole("de")}') THEN 'B' WHEN regexp_matches(t, '{_whole("der", "die")}') THEN 'C' ELSE 'D' END AS ROTA, count(*) AS N
FROM (SELECT lower(strip_accents(coalesce(text, ''))) AS t FROM documents) GROUP BY ALL""",
    ),
    "TXT-10": (
        lambda s, d: _table(s, d, "conversations").groupBy(ex.question_problem(F.col("text"), 300).alias("PROBLEMA")).agg(F.count(F.lit(1)).alias("N")),
        r"""SELECT CASE WHEN trim(coalesce(text, '')) = '' THEN 'VAZIA' WHEN length(text) > 300 THEN 'LONGA' WHEN regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]') THEN 'CONTROLE'
  WHEN regexp_matches(text, '(?i)\b(insert\s+into|update\s+\w+\s+set|delete\s+from|drop\s+(table|view)|alter\s+table|truncate\s+table)\b') THEN 'MUTACAO' END AS PROBLEMA, count(*) AS N
FROM conversations GROUP BY ALL""",
    ),
}
