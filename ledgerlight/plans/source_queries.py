"""From text to a bundle, and the register of units, over text that Spark writes from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules
from ..sources import bundle, probe, registry, scratch
from .adapters import TEST_LIMITS, _table, raw_lines
from .build import build_bundle
from .diagnostic_queries import YEARS
from .governance_queries import SETTINGS, UF_OF_NATION
from .rule_queries import STAGED_TEXT_SQL

MANUAL = {"999998": ("SP", "Unidade manual"), "999999": ("EX", "Unidade no exterior")}


def _bundle(spark, d):
    """The tables of a bundle built from the order lines as text: name, rows, columns, and whether the check against the manifest passed."""
    text, folder = scratch.new_folder(spark, "text"), scratch.new_folder(spark, "bundle")
    raw_lines(spark, d).drop("ID_TRANSACAO").write.option("sep", ";").option("header", True).csv(text)
    manifest = build_bundle(spark, text, folder, rules.limits_table(spark, TEST_LIMITS), SETTINGS, YEARS)
    stated = spark.createDataFrame([(t["name"], t["rows"]) for t in manifest["tables"]], "NOME string, N_LINHAS long")
    known = F.col("NOME").rlike("^(staging|matrix_|overlap_|marginal_|.*_eligibility)")
    return stated.filter(known).join(bundle.check_bundle(spark, folder).select("NOME", "OK"), "NOME")


def _sizes() -> str:
    """Rows of each table from the universes' sizes, years, bands and deciles."""
    parts = ["SELECT 'staging' AS NOME, (SELECT count(*) FROM st) AS N_LINHAS", "SELECT 'matrix_supplier_year', (SELECT count(*) FROM su)", "SELECT 'matrix_ug_year', (SELECT count(*) FROM ud)"]
    for side, cut, strata, sizes in (("supplier", "exposure", "nb", {"trails": 6, "families": 3}), ("ug", "decile", "nd", {"trails": 7, "families": 4})):
        for kind, k in sizes.items():
            pairs = k * (k - 1) // 2
            name = f"{side}_{kind}"
            parts += [
                f"SELECT 'overlap_{name}', {pairs}", f"SELECT 'overlap_{name}_by_{cut}', {pairs} * {strata} FROM z",
                f"SELECT 'marginal_{name}', {k}", f"SELECT 'marginal_{name}_by_{cut}', {k} * {strata} FROM z",
            ]
            parts += [f"SELECT '{t}_{name}_eligibility', {k}" for t in ("multicollinearity", "pca")]
            parts += [f"SELECT '{t}_{name}_eligibility_by_exposure', {k} * {strata} FROM z" for t in ("multicollinearity", "pca")]
            if kind == "trails":
                parts.append(f"SELECT 'overlap_{name}_by_year', {pairs} * {'ys' if side == 'supplier' else 'yu'} FROM z")
    return " UNION ALL ".join(parts)


BUNDLE_SQL = f"""WITH st AS ({STAGED_TEXT_SQL}), ok AS (SELECT *, year(DATA_DT) AS ANO FROM st WHERE (EH_COMPRA_EFETIVA OR EH_SAQUE_EFETIVO) AND VALOR_CENTAVOS > 0 AND DATA_DT IS NOT NULL),
su AS (SELECT ANO, count(*) AS n FROM ok WHERE EH_COMPRA_EFETIVA AND FAVORECIDO_ID IS NOT NULL GROUP BY UG_ID, FAVORECIDO_ID, ANO),
uu AS (SELECT UG_ID, ANO, count(*) AS n FROM ok GROUP BY ALL),
ud AS (SELECT ANO, ceil(10 * (rank() OVER (PARTITION BY ANO ORDER BY n) + (count(*) OVER (PARTITION BY ANO, n) - 1) / 2.0) / count(*) OVER (PARTITION BY ANO)) AS d FROM uu),
z AS (SELECT (SELECT count(DISTINCT CASE WHEN n >= 20 THEN 20 WHEN n >= 10 THEN 10 WHEN n >= 5 THEN 5 WHEN n >= 3 THEN 3 ELSE n END) FROM su WHERE ANO BETWEEN {YEARS[0]} AND {YEARS[1]}) AS nb,
  (SELECT count(DISTINCT least(greatest(d, 1), 10)) FROM ud WHERE ANO BETWEEN {YEARS[0]} AND {YEARS[1]}) AS nd,
  (SELECT count(DISTINCT ANO) FROM su WHERE ANO BETWEEN {YEARS[0]} AND {YEARS[1]}) AS ys, (SELECT count(DISTINCT ANO) FROM ud WHERE ANO BETWEEN {YEARS[0]} AND {YEARS[1]}) AS yu)
SELECT NOME, N_LINHAS::BIGINT AS N_LINHAS, TRUE AS OK FROM ({_sizes()})"""


def _register(spark, d):
    """Suppliers as units: a register of one text file, read back with line numbers and completed by hand."""
    folder = scratch.new_folder(spark, "register")
    state = F.element_at(F.array(*map(F.lit, UF_OF_NATION)), (F.col("s_nationkey") % 7 + 1).cast("int"))
    quoted = lambda *cs: F.concat(F.lit('"'), F.concat_ws('","', *cs), F.lit('"'))
    lines = _table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("long").alias("n"),
        quoted(F.col("s_suppkey").cast("string"), F.concat(F.lit("Unidade, "), "s_name"), state, F.col("s_nationkey").cast("string"), F.lit("x")).alias("value"),
    )
    heading = spark.createDataFrame([(-1, '"UG","TITULO","UF","ORGAO","FIM"')], "n long, value string")
    heading.unionAll(lines).repartition(1).sortWithinPartitions("n").select("value").write.text(folder)
    units = registry.read_units(spark, folder, "2025", expected=_table(spark, d, "supplier").count())
    return registry.completed(units, MANUAL, "2026-08-13")


REGISTER_SQL = f"""SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS UG_ID, {list(UF_OF_NATION)}[s_nationkey % 7 + 1] AS UF_UG, lpad(s_nationkey::VARCHAR, 5, '0') AS CODIGO_ORGAO_SIAFI,
  'Unidade, ' || s_name AS TITULO_UG_SIAFI, 'CADASTRO_SIAFI_2025' AS FONTE_UF, 'CADASTRO_SIAFI' AS TIPO_FONTE_UF, '2025' AS VERSAO_FONTE_UF,
  row_number() OVER (ORDER BY s_suppkey) + 1 AS LINHA_ORIGEM_SIAFI FROM supplier
UNION ALL SELECT u, uf, NULL, t, 'COMPLEMENTO_MANUAL_2026-08-13', 'COMPLEMENTO_MANUAL', '2026-08-13', NULL FROM (VALUES {", ".join(f"('{u}', '{uf}', '{t}')" for u, (uf, t) in MANUAL.items())}) m(u, uf, t)"""

def _consolidated(spark, d):
    """Yearly texts of three layouts (delimiter, encoding, a column that is missing or elsewhere) read together, and what each year has."""
    rows = raw_lines(spark, d).drop("ID_TRANSACAO").withColumn("_year", F.col("ANO EXTRATO").cast("int"))
    first, *rest = [c for c in rows.columns if c != "_year"]
    made = {0: ([first, *rest], ";", "UTF-8"), 1: ([*rest, first], "\t", "ISO-8859-1"), 2: ([first, *(c for c in rest if c != "NOME FAVORECIDO")], ";", "UTF-8")}
    folders = []
    for kind, (columns, sep, encoding) in made.items():
        folders.append(scratch.new_folder(spark, f"layout{kind}"))
        rows.filter(F.col("_year") % 3 == kind).select(columns).write.option("sep", sep).options(header=True, encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(folders[-1])
    whole = probe.consolidate(spark, folders)
    return whole.groupBy("ANO EXTRATO", "NOME PORTADOR").agg(
        F.count(F.lit(1)).alias("N"), F.count_if(F.col("NOME FAVORECIDO") == "").alias("N_SEM_NOME"), F.count_if(F.col("NOME ÓRGÃO") == "Órgão").alias("N_ORGAO")
    )


CONSOLIDATED_SQL = """SELECT strftime(l_shipdate, '%Y') AS "ANO EXTRATO", CASE WHEN o_custkey % 9 = 0 THEN 'Portador Sigiloso: sigilo' ELSE '  José  ' || c_mktsegment END AS "NOME PORTADOR",
  count(*) AS N, count(*) FILTER (year(l_shipdate) % 3 = 2) AS N_SEM_NOME, count(*) AS N_ORGAO
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""

QUERIES = {"PIP-05": (_bundle, BUNDLE_SQL), "SRC-06": (_register, REGISTER_SQL), "SRC-14": (_consolidated, CONSOLIDATED_SQL)}
