"""The staged fact made from order lines and from events, for Spark and as DuckDB text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import rules
from ..sources import scratch

# National purchases, international purchases, instalments and withdrawals by line status.
LINE_CODES = {
    "AF": model.NATIONAL,
    "AO": model.NATIONAL,
    "NF": model.NATIONAL,
    "NO": model.WITHDRAWALS[3],
    "RF": model.INTERNATIONAL,
    "RO": model.INSTALMENT,
}
EVENT_CODES = {
    "purchase": model.NATIONAL,
    "click": model.NATIONAL,
    "view": model.NATIONAL,
    "error": model.WITHDRAWALS[0],
    "signup": model.WITHDRAWALS[3],
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(key, codes: dict[str, str]):
    out = F.lit("OUTRO")
    for k, v in codes.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def _flags(df: DataFrame) -> DataFrame:
    code = F.col("TRANSAÇÃO")
    return df.withColumns(
        {
            "PORTADOR_ID_BASELINE": F.col("PORTADOR_ID"),
            "FAVORECIDO_IDENTIFICADO": F.col("FAVORECIDO_ID").isNotNull(),
            "ANO_TRANSACAO": F.year("DATA_DT"),
            "ANO_EXTRATO_GEO": F.year("DATA_DT"),
            "VALOR_NUM": F.col("VALOR_CENTAVOS").cast("double") / 100,
            "EH_COMPRA_EFETIVA": code.isin(*model.PURCHASES),
            "EH_COMPRA_NACIONAL": code == model.NATIONAL,
            "EH_SAQUE_EFETIVO": code.isin(*model.WITHDRAWALS),
            "EH_AJUSTE_CONTESTACAO": F.lit(False),
            "EH_SIGILOSO": F.col("FAVORECIDO_ID").isNull(),
        }
    )


#: The columns that a transaction's id is made of, by fact.
_LINE_ID, _EVENT_ID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["event_id"]


def _id(parts: Iterable[Column]) -> Column:
    return F.nullif(F.concat_ws("-", *(p.cast("string") for p in parts)), F.lit(""))


def _identified(rows: DataFrame, key: list[str], whole: bool = True) -> DataFrame:
    """``rows`` with ID_TRANSACAO, first, in place of the columns that it is made of: their text, or if not ``whole`` the columns themselves, for ``id_text``."""
    made = _id(map(F.col, key)) if whole else F.struct(*key)
    return rows.select(made.alias("ID_TRANSACAO"), *(c for c in rows.columns if c not in key))


def id_text(parts: Column) -> Column:
    """The text of an ID_TRANSACAO of ``dealt_rows``."""
    return _id(parts[k] for k in _LINE_ID + _EVENT_ID)


def _ordered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with their orders and customers. The lines are moved once and not sorted: they look up their order, with its customer, in what their part holds."""
    li, o, c = (_table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    ordered = o.join(c, o["o_custkey"] == c["c_custkey"])
    return li.join(ordered.hint("shuffle_hash"), li["l_orderkey"] == o["o_orderkey"])


def _line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = F.when(F.col("l_suppkey") % 10 != 0, F.lpad(F.col("l_suppkey").cast("string"), 14, "0"))
    return _ordered_lines(spark, sf_dir).select(
        *_LINE_ID,
        F.lpad(F.col("c_nationkey").cast("string"), 6, "0").alias("UG_ID"),
        F.col("o_custkey").cast("string").alias("PORTADOR_ID"),
        supplier.alias("FAVORECIDO_ID"),
        F.to_date("l_shipdate").alias("DATA_DT"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("VALOR_CENTAVOS"),
        _mapped(F.concat("l_returnflag", "l_linestatus"), LINE_CODES).alias("TRANSAÇÃO"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines: the unit is the customer's nation, the cardholder the customer, the supplier the line's."""
    return _flags(_identified(_line_rows(spark, sf_dir), _LINE_ID))


def _event_rows(spark: SparkSession, sf_dir: str, base: int) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    supplier = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 7).cast("string"))
    return e.select(
        *_EVENT_ID,
        F.lpad((F.col("user_id") % 10).cast("string"), 6, "0").alias("UG_ID"),
        F.col("user_id").cast("string").alias("PORTADOR_ID"),
        supplier.alias("FAVORECIDO_ID"),
        F.to_date("ts").alias("DATA_DT"),
        (base + (F.floor(F.col("value") / 10) + 1) * 1000).cast("bigint").alias("VALOR_CENTAVOS"),
        _mapped(F.col("event_type"), EVENT_CODES).alias("TRANSAÇÃO"),
    )


def events(spark: SparkSession, sf_dir: str, base: int = 0) -> DataFrame:
    """Events: ten units, users as cardholders, seven suppliers, rounded amounts on top of ``base`` cents."""
    return _flags(_identified(_event_rows(spark, sf_dir, base), _EVENT_ID))


def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose masked card ids stand for several people: twenty users share one, two of them in each unit; every 50th row has none.

    Few amounts make repetitions and recurrences common; every other purchase is at a supplier that only one masked id uses. The candidate identity is unit, masked id and name.
    """
    e = _table(spark, sf_dir, "events")
    masked = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit("M"), F.floor(F.col("user_id") / 20).cast("string")))
    name = F.concat(F.lit("N"), F.col("user_id").cast("string"))
    unit = F.lpad((F.col("user_id") % 10).cast("string"), 6, "0")
    return _flags(
        e.select(
            F.col("event_id").cast("string").alias("ID_TRANSACAO"),
            unit.alias("UG_ID"),
            F.concat_ws("|", unit, masked, name).alias("PORTADOR_ID"),
            masked.alias("_MASKED"),
            name.alias("NOME_PORTADOR_NORMALIZADO"),
            F.when(F.col("event_id") % 2 == 0, "A").otherwise(F.concat(F.lit("S"), F.floor(F.col("user_id") / 20).cast("string"))).alias("FAVORECIDO_ID"),
            F.to_date("ts").alias("DATA_DT"),
            ((F.col("event_id") % 3 + 10) * 1000).cast("bigint").alias("VALOR_CENTAVOS"),
            _mapped(F.col("event_type"), EVENT_CODES).alias("TRANSAÇÃO"),
        )
    ).withColumn("PORTADOR_ID_BASELINE", F.col("_MASKED")).withColumn("PORTADOR_ID", F.when(F.col("_MASKED").isNotNull(), F.col("PORTADOR_ID"))).drop("_MASKED")


_FACTS: dict = {}
_DEALT: dict = {}
_DEALT_ROWS: dict = {}


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and events as one fact; their years differ.

    The rules and matrices read it some thirty times, so its joins are run once per session and state of the tables, and it is written without the flags.
    Most of them need no ids, so these are made of their parts by those that read them.
    """
    key = scratch.state(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer", "events")))
    if key not in _FACTS:
        _FACTS[key] = scratch.written(_line_rows(spark, sf_dir).unionByName(_event_rows(spark, sf_dir, 0), allowMissingColumns=True), "fact")
    return _flags(_identified(_FACTS[key], _LINE_ID + _EVENT_ID))


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``both`` without ids, dealt by unit and supplier once per session and state of the tables: rules and matrices that group by these and more move no rows again."""
    key = scratch.state(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer", "events")))
    if key not in _DEALT:
        rows = _line_rows(spark, sf_dir).drop(*_LINE_ID).unionByName(_event_rows(spark, sf_dir, 0).drop(*_EVENT_ID))
        _DEALT[key] = scratch.dealt(rows, "dealt_fact", rules.DEALT, scratch.size_of(key))
    return _flags(_DEALT[key])


def dealt_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """``both`` dealt as ``dealt`` is, with its ids, and the number of its parts. Ids are the numbers that their texts (``id_text``) are made of, as few rows need a text."""
    key = scratch.state(spark, *(f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "customer", "events")))
    if key not in _DEALT_ROWS:
        rows = _line_rows(spark, sf_dir).unionByName(_event_rows(spark, sf_dir, 0), allowMissingColumns=True)
        _DEALT_ROWS[key] = scratch.dealt(rows, "dealt_rows", rules.DEALT, scratch.size_of(key))
    return _flags(_identified(_DEALT_ROWS[key], _LINE_ID + _EVENT_ID, whole=False)), scratch.parts_of(spark, scratch.size_of(key))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as raw text in the delimited file's 15 columns."""
    joined = _ordered_lines(spark, sf_dir)
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    units = F.floor(cents / 100)
    grouped = F.when(units >= 1000, F.concat(F.floor(units / 1000).cast("string"), F.lit("."), F.lpad((units % 1000).cast("string"), 3, "0")))
    amount = F.concat(F.coalesce(grouped, units.cast("string")), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"))
    values = {
        "CÓDIGO ÓRGÃO SUPERIOR": F.lit("00001"),
        "NOME ÓRGÃO SUPERIOR": F.lit("Órgão"),
        "CÓDIGO ÓRGÃO": F.lit("00010"),
        "NOME ÓRGÃO": F.lit("Órgão"),
        "CÓDIGO UNIDADE GESTORA": F.concat(F.lit(" "), F.col("c_nationkey").cast("string")),
        "NOME UNIDADE GESTORA": F.lit("Unidade"),
        "ANO EXTRATO": F.date_format("l_shipdate", "yyyy"),
        "MÊS EXTRATO": F.date_format("l_shipdate", "MM"),
        "CPF PORTADOR": F.concat(F.lit("***."), F.col("o_custkey").cast("string"), F.lit(".-**")),
        "NOME PORTADOR": F.when(F.col("o_custkey") % 9 == 0, "Portador Sigiloso: sigilo").otherwise(F.concat(F.lit("  José  "), F.col("c_mktsegment"))),
        "CNPJ OU CPF FAVORECIDO": F.when(F.col("l_suppkey") % 10 == 0, "-1").otherwise(F.col("l_suppkey").cast("string")),
        "NOME FAVORECIDO": F.when(F.col("l_suppkey") % 11 == 0, "Sem informação").otherwise("Loja"),
        "TRANSAÇÃO": F.concat(_mapped(F.concat("l_returnflag", "l_linestatus"), LINE_CODES), F.lit(" ")),
        "DATA TRANSAÇÃO": F.when(F.col("l_linenumber") == 7, "").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")),
        "VALOR TRANSAÇÃO": F.when(F.col("l_linenumber") == 6, F.concat(F.lit("(R$ "), amount, F.lit(")"))).otherwise(amount),
    }
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ID_TRANSACAO")
    return joined.select(key, *(v.alias(k) for k, v in values.items()))


def _case(key: str, codes: dict[str, str]) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.items()) + " ELSE 'OUTRO' END"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_FLAGS_SQL = f"""
SELECT *, PORTADOR_ID AS PORTADOR_ID_BASELINE, FAVORECIDO_ID IS NOT NULL AS FAVORECIDO_IDENTIFICADO,
  year(DATA_DT)::INT AS ANO_TRANSACAO, year(DATA_DT)::INT AS ANO_EXTRATO_GEO, VALOR_CENTAVOS::DOUBLE / 100 AS VALOR_NUM,
  TRANSACAO IN {_in(model.PURCHASES)} AS EH_COMPRA_EFETIVA, TRANSACAO = '{model.NATIONAL}' AS EH_COMPRA_NACIONAL,
  TRANSACAO IN {_in(model.WITHDRAWALS)} AS EH_SAQUE_EFETIVO, FALSE AS EH_AJUSTE_CONTESTACAO, FAVORECIDO_ID IS NULL AS EH_SIGILOSO
FROM base"""

#: The fact ``stg`` from order lines, as common table expressions.
LINES_SQL = f"""base AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS ID_TRANSACAO,
    lpad(c_nationkey::VARCHAR, 6, '0') AS UG_ID, o_custkey::VARCHAR AS PORTADOR_ID,
    CASE WHEN l_suppkey % 10 <> 0 THEN lpad(l_suppkey::VARCHAR, 14, '0') END AS FAVORECIDO_ID,
    l_shipdate::DATE AS DATA_DT, round(l_extendedprice * 100)::BIGINT AS VALOR_CENTAVOS,
    {_case("l_returnflag || l_linestatus", LINE_CODES)} AS TRANSACAO
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), stg AS ({_FLAGS_SQL})"""

#: The fact ``stg`` from events.
EVENTS_SQL = f"""base AS (
  SELECT event_id::VARCHAR AS ID_TRANSACAO, lpad((user_id % 10)::VARCHAR, 6, '0') AS UG_ID, user_id::VARCHAR AS PORTADOR_ID,
    CASE WHEN event_id % 7 <> 0 THEN (event_id % 7)::VARCHAR END AS FAVORECIDO_ID, ts::DATE AS DATA_DT,
    ((floor(value / 10) + 1) * 1000)::BIGINT AS VALOR_CENTAVOS,
    {_case("event_type", EVENT_CODES)} AS TRANSACAO
  FROM events
), stg AS ({_FLAGS_SQL})"""

#: The fact ``nm`` from events with masked ids and names.
NAMED_SQL = f"""nb AS (
  SELECT event_id::VARCHAR AS ID_TRANSACAO, lpad((user_id % 10)::VARCHAR, 6, '0') AS UG_ID,
    CASE WHEN event_id % 50 <> 0 THEN 'M' || (user_id // 20) END AS PORTADOR_ID_BASELINE, 'N' || user_id AS NOME_PORTADOR_NORMALIZADO,
    CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'S' || (user_id // 20) END AS FAVORECIDO_ID, ts::DATE AS DATA_DT, ((event_id % 3 + 10) * 1000)::BIGINT AS VALOR_CENTAVOS,
    {_case("event_type", EVENT_CODES)} AS TRANSACAO
  FROM events
), nm AS (SELECT *, CASE WHEN PORTADOR_ID_BASELINE IS NOT NULL THEN UG_ID || '|' || PORTADOR_ID_BASELINE || '|' || NOME_PORTADOR_NORMALIZADO END AS PORTADOR_ID, TRUE AS FAVORECIDO_IDENTIFICADO,
  year(DATA_DT)::INT AS ANO_TRANSACAO, TRANSACAO IN {_in(model.PURCHASES)} AS EH_COMPRA_EFETIVA, TRANSACAO = '{model.NATIONAL}' AS EH_COMPRA_NACIONAL, TRANSACAO IN {_in(model.WITHDRAWALS)} AS EH_SAQUE_EFETIVO
  FROM nb)"""

#: Cents that make the events' amounts alike.
STEADY = 50_000
STEADY_SQL = EVENTS_SQL.replace("((floor(value / 10) + 1) * 1000)", f"({STEADY} + (floor(value / 10) + 1) * 1000)")

#: The fact ``stg`` from both.
BOTH_SQL = f"""stg AS (SELECT * FROM (WITH {LINES_SQL} SELECT * FROM stg) UNION ALL BY NAME SELECT * FROM (WITH {EVENTS_SQL} SELECT * FROM stg))"""

#: Dated limits that cover the lines' dates (from, to, purchases base, works base, share).
TEST_LIMITS = (
    ("1990-01-01", "1996-06-30", "1000000.00", "4000000.00", "0.01"),
    ("1996-07-01", "1998-12-31", "1500000.00", "5000000.00", "0.01"),
    ("1999-01-01", "2010-12-31", "57208.33", "114416.65", "0.50"),
)
LIMITS_SQL = """lim AS (SELECT * FROM (VALUES
  (DATE '1990-01-01', DATE '1996-06-30', 1000000::BIGINT, 4000000::BIGINT),
  (DATE '1996-07-01', DATE '1998-12-31', 1500000::BIGINT, 5000000::BIGINT),
  (DATE '1999-01-01', DATE '2010-12-31', 2860416::BIGINT, 5720832::BIGINT)) t(INICIO, FIM, LIMITE_COMPRAS, LIMITE_ENGENHARIA))"""
