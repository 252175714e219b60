"""The bridge of signals and transactions, against joins of whole tables of signals."""

from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight import model
from ledgerlight.operators import master, primary, rules
from ledgerlight.plans import master_queries
from ledgerlight.plans.adapters import TEST_LIMITS, both, dealt_rows
from ledgerlight.plans.governance_queries import SETTINGS

SF = "/root/testdata/sf0.001"
LOOSE = {"T03": {"least": 1}, "T04": {"levels": (3, 4, 5)}, "T05": {"days": 20, "least": 3, "max_cv": 0.9}, "T06": {"levels": (0.02, 0.1, 0.2)}, "T07": {"days": 1}, "T09": {"near": 0.5}}


def _joined(staged, limits, drill, settings):
    o = primary.primary_outputs(staged, limits, settings=settings)
    days = rules.daily_withdrawals(staged).join(o["T07"].select("UG_ID", "PORTADOR_ID", "ANO_TRANSACAO", "ID_SINAL"), ["UG_ID", "PORTADOR_ID", "ANO_TRANSACAO"])
    keys = ["UG_ID", "PORTADOR_ID", "DATA_DT"]
    found = {
        **{t: o[t] for t in ("T01", "T02", "T09")},
        "T03": rules.exact_repetition_rows(staged, o["T03"]),
        "T04": rules.multi_cardholder_rows(staged, o["T04"]),
        "T05": rules.recurrence_rows(staged, o["T05"], days=settings["T05"]["days"]),
        "T06": rules.concentration_rows(staged, o["T06"]),
        "T07": rules.effective_withdrawals(staged, "PORTADOR_ID").join(days.select(*keys, "ID_SINAL"), keys),
        "T08": drill.join(o["T08"].select("UG_ID", "ANO_TRANSACAO", "ID_SINAL"), ["UG_ID", "ANO_TRANSACAO"]),
    }
    key = lambda df: next(c for c in model.EVIDENCE_IDS if c in df.columns)
    parts = [df.select(F.lit(t).alias("CODIGO_TRILHA"), F.col(key(df)).alias("ID_SINAL"), "ID_TRANSACAO", F.lit(model.ROLES[t]).alias("PAPEL_NO_SINAL")) for t, df in found.items()]
    return reduce(DataFrame.unionByName, parts).distinct()


def _rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.mark.parametrize("settings", [SETTINGS, LOOSE], ids=["given", "loose"])
def test_bridge_of_odd_rows(spark, settings):
    """Rows that occur twice, ids that several rows share, null and empty ids, and limits whose periods overlap."""
    settings = {**settings, "T08": {"least": 5, "formal": 5, "years": (1990, 2010)}}
    fact = both(spark, SF)
    some = fact.filter(F.pmod(F.xxhash64("ID_TRANSACAO"), F.lit(7)) == 0)
    odd = [some, some.withColumn("ID_TRANSACAO", F.lit(None).cast("string")), some.withColumn("ID_TRANSACAO", F.lit("")), some.withColumn("DATA_DT", F.date_add("DATA_DT", 1))]
    odd += [some.withColumns({"PORTADOR_ID": F.lit(card), "ID_TRANSACAO": F.concat("ID_TRANSACAO", F.lit(card))}) for card in "xy"]
    staged = reduce(DataFrame.unionByName, odd, fact).localCheckpoint()
    limits = rules.limits_table(spark, (*TEST_LIMITS, ("1995-01-01", "2030-12-31", "900000.00", "20000.00", "0.01")))
    drill = staged.filter("EH_COMPRA_NACIONAL AND VALOR_CENTAVOS % 3 = 0").select("UG_ID", "ANO_TRANSACAO", "ID_TRANSACAO")
    parts = master.master_bridge(staged, limits, drill, settings=settings)
    want = _joined(staged, limits, drill, settings).localCheckpoint()
    assert {r[0] for r in want.select("CODIGO_TRILHA").distinct().collect()} >= {"T01", "T02", "T03", "T04", "T06", "T07", "T08", "T09"}
    assert _rows(master.bridge(*parts)) == _rows(want)
    assert _rows(master.summary_of(*parts)) == _rows(master.bridge_summary(want))


def _shuffles(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_bridge_moves_links_alone(spark):
    """Rows of the dealt fact stay where they are: the marks and the groups' links are moved, once each, and the few values of the drill-down."""
    staged, _ = dealt_rows(spark, SF)
    assert _shuffles(rules.repetition_links(staged, dealt=True)) == 0
    marks, groups = master_queries._bridge(spark, SF)
    assert _shuffles(marks) <= 1
    assert _shuffles(master.bridge(marks, groups)) <= 4


def test_ids_of_dealt_rows(spark):
    staged, _ = dealt_rows(spark, SF)
    assert _rows(staged.select(master_queries.id_text(F.col("ID_TRANSACAO")).alias("ID_TRANSACAO"), *staged.columns[1:])) == _rows(both(spark, SF))
