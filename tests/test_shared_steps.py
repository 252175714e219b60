"""Steps that many queries share are run once, and medians hold no group in one task."""

from statistics import median

from ledgerlight.functions import ranks
from ledgerlight.operators import governance, primary, rules, windows
from ledgerlight.plans.adapters import TEST_LIMITS, both, dealt, events, lines
from ledgerlight.plans.governance_queries import SETTINGS
from ledgerlight.sources import scratch

SF = "/root/testdata/sf0.001"


def test_fact_is_written_once(spark):
    first, again = both(spark, SF), both(spark, SF)
    assert first.inputFiles() == again.inputFiles()
    assert not any("lineitem" in f for f in first.inputFiles())
    whole = lines(spark, SF).unionByName(events(spark, SF))
    assert first.schema.names == whole.schema.names
    assert first.exceptAll(whole).isEmpty() and whole.exceptAll(first).isEmpty()


def test_fact_follows_the_tables(spark, tmp_path):
    for t in ("lineitem", "orders", "customer", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    before = both(spark, str(tmp_path)).count()
    spark.read.parquet(f"{SF}/events.parquet").limit(5).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    assert both(spark, str(tmp_path)).count() == before + 5


def test_medians_by_ranks(spark):
    groups = {"a": [0.1, 0.4, 0.4, 0.9], "b": [2.0, -1.0, 7.5], "c": [3.0], "d": [None, 0.2, 0.3]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", None)], "g string, v double")
    got = {r.g: r.m for r in ranks.medians(df, "v", ["g"], "m").collect()}
    assert got == {g: median(v for v in vs if v is not None) for g, vs in groups.items()}


def _shuffles(df):
    """Shuffles of a plan that aren't another's again."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


def test_repetitions_share_one_shuffle(spark):
    fact = both(spark, SF)
    t03, t04 = rules.exact_repetition(fact), rules.multi_cardholder(fact)
    assert _shuffles(t03.select("UG_ID", "N").unionByName(t04.select("UG_ID", "N"))) == 1


def test_windows_deal_purchases_once(spark):
    metrics = windows.window_metrics(windows.recurring_purchases(both(spark, SF), "PORTADOR_ID"), [3])
    assert _shuffles(metrics) == 1


def test_fact_is_written_without_ids(spark):
    files = both(spark, SF).inputFiles()
    assert "ID_TRANSACAO" not in spark.read.parquet(*files).columns


def test_flags_without_evidence(spark):
    fact, limits = both(spark, SF), rules.limits_table(spark, TEST_LIMITS)
    for settings in (SETTINGS, {**SETTINGS, "T03": {"least": 1}, "T05": {"days": 20, "least": 3, "max_cv": 0.9}, "T07": {"days": 1}}):
        got = primary.primary_flags(fact, limits, settings=settings)
        want = governance.flag_records(primary.primary_outputs(fact, limits, settings=settings))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_rare_amounts_go_first(spark):
    day = [("u", "a", "s", "c", 10), ("u", "b", "s", "c", 10), ("u", "a", "s", "c", 11), ("u", "a", "t", "d", 12), ("u", "a", "t", "d", 12)]
    rows = spark.createDataFrame(day, "UG_ID string, PORTADOR_ID string, FAVORECIDO_ID string, `TRANSAÇÃO` string, VALOR_CENTAVOS bigint").selectExpr(
        "*", "DATE'2024-01-02' AS DATA_DT", "TRUE AS EH_COMPRA_EFETIVA", "FALSE AS EH_AJUSTE_CONTESTACAO", "TRUE AS FAVORECIDO_IDENTIFICADO"
    )
    assert sorted((r.PORTADOR_ID, r.VALOR_CENTAVOS, r.N) for r in rules.repetitions(rows).collect()) == [("a", 10, 1), ("a", 12, 2), ("b", 10, 1)]
    assert rules.repetitions(rows, least=1).count() == 4


def test_supplier_years_of_few_purchases_go_first(spark):
    rows = windows.recurring_purchases(both(spark, SF), "PORTADOR_ID")
    few = windows.window_metrics(rows, [30], 3)
    every = windows.window_metrics(rows, [30])
    assert few.count() < every.count()
    kept = lambda df: sorted(map(str, df.filter("N >= 3").collect()))
    assert kept(few) == kept(every)


def test_matrix_joins_flags_once(spark):
    fact, limits = both(spark, SF), rules.limits_table(spark, TEST_LIMITS)
    matrix = primary.supplier_matrix(fact, primary.primary_flags(fact, limits, settings=SETTINGS).localCheckpoint())
    joins = [line for line in matrix._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2
    assert matrix.columns[-2:] == ["T08", "T09"]


def test_dealt_fact_moves_no_rows_again(spark):
    fact = dealt(spark, SF)
    assert _shuffles(windows.window_metrics(windows.recurring_purchases(fact, "PORTADOR_ID"), [3], 2, dealt=True)) == 0
    assert _shuffles(rules.multi_cardholder(fact, found=rules.repetitions(fact, dealt=True))) == 0
    assert _shuffles(rules.supplier_years(fact, {"T01": rules.on_weekend()})) == 0
    assert _shuffles(governance.supplier_year_universe(fact)) == 0


def test_flags_of_dealt_fact(spark):
    limits = rules.limits_table(spark, TEST_LIMITS)
    got = primary.primary_flags(dealt(spark, SF), limits, settings=SETTINGS, dealt=True)
    want = primary.primary_flags(both(spark, SF), limits, settings=SETTINGS)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_buckets_follow_the_size(spark):
    rows = spark.range(1000).selectExpr("id % 97 AS k", "id")
    small, large = (scratch.dealt(rows, "numbers", ["k"], size) for size in (1, 40 * scratch.BUCKET))
    counts = [df.groupBy("k").count().rdd.getNumPartitions() for df in (small, large)]
    assert counts == [int(spark.conf.get("spark.sql.shuffle.partitions")), 40]
    assert sorted(r.id for r in large.collect()) == list(range(1000))


def test_days_are_counted_once(spark):
    day = [("a", "2024-01-02"), ("b", "2024-01-02"), ("a", "2024-01-03"), ("a", None), (None, None)]
    rows = spark.createDataFrame(day, "PORTADOR_ID string, d string").selectExpr(
        "PORTADOR_ID", "DATE(d) AS DATA_DT", "'u' AS UG_ID", "'s' AS FAVORECIDO_ID", "2024 AS ANO_TRANSACAO", "5L AS VALOR_CENTAVOS", "TRUE AS EH_COMPRA_EFETIVA", "FALSE AS EH_AJUSTE_CONTESTACAO"
    )
    got = governance.supplier_year_universe(rows).collect()
    assert [(r.N_COMPRAS_FORNECEDOR, r.TOTAL_CENTAVOS, r.N_PORTADORES, r.N_DIAS) for r in got] == [(5, 25, 2, 2)]
