"""Exposure universes, flag matrices, overlap, marginal contribution, sensitivity, sampling."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x
from ..functions import ranks
from .rules import CARD, UNIT_YEAR

SUPPLIER_YEAR = ["UG_ID", "FAVORECIDO_ID", "ANO_TRANSACAO"]


def supplier_year_universe(staged: DataFrame, card: str = CARD) -> DataFrame:
    rows = staged.filter(
        x.true("EH_COMPRA_EFETIVA")
        & ~x.true("EH_AJUSTE_CONTESTACAO")
        & (F.col("VALOR_CENTAVOS") > 0)
        & F.col("UG_ID").isNotNull()
        & F.col("ANO_TRANSACAO").isNotNull()
        & F.col("FAVORECIDO_ID").isNotNull()
    )
    # a day counts where it comes first, so that only one column is counted by its distinct values and no row is made twice
    own = Window.partitionBy("_H", *SUPPLIER_YEAR).orderBy("DATA_DT")
    marked = rows.withColumn("_H", F.xxhash64(*SUPPLIER_YEAR)).withColumn("_FIRST", ~F.lag("DATA_DT").over(own).eqNullSafe(F.col("DATA_DT")))
    return marked.groupBy(*SUPPLIER_YEAR).agg(
        F.count(F.lit(1)).alias("N_COMPRAS_FORNECEDOR"),
        F.sum("VALOR_CENTAVOS").alias("TOTAL_CENTAVOS"),
        F.count_distinct(card).alias("N_PORTADORES"),
        F.count_if("_FIRST").alias("N_DIAS"),
    )


def unit_year_universe(staged: DataFrame, card: str = CARD) -> DataFrame:
    buy, draw = x.true("EH_COMPRA_EFETIVA"), x.true("EH_SAQUE_EFETIVO")
    value = F.col("VALOR_CENTAVOS")
    rows = staged.filter(
        (buy | draw) & ~x.true("EH_AJUSTE_CONTESTACAO") & (value > 0) & F.col("UG_ID").isNotNull() & F.col("ANO_TRANSACAO").isNotNull()
    )
    return rows.groupBy(*UNIT_YEAR).agg(
        F.count_if(buy).alias("N_COMPRAS"),
        F.count_if(draw).alias("N_SAQUES"),
        F.count(F.lit(1)).alias("N_OPERACOES_EFETIVAS"),
        F.coalesce(F.sum(F.when(buy, value)), F.lit(0)).alias("COMPRAS_CENTAVOS"),
        F.coalesce(F.sum(F.when(draw, value)), F.lit(0)).alias("SAQUES_CENTAVOS"),
        F.count_distinct(card).alias("N_PORTADORES"),
        F.count_distinct(F.when(buy, F.col("FAVORECIDO_ID"))).alias("N_FORNECEDORES"),
        F.count_distinct("DATA_DT").alias("N_DIAS_ATIVOS"),
    )


# Lower ends of the supplier exposure bands.
BANDS = ((20, "20+", 6), (10, "10-19", 5), (5, "5-9", 4), (3, "3-4", 3), (2, "2", 2), (1, "1", 1))


def with_bands(universe: DataFrame, column: str = "N_COMPRAS_FORNECEDOR") -> DataFrame:
    """Exposure bands. A value below 1, or null, is an error."""
    n = F.col(column)
    pick = lambda k: reduce(
        lambda done, b: done.when(n >= b[0], F.lit(b[k])), BANDS[1:], F.when(n >= BANDS[0][0], F.lit(BANDS[0][k]))
    ).otherwise(F.raise_error("exposure must be at least 1").cast("string" if k == 1 else "int"))
    return universe.withColumns({"BANDA_EXPOSICAO": pick(1), "ORDEM_BANDA": pick(2)})


def with_deciles(universe: DataFrame, column: str = "N_OPERACOES_EFETIVAS", by: str = "ANO_TRANSACAO") -> DataFrame:
    return ranks.with_average_rank(universe, column, [by], "PERCENTIL_EXPOSICAO").withColumn(
        "DECIL_EXPOSICAO", F.least(F.greatest(F.ceil(F.col("PERCENTIL_EXPOSICAO") * 10), F.lit(1)), F.lit(10)).cast("int")
    )


def flag_records(outputs: dict[str, DataFrame]) -> DataFrame:
    """``flags_of`` all signal tables, distinct; null units and years are dropped."""
    return reduce(DataFrame.unionByName, (flags_of(trail, df) for trail, df in outputs.items())).filter("UG_ID IS NOT NULL AND ANO IS NOT NULL").distinct()


def flag_matrix(universe: DataFrame, flags: DataFrame, keys: list[str], trails=model.TRAILS) -> DataFrame:
    """The universe with one 0/1 column per trail; flags outside the universe vanish."""
    names = {"UG_ID": "UG_ID", "FAVORECIDO_ID": "ENTIDADE", "ANO_TRANSACAO": "ANO"}
    wide = (
        flags.filter(F.col("TRILHA").isin(*trails))
        .groupBy(*(F.col(names[k]).alias(k) for k in keys))
        .agg(*(F.max(F.when(F.col("TRILHA") == t, 1)).alias(t) for t in trails))
    )
    return universe.join(wide, keys, "left").na.fill(0, list(trails))


def flags_of(trail: str, df: DataFrame) -> DataFrame:
    """(TRILHA, UG_ID, ENTIDADE, ANO) of a signal table; the entity is FAVORECIDO_ID, or the leading supplier for T06, or null."""
    entity = next((F.col(c) for c in ("TOP1_FAVORECIDO_ID", "FAVORECIDO_ID") if c in df.columns), F.lit(None))
    return df.select(F.lit(trail).alias("TRILHA"), "UG_ID", entity.cast("string").alias("ENTIDADE"), F.col("ANO_TRANSACAO").alias("ANO"))


def with_families(matrix: DataFrame, trails=model.TRAILS) -> DataFrame:
    present = {f: [t for t in members if t in trails] for f, members in model.FAMILIES.items()}
    made = {f: (F.greatest(*ts) if len(ts) > 1 else F.col(ts[0])) for f, ts in present.items() if ts}
    out = matrix.withColumns(made)
    add = lambda cs: reduce(lambda a, b: a + b, map(F.col, cs))
    return out.withColumns({"N_TRILHAS": add(list(trails)), "N_FAMILIAS": add(list(made))})


def with_context(matrix: DataFrame, flags: DataFrame, contexts: dict[str, list[str]]) -> DataFrame:
    """0/1 columns of rules that are joined on keys of their own and count in no sum."""
    for trail, keys in contexts.items():
        names = [{"FAVORECIDO_ID": "ENTIDADE", "ANO_TRANSACAO": "ANO"}.get(k, k) for k in keys]
        hit = flags.filter(F.col("TRILHA") == trail).select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True))).distinct()
        matrix = matrix.join(hit.withColumn(trail, F.lit(1)), keys, "left")
    return matrix.na.fill(0, list(contexts))


def flag_eligibility(matrix: DataFrame, flags: list[str], least: int = 30) -> DataFrame:
    wide = matrix.agg(F.count(F.lit(1)).alias("N"), *(F.sum(f).alias(f"_{f}") for f in flags)).filter("N > 0")
    one = F.explode(F.array(*(F.struct(F.lit(f).alias("FLAG"), F.col(f"_{f}").alias("POSITIVOS")) for f in flags)))
    grouped = wide.select("N", one.alias("e")).select("e.FLAG", "N", "e.POSITIVOS")
    negative = F.col("N") - F.col("POSITIVOS")
    status = (
        F.when((F.col("POSITIVOS") == 0) | (negative == 0), "SEM_VARIACAO")
        .when((F.col("POSITIVOS") < least) | (negative < least), "INSUFICIENTE")
        .otherwise("SUFICIENTE")
    )
    return grouped.withColumns({"NEGATIVOS": negative, "PREVALENCIA": F.col("POSITIVOS") / F.col("N"), "STATUS": status})


def pairwise(matrix: DataFrame, flags: list[str], by: list[str] = ()) -> DataFrame:
    """Counts, Jaccard, phi and conditional shares for every pair of flags: one aggregation, then one row per pair."""
    pairs = list(combinations(flags, 2))
    sums = [F.sum(F.col(f)).alias(f"_{f}") for f in flags] + [F.sum(F.col(a) * F.col(b)).alias(f"_{a}_{b}") for a, b in pairs]
    wide = matrix.groupBy(*by).agg(F.count(F.lit(1)).alias("N"), *sums)
    one = lambda a, b: F.struct(
        F.lit(a).alias("A"), F.lit(b).alias("B"), F.col(f"_{a}_{b}").alias("N11"), F.col(f"_{a}").alias("NA"), F.col(f"_{b}").alias("NB")
    )
    rows = wide.select(*by, "N", F.explode(F.array(*(one(a, b) for a, b in pairs))).alias("p")).select(*by, "N", "p.*")
    n, n11, na, nb = (F.col(c).cast("double") for c in ("N", "N11", "NA", "NB"))
    spread = F.sqrt(na * (n - na) * nb * (n - nb))
    return rows.withColumns(
        {
            "N10": F.col("NA") - F.col("N11"),
            "N01": F.col("NB") - F.col("N11"),
            "N00": F.col("N") - F.col("NA") - F.col("NB") + F.col("N11"),
            "JACCARD": x.ratio(n11, na + nb - n11),
            "PHI": x.ratio(n * n11 - na * nb, spread),
            "P_A_DADO_B": x.ratio(n11, nb),
            "P_B_DADO_A": x.ratio(n11, na),
        }
    ).drop("NA", "NB")


def with_global_eligibility(pairs: DataFrame, eligibility: DataFrame) -> DataFrame:
    """Both flags' eligibility over all rows. The table of eligibility has one row per flag, so it is broadcast."""
    side = lambda c: F.broadcast(eligibility.select(F.col("FLAG").alias(c), F.col("STATUS").alias(f"ELEGIBILIDADE_{c}_GLOBAL")))
    both = (F.col("ELEGIBILIDADE_A_GLOBAL") == "SUFICIENTE") & (F.col("ELEGIBILIDADE_B_GLOBAL") == "SUFICIENTE")
    joined = pairs.join(side("A"), "A", "left").join(side("B"), "B", "left")
    return joined.withColumn("DIAGNOSTICO_PAR_GLOBAL", F.when(both, "SUFICIENTE").otherwise("CAUTELA_RARIDADE"))


def square_matrix(pairs: DataFrame, flags: list[str], metric: str) -> DataFrame:
    """Pairs as a symmetric matrix with a diagonal of 1."""
    pick = lambda a, b: pairs.select(F.col(a).alias("A"), F.col(b).alias("B"), F.col(metric).alias("M"))
    diagonal = pairs.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, flags))).alias("A")).select(
        "A", F.col("A").alias("B"), F.lit(1.0).alias("M")
    )
    return pick("A", "B").unionByName(pick("B", "A")).unionByName(diagonal).groupBy("A").pivot("B", flags).agg(F.first("M"))


def strongest_partner(pairs: DataFrame) -> DataFrame:
    """Per flag, the other flag of the largest absolute phi; ties to the smaller name."""
    both = pairs.select("A", "B", "PHI").unionByName(pairs.select(F.col("B").alias("A"), F.col("A").alias("B"), "PHI"))
    order = Window.partitionBy("A").orderBy(F.desc(F.abs("PHI")), "B")
    return both.filter("PHI IS NOT NULL").withColumn("RN", F.row_number().over(order)).filter("RN = 1").drop("RN")


def marginal(matrix: DataFrame, flags: list[str], by: list[str] = ()) -> DataFrame:
    """Per flag: units signalled, units that only it signals, and the union without it."""
    union = F.greatest(*flags)
    sums = [F.sum(union).alias("_union")]
    for f in flags:
        others = F.greatest(*[g for g in flags if g != f]) if len(flags) > 2 else F.col(next(g for g in flags if g != f))
        sums += [F.sum(F.col(f)).alias(f"_{f}"), F.coalesce(F.sum(F.when(others == 0, F.col(f))), F.lit(0)).alias(f"_{f}_only")]
    wide = matrix.groupBy(*by).agg(*sums)
    one = lambda f: F.struct(F.lit(f).alias("FLAG"), F.col(f"_{f}").alias("SINALIZADAS"), F.col(f"_{f}_only").alias("EXCLUSIVAS"))
    rows = wide.select(*by, F.col("_union").alias("UNIAO"), F.explode(F.array(*map(one, flags))).alias("m")).select(*by, "UNIAO", "m.*")
    return rows.withColumns(
        {
            "EXCLUSIVAS_PCT": x.ratio(F.col("EXCLUSIVAS"), F.col("SINALIZADAS")),
            "UNIAO_SEM": F.col("UNIAO") - F.col("EXCLUSIVAS"),
            "PERDA_PCT": x.ratio(F.col("EXCLUSIVAS"), F.col("UNIAO")),
        }
    )


def exposure_profile(matrix: DataFrame, by: str, exposure: str, flags: list[str]) -> DataFrame:
    return matrix.groupBy(by).agg(
        F.count(F.lit(1)).alias("N_UNIDADES"),
        F.count_distinct("UG_ID").alias("N_UG"),
        F.median(F.col(exposure).cast("double")).alias("MEDIANA_EXPOSICAO"),
        F.avg(F.col(exposure).cast("double")).alias("MEDIA_EXPOSICAO"),
        *(F.avg(F.col(f).cast("double")).alias(f"PREVALENCIA_{f}") for f in flags),
    )


def convergence(flags: DataFrame) -> DataFrame:
    """Unit-years with the list of their trails."""
    return flags.groupBy("UG_ID", "ANO").agg(
        F.count_distinct("TRILHA").alias("N_TRILHAS"),
        F.count(F.lit(1)).alias("N_SINAIS"),
        F.array_join(F.array_sort(F.collect_set("TRILHA")), ", ").alias("TRILHAS"),
    )


def with_validation_status(df: DataFrame, column: str = "STATUS_VALIDACAO") -> DataFrame:
    """Status of each row; null becomes the default, and one outside the domain is an error."""
    own = F.upper(F.trim(x.optional(df, column)))
    bad = F.raise_error(F.concat(F.lit("unknown validation status: "), own)).cast("string")
    return df.withColumn(column, F.when(own.isNull(), model.STATUSES[0]).when(own.isin(*model.STATUSES), own).otherwise(bad))


def evidence_id_column(df: DataFrame) -> str:
    """The first known id column."""
    found = next((c for c in model.EVIDENCE_IDS if c in df.columns), None)
    if found is None:
        raise ValueError(f"no evidence id; one of these is needed: {', '.join(model.EVIDENCE_IDS)}")
    return found


def tag_evidence(df: DataFrame, trail: str, id_column: str | None = None, engine: str = model.RULES_VERSION) -> DataFrame:
    """The governance columns, then the signal's own. An id that occurs twice is an error when the rows are read; null ids may repeat.

    Columns of the input that have a governance name are replaced, but a validation status is kept.
    """
    code = trail.strip().upper()
    if code not in model.EVIDENCE:
        raise ValueError(f"unknown rule: {trail!r}")
    id_column = id_column or evidence_id_column(df)
    family = next(f for f, members in model.FAMILIES.items() if code in members)
    kind, unit = model.EVIDENCE[code]
    core = code in model.TRAILS
    own = F.col(id_column).cast("string")
    times = F.count(F.lit(1)).over(Window.partitionBy(own))
    twice = F.raise_error(F.concat(F.lit("evidence id occurs more than once: "), own)).cast("string")
    tagged = with_validation_status(df)
    made = {
        "ID_EVIDENCIA": F.when(own.isNotNull() & (times > 1), twice).otherwise(own),
        "TRILHA": F.lit(code),
        "FAMILIA_EVIDENCIA": F.lit(family),
        "NOME_FAMILIA_EVIDENCIA": F.lit(model.FAMILY_NAMES[family]),
        "TIPO_EVIDENCIA": F.lit(kind),
        "PAPEL_EVIDENCIA": F.lit("NUCLEO" if core else "CONTEXTO"),
        "UNIDADE_PRIMARIA": F.lit(unit),
        "CONVERGENCIA_NUCLEO": F.lit(core),
        "STATUS_VALIDACAO": F.col("STATUS_VALIDACAO"),
        "VERSAO_PREPARACAO": F.lit(model.PREPARATION_VERSION),
        "VERSAO_REGRAS": F.lit(model.RULES_VERSION),
        "VERSAO_MOTOR": F.lit(engine),
    }
    return tagged.select(*(c.alias(name) for name, c in made.items()), *(f"`{c}`" for c in tagged.columns if c not in made))


def consolidate(frames: list[DataFrame]) -> DataFrame:
    """All tagged signal tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def sensitivity(base: DataFrame, column: str, thresholds: list[float], baseline: float) -> DataFrame:
    """Units at or above each threshold, and the difference to the baseline's."""
    grid = F.explode(F.array(*(F.lit(float(t)) for t in thresholds)))
    value = F.col(column).cast("double")
    counted = (
        base.select(value.alias("_V"), grid.alias("LIMIAR"))
        .groupBy("LIMIAR")
        .agg(F.count_if(F.col("_V") >= F.col("LIMIAR")).alias("N"), F.count_if(F.col("_V") >= baseline).alias("N_BASE"))
    )
    return counted.withColumn("DELTA", F.col("N") - F.col("N_BASE"))


def stratified_sample(signals: DataFrame, trail: str, stratum: str, key: str, most: int = 30, salt: str = "sample") -> DataFrame:
    """Up to ``most`` signals per trail with balanced quotas over strata, in the order of a salted hash.

    A stratum gets the rows whose place in it is among the first ``most`` places over all
    strata of the trail, taken place by place: what small strata leave goes to the larger.
    """
    hashed = F.sha2(F.concat(F.lit(salt + "|"), F.col(key)).cast("binary"), 256)
    inside = Window.partitionBy(trail, stratum)
    placed = signals.withColumns(
        {"_HASH": hashed, "N_ESTRATO": F.count(F.lit(1)).over(inside), "_PLACE": F.row_number().over(inside.orderBy(hashed, key))}
    ).filter(F.col("_PLACE") <= most)
    turn = F.row_number().over(Window.partitionBy(trail).orderBy("_PLACE", stratum))
    chosen = placed.withColumn("_TURN", turn).filter(F.col("_TURN") <= most)
    n = F.count(F.lit(1)).over(Window.partitionBy(trail, stratum))
    return chosen.withColumn("PESO", F.col("N_ESTRATO") / n).drop("_HASH", "_PLACE", "_TURN")


def wilson(n: Column, k: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Ends of the Wilson interval for k of n."""
    n, k = n.cast("double"), k.cast("double")
    p = k / F.nullif(n, F.lit(0.0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


# Statuses that decide a validation, the first of which confirms.
DECIDED = ("CONFIRMADO", "JUSTIFICADO", "FALSO_POSITIVO")


def validation_rates(validations: DataFrame, by: list[str]) -> DataFrame:
    """Per group: validations, decided and confirmed ones, and the rate with its Wilson interval; nulls where none is decided."""
    status = F.col("STATUS_VALIDACAO")
    grouped = validations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("N_VALIDACOES"), F.count_if(status.isin(*DECIDED)).alias("N_DECIDIDOS"), F.count_if(status == DECIDED[0]).alias("N_CONFIRMADOS")
    )
    low, high = wilson(F.col("N_DECIDIDOS"), F.col("N_CONFIRMADOS"))
    some = F.col("N_DECIDIDOS") > 0
    return grouped.withColumns(
        {"TAXA_CONFIRMACAO": x.ratio(F.col("N_CONFIRMADOS"), F.col("N_DECIDIDOS")), "IC95_INF": F.when(some, low), "IC95_SUP": F.when(some, high)}
    )


def weighted_rates(validations: DataFrame, populations: DataFrame, trail: str, stratum: str, z: float = 1.959963984540054) -> DataFrame:
    """Per trail: the confirmed share, each stratum weighted by its population, with the interval of a stratified sample.

    ``populations``: (trail, stratum, N_POP_ESTRATO). Only strata with a decision and a known population count. A stratum's variance has its finite population
    correction; where a stratum has a single decision and more members, its variance isn't known, so the interval is null.
    """
    own = validations.filter(F.col("STATUS_VALIDACAO").isin(*DECIDED)).groupBy(trail, stratum).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("STATUS_VALIDACAO") == DECIDED[0]).cast("double")).alias("p")
    )
    joined = own.join(populations.select(trail, stratum, F.col("N_POP_ESTRATO").cast("double").alias("_POP")), [trail, stratum])
    n, p, size = F.col("n"), F.col("p"), F.col("_POP")
    variance = F.when(n >= size, 0.0).when(n > 1, size * size * (1 - n / size) * p * (1 - p) / (n - 1))
    summed = joined.groupBy(trail).agg(
        (F.sum(p * size) / F.sum(size)).alias("TAXA_CONFIRMACAO_PONDERADA"),
        F.count(F.lit(1)).alias("N_ESTRATOS_COM_DECISAO"),
        F.sum("_POP").cast("bigint").alias("POPULACAO_REPRESENTADA"),
        F.when(F.count_if(variance.isNull()) == 0, F.sqrt(F.sum(variance)) / F.sum(size)).alias("ERRO_PADRAO"),
    )
    rate, half = F.col("TAXA_CONFIRMACAO_PONDERADA"), z * F.col("ERRO_PADRAO")
    return summed.withColumns({"IC95_INF": F.greatest(F.lit(0.0), rate - half), "IC95_SUP": F.least(F.lit(1.0), rate + half)}).withColumns(
        {c: F.when(F.col("ERRO_PADRAO").isNotNull(), F.col(c)) for c in ("IC95_INF", "IC95_SUP")}
    )
