"""Diagnostics of a flag matrix from its pattern cube.

The flags of a unit make a bit mask. One aggregation counts the units by year, stratum and mask; since a cube has
years x strata x 2^flags rows at most, whatever the matrix holds, it is collected, and every
overlap, marginal, eligibility, collinearity and component table is derived from it without reading the matrix again.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import exprs as x
from .linalg import correlation

LEAST = 30
TINY = 1e-12


@dataclass(frozen=True)
class Cube:
    """Units counted by ANO, RECORTE (their stratum) and MASK, whose bit i is set where ``flags[i]`` is."""

    counts: DataFrame
    flags: tuple[str, ...]
    unit: str
    stratum: str
    kind: str = "TRILHA"

    def grouped(self, families: dict[str, tuple[str, ...]]) -> Cube:
        """The same units by families: a family's bit is set if one of its rules' is. Rules that the cube lacks are left out."""
        own = {f: [self.flags.index(t) for t in members if t in self.flags] for f, members in families.items()}
        own = {f: bits for f, bits in own.items() if bits}
        masks = [sum(1 << b for b in bits) for bits in own.values()]
        mask = reduce(lambda a, b: a + b, (F.when(_set("MASK", m), 1 << k).otherwise(0) for k, m in enumerate(masks)))
        counts = self.counts.groupBy("ANO", "RECORTE", mask.alias("MASK")).agg(F.sum("N").alias("N"))
        return replace(self, counts=counts, flags=tuple(own), kind="FAMILIA")


def _set(column: str, mask: int) -> Column:
    return F.col(column).bitwiseAND(F.lit(mask)) != 0


def pattern_cube(matrix: DataFrame, flags: Iterable[str], unit: str, stratum: str, year: str = "ANO_TRANSACAO") -> Cube:
    """The cube of a matrix of 0/1 flags. Null flags count as 0; other values are an error."""
    flags = tuple(flags)
    bit = lambda f: F.coalesce(
        F.when(F.col(f).isin(0, 1), F.col(f)), F.when(F.col(f).isNotNull(), F.raise_error(F.lit(f"{f} must be 0 or 1")).cast("int")), F.lit(0)
    ).cast("int")
    mask = reduce(lambda a, b: a + b, (bit(f) * (1 << i) for i, f in enumerate(flags)))
    counted = matrix.groupBy(F.col(year).alias("ANO"), F.col(stratum).alias("RECORTE"), mask.alias("MASK")).agg(F.count(F.lit(1)).alias("N"))
    rows = counted.collect()  # years x strata x 2^flags rows at most
    return Cube(matrix.sparkSession.createDataFrame(rows, counted.schema), flags, unit, stratum)


def _by(cube: Cube, by: str | None) -> tuple[DataFrame, list[str]]:
    """The counts, without units of a null stratum where strata are told apart."""
    if by is None:
        return cube.counts, []
    return cube.counts.filter(F.col(by).isNotNull()), [by]


def _enough(n: Column, positives: Column, least: int) -> Column:
    return (positives >= least) & (n - positives >= least)


def eligibility(cube: Cube, by: str | None = None, least: int = LEAST) -> DataFrame:
    """Per flag, of all units or of each value of ``by`` (ANO or RECORTE): positives, negatives and whether both are enough."""
    counts, keys = _by(cube, by)
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("REGRA_OU_FAMILIA"), _set("MASK", 1 << i).alias("V")) for i, f in enumerate(cube.flags))))
    found = counts.select(*keys, "N", each.alias("e")).groupBy(*keys, "e.REGRA_OU_FAMILIA").agg(
        F.sum("N").alias("N_UNIVERSO"), F.sum(F.when(F.col("e.V"), F.col("N")).otherwise(0)).alias("N_POSITIVOS")
    )
    n, k = F.col("N_UNIVERSO"), F.col("N_POSITIVOS")
    status = F.when((k == 0) | (k == n), "SEM_VARIACAO").when(_enough(n, k, least), "SUFICIENTE").otherwise("DIAGNOSTICO_ESTATISTICO_INSUFICIENTE")
    return found.select(
        F.lit(cube.unit).alias("UNIDADE_ANALISE"), F.lit(cube.kind).alias("TIPO"), *keys, "REGRA_OU_FAMILIA", "N_UNIVERSO", "N_POSITIVOS",
        (n - k).alias("N_NEGATIVOS"), (k / n).alias("PREVALENCIA"), status.alias("ELEGIBILIDADE_DIAGNOSTICO_ESTATISTICO"),
        (status == "SUFICIENTE").alias("ELEGIVEL_PCA_VIF"),
    )


def overlap(cube: Cube, by: str | None = None, least: int = LEAST) -> DataFrame:
    """Per pair of flags: counts, Jaccard, phi and conditional shares, of all units or of each value of ``by``."""
    counts, keys = _by(cube, by)
    one = lambda i, j: F.struct(
        F.lit(cube.flags[i]).alias("REGRA_A"), F.lit(cube.flags[j]).alias("REGRA_B"),
        _set("MASK", 1 << i).cast("int").alias("A"), _set("MASK", 1 << j).cast("int").alias("B"),
    )
    pairs = F.explode(F.array(*(one(i, j) for i, j in combinations(range(len(cube.flags)), 2))))
    of = lambda v: F.sum(F.col("N") * v)
    a, b = F.col("p.A"), F.col("p.B")
    found = counts.select(*keys, "N", pairs.alias("p")).groupBy(*keys, "p.REGRA_A", "p.REGRA_B").agg(
        F.sum("N").alias("N_UNIVERSO"), of(a).alias("N_A"), of(b).alias("N_B"), of(a * b).alias("INTERSECAO"), of(F.greatest(a, b)).alias("UNIAO")
    )
    n, na, nb, both, union = (F.col(c).cast("double") for c in ("N_UNIVERSO", "N_A", "N_B", "INTERSECAO", "UNIAO"))
    enough = [_enough(F.col("N_UNIVERSO"), F.col(c), least) for c in ("N_A", "N_B")]
    return found.select(
        F.lit(cube.unit).alias("UNIDADE_ANALISE"), *keys, "REGRA_A", "REGRA_B", "N_UNIVERSO", "N_A", "N_B",
        enough[0].alias("ELEGIVEL_A_NO_RECORTE"), enough[1].alias("ELEGIVEL_B_NO_RECORTE"),
        F.when(enough[0] & enough[1], "SUFICIENTE").otherwise("CAUTELA_RARIDADE_NO_RECORTE").alias("DIAGNOSTICO_PAR_NO_RECORTE"),
        "INTERSECAO", (F.col("N_A") - F.col("INTERSECAO")).alias("A_APENAS"), (F.col("N_B") - F.col("INTERSECAO")).alias("B_APENAS"),
        (F.col("N_UNIVERSO") - F.col("UNIAO")).alias("NENHUMA"), "UNIAO", x.ratio(both, union).alias("JACCARD"),
        x.ratio(n * both - na * nb, F.sqrt(na * (n - na) * nb * (n - nb))).alias("PHI"),
        x.ratio(both, na).alias("P_B_DADO_A"), x.ratio(both, nb).alias("P_A_DADO_B"),
    )


def marginality(cube: Cube, by: str | None = None) -> DataFrame:
    """Per flag: units it signals, units that only it signals, and the union without it."""
    counts, keys = _by(cube, by)
    every = (1 << len(cube.flags)) - 1
    one = lambda i, f: F.struct(
        F.lit(f).alias("REGRA_OU_FAMILIA"), _set("MASK", 1 << i).alias("OWN"), _set("MASK", every - (1 << i)).alias("OTHERS")
    )
    each = F.explode(F.array(*(one(i, f) for i, f in enumerate(cube.flags))))
    of = lambda c: F.sum(F.when(c, F.col("N")).otherwise(0))
    own, others = F.col("m.OWN"), F.col("m.OTHERS")
    found = counts.select(*keys, "N", each.alias("m")).groupBy(*keys, "m.REGRA_OU_FAMILIA").agg(
        F.sum("N").alias("N_UNIVERSO"), of(own | others).alias("N_UNIAO_MOTOR"), of(own).alias("N_SINALIZADOS"),
        of(own & ~others).alias("N_EXCLUSIVOS"), of(others).alias("N_UNIAO_SEM_REGRA"),
    )
    return found.select(
        F.lit(cube.unit).alias("UNIDADE_ANALISE"), F.lit(cube.kind if by is None else "TRILHA").alias("TIPO"), *keys, "REGRA_OU_FAMILIA",
        "N_UNIVERSO", "N_UNIAO_MOTOR", "N_SINALIZADOS", "N_EXCLUSIVOS",
        x.ratio(F.col("N_EXCLUSIVOS"), F.col("N_SINALIZADOS")).alias("CONTRIBUICAO_MARGINAL_PCT"), "N_UNIAO_SEM_REGRA",
        (F.col("N_UNIAO_MOTOR") - F.col("N_UNIAO_SEM_REGRA")).alias("PERDA_UNIDADES_SE_REMOVER"), (F.col("N_EXCLUSIVOS") == 0).alias("ZERO_EXCLUSIVOS"),
    )


# Collinearity and components: at most seven flags, solved from the cube's moments


def _moments(cube: Cube, by: str | None) -> list[tuple[str | None, int, np.ndarray, np.ndarray]]:
    """(value of ``by``, units, sums, cross products), in the order of the values."""
    counts, keys = _by(cube, by)
    groups: dict = {}
    for *value, mask, n in counts.groupBy(*keys, "MASK").agg(F.sum("N")).collect():
        groups.setdefault(value[0] if value else None, []).append((mask, n))
    out = []
    for value in sorted(groups, key=lambda v: (isinstance(v, str), v) if v is not None else (False, 0)):
        mask, n = np.array(groups[value]).T
        bits = (mask[:, None] >> np.arange(len(cube.flags))) & 1
        out.append((None if value is None else str(value), int(n.sum()), (bits * n[:, None]).sum(axis=0).astype(float), (bits.T * n) @ bits * 1.0))
    return out


def _used(n: int, sums: np.ndarray, least: int) -> list[int]:
    return [i for i, k in enumerate(sums) if k >= least and n - k >= least]


def _status(n: int, k: float, least: int) -> str:
    if k in (0, n):
        return "SEM_VARIACAO"
    return "SUFICIENTE" if min(k, n - k) >= least else "DIAGNOSTICO_ESTATISTICO_INSUFICIENTE"


_CUT = "RECORTE_COLUNA string, RECORTE_VALOR string, UNIDADE_ANALISE string, TIPO string, "
VIF = "REGRA_OU_FAMILIA string, N_UNIVERSO long, N_VARIAVEIS_ELEGIVEIS_MODELO int, R2_AUXILIAR double, TOLERANCIA double, VIF double, STATUS_VIF string"
CONDITION = (
    "COMPONENTE string, N_UNIVERSO long, N_VARIAVEIS_ELEGIVEIS_MODELO int, VARIAVEIS_MODELO string, AUTOVALOR double, PROPORCAO_AUTOVALOR double, "
    "INDICE_CONDICAO double, SINGULAR boolean"
)
COMPONENTS = (
    "COMPONENTE string, N_UNIVERSO long, N_VARIAVEIS_ELEGIVEIS_MODELO int, VARIAVEIS_MODELO string, AUTOVALOR double, VARIANCIA_EXPLICADA double, "
    "VARIANCIA_EXPLICADA_ACUMULADA double"
)
LOADINGS = "REGRA_OU_FAMILIA string, COMPONENTE string, PESO_COMPONENTE double, CARGA_CORRELACAO double, CARGA_QUADRADA double, COMUNALIDADE_ACUMULADA double"


def _table(cube: Cube, by: str | None, rows: list[tuple], schema: str) -> DataFrame:
    column = cube.stratum if by == "RECORTE" else by
    lead = [(None if by is None else column, value, cube.unit, cube.kind, *row) for value, *row in rows]
    made = cube.counts.sparkSession.createDataFrame(lead, _CUT + schema)
    return made.drop("RECORTE_COLUNA", "RECORTE_VALOR") if by is None else made


def inflation(cube: Cube, by: str | None = None, least: int = LEAST, tolerance: float = TINY) -> DataFrame:
    """Each flag regressed on the other eligible flags; flags that aren't eligible keep a row with a status."""
    rows = []
    for value, n, sums, cross in _moments(cube, by):
        used = _used(n, sums, least)
        centred = cross - np.outer(sums, sums) / n
        for i, flag in enumerate(cube.flags):
            if i not in used:
                rows.append((value, flag, n, len(used), None, None, None, f"NAO_CALCULADO_{_status(n, sums[i], least)}"))
                continue
            others = [j for j in used if j != i]
            own = centred[i, others]
            r2 = float(np.clip(own @ np.linalg.pinv(centred[np.ix_(others, others)]) @ own / centred[i, i], 0, 1)) if others else 0.0
            perfect = 1 - r2 <= tolerance
            solved = (0.0, float("inf"), "DEPENDENCIA_LINEAR_PERFEITA") if perfect else (1 - r2, 1 / (1 - r2), "CALCULADO")
            rows.append((value, flag, n, len(used), r2, *solved))
    return _table(cube, by, rows, VIF)


def _spectrum(n, sums, cross, used, tolerance) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(correlation(n, sums[used], cross[np.ix_(used, used)]))
    values, vectors = values[::-1], vectors[:, ::-1]
    return np.where(values <= tolerance, 0.0, values), vectors


def conditions(cube: Cube, by: str | None = None, least: int = LEAST, tolerance: float = TINY) -> DataFrame:
    """Eigenvalues of the eligible flags' correlation matrix, largest first, and their condition indices."""
    rows = []
    for value, n, sums, cross in _moments(cube, by):
        if used := _used(n, sums, least):
            values, _ = _spectrum(n, sums, cross, used, tolerance)
            names = ",".join(cube.flags[i] for i in used)
            for k, v in enumerate(values.tolist()):
                index = float(np.sqrt(values[0] / v)) if v > 0 else float("inf")
                rows.append((value, f"D{k + 1}", n, len(used), names, v, v / float(values.sum()), index, v <= 0))
    return _table(cube, by, rows, CONDITION)


def components(cube: Cube, by: str | None = None, least: int = LEAST, tolerance: float = TINY) -> tuple[DataFrame, DataFrame]:
    """Principal components of the correlation matrix, and the flags' loadings. The largest weight of a component is positive."""
    made, loads = [], []
    for value, n, sums, cross in _moments(cube, by):
        if not (used := _used(n, sums, least)):
            continue
        values, vectors = _spectrum(n, sums, cross, used, tolerance)
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
        share = values / values.sum()
        names = ",".join(cube.flags[i] for i in used)
        made += [
            (value, f"PC{k + 1}", n, len(used), names, float(values[k]), float(share[k]), float(share[: k + 1].sum())) for k in range(len(values))
        ]
        load = vectors * np.sqrt(values)
        shared = np.cumsum(load**2, axis=1)
        loads += [
            (value, cube.flags[used[i]], f"PC{k + 1}", float(vectors[i, k]), float(load[i, k]), float(load[i, k] ** 2), float(shared[i, k]))
            for i in range(len(used))
            for k in range(len(values))
        ]
    return _table(cube, by, made, COMPONENTS), _table(cube, by, loads, LOADINGS)


def diagnostic_cubes(supplier: DataFrame, unit: DataFrame) -> dict[str, Cube]:
    """The cubes of both matrices, by rules and by families: two aggregations in all."""
    cubes = {
        "supplier_trails": pattern_cube(supplier, model.SUPPLIER_TRAILS, "UG_FORNECEDOR_ANO", "BANDA_EXPOSICAO"),
        "ug_trails": pattern_cube(unit, model.TRAILS, "UG_ANO", "DECIL_EXPOSICAO"),
    }
    core = {f: members for f, members in model.FAMILIES.items() if not set(members) & set(model.CONTEXTS)}
    return {
        "supplier_trails": cubes["supplier_trails"],
        "supplier_families": cubes["supplier_trails"].grouped(core),
        "ug_trails": cubes["ug_trails"],
        "ug_families": cubes["ug_trails"].grouped(core),
    }


def diagnostic_tables(supplier: DataFrame, unit: DataFrame) -> dict[str, DataFrame]:
    """All 66 overlap, marginal, collinearity and component tables of two matrices of complete years, by name."""
    out = {}
    for name, cube in diagnostic_cubes(supplier, unit).items():
        side, flags = name.split("_")
        cut = "exposure" if side == "supplier" else "decile"
        renamed = lambda df, cube=cube: df.withColumnRenamed("RECORTE", cube.stratum)
        out |= {
            f"overlap_{name}": overlap(cube),
            f"overlap_{name}_by_{cut}": renamed(overlap(cube, "RECORTE")),
            f"marginal_{name}": marginality(cube),
            f"marginal_{name}_by_{cut}": renamed(marginality(cube, "RECORTE")),
        }
        if flags == "trails":
            out[f"overlap_{name}_by_year"] = overlap(cube, "ANO")
        for by, end in ((None, ""), ("RECORTE", "_by_exposure")):
            stated = renamed(eligibility(cube, by))
            parts, loads = components(cube, by)
            out |= {
                f"multicollinearity_{name}_eligibility{end}": stated,
                f"multicollinearity_{name}_vif{end}": inflation(cube, by),
                f"multicollinearity_{name}_condition{end}": conditions(cube, by),
                f"pca_{name}_eligibility{end}": stated,
                f"pca_{name}_components{end}": parts,
                f"pca_{name}_loadings{end}": loads,
            }
    return dict(sorted(out.items()))
