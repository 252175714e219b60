"""Collinearity and components of 0/1 flags.

One Spark aggregation gives counts, sums and cross products (as many numbers as pairs of flags);
the small matrices are solved on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


Moments = tuple[int, np.ndarray, np.ndarray]


def moments_by(matrix: DataFrame, flags: list[str], by: str | None = None) -> dict[object, Moments]:
    """Rows, sums and cross products of each stratum, or of all rows under None.

    One aggregation; the driver gets one row per stratum (a band or a decile). Null strata are left out.
    """
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i:]]
    rows = matrix if by is None else matrix.filter(F.col(by).isNotNull())
    grouped = rows.groupBy(*([] if by is None else [by])).agg(
        F.count(F.lit(1)),
        *(F.coalesce(F.sum(F.col(f)), F.lit(0)) for f in flags),
        *(F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)) for a, b in pairs),
    )
    k, lead, out = len(flags), 0 if by is None else 1, {}
    for row in grouped.collect():
        values = row[lead:]
        cross = np.zeros((k, k))
        for (a, b), v in zip(pairs, values[1 + k :], strict=True):
            i, j = flags.index(a), flags.index(b)
            cross[i, j] = cross[j, i] = v
        out[row[0] if lead else None] = values[0], np.array(values[1 : 1 + k], dtype=float), cross
    return out


def moments(matrix: DataFrame, flags: list[str]) -> Moments:
    return moments_by(matrix, flags)[None]


def varying(n: int, sums: np.ndarray, flags: list[str], least: int = 30) -> list[int]:
    """Places of flags with enough positives and negatives."""
    return [i for i, _ in enumerate(flags) if sums[i] >= least and n - sums[i] >= least]


def correlation(n: int, sums: np.ndarray, cross: np.ndarray) -> np.ndarray:
    centred = cross - np.outer(sums, sums) / n
    scale = np.sqrt(np.diag(centred))
    return centred / np.outer(scale, scale)


VIF_SCHEMA = "FLAG string, STATUS string, R2 double, VIF double"
CONDITION_SCHEMA = "ORDEM int, AUTOVALOR double, INDICE double, SINGULAR boolean"
COMPONENT_SCHEMA = "COMPONENTE int, AUTOVALOR double, EXPLICADA double, ACUMULADA double, FLAG string, PESO double, CARGA double"


def variance_inflation(matrix: DataFrame, flags: list[str], least: int = 30, tolerance: float = 1e-12) -> DataFrame:
    return matrix.sparkSession.createDataFrame(_inflation(moments(matrix, flags), flags, least, tolerance), VIF_SCHEMA)


def _inflation(found: Moments, flags: list[str], least: int, tolerance: float) -> list[tuple]:
    n, sums, cross = found
    used = varying(n, sums, flags, least)
    centred = cross - np.outer(sums, sums) / max(n, 1)
    rows = []
    for i, flag in enumerate(flags):
        others = [j for j in used if j != i]
        if i not in used or not others:
            rows.append((flag, "INELEGIVEL", None, None))
            continue
        own = centred[np.ix_([i], others)][0]
        r2 = float(own @ np.linalg.pinv(centred[np.ix_(others, others)]) @ own / centred[i, i])
        left = 1 - r2
        rows.append((flag, "ELEGIVEL", r2, float("inf") if left <= tolerance else 1 / left))
    return rows


def condition_indices(matrix: DataFrame, flags: list[str], least: int = 30, tolerance: float = 1e-12) -> DataFrame:
    return matrix.sparkSession.createDataFrame(_conditions(moments(matrix, flags), flags, least, tolerance), CONDITION_SCHEMA)


def _conditions(found: Moments, flags: list[str], least: int, tolerance: float) -> list[tuple]:
    n, sums, cross = found
    used = varying(n, sums, flags, least)
    if len(used) < 2:
        return []
    r = correlation(n, sums[used], cross[np.ix_(used, used)])
    values = np.sort(np.linalg.eigvalsh(r))[::-1]
    values = np.where(np.abs(values) <= tolerance, 0.0, values)
    return [(k + 1, float(v), float(np.sqrt(values[0] / v)) if v > 0 else float("inf"), bool(v <= 0)) for k, v in enumerate(values)]


def components(matrix: DataFrame, flags: list[str], least: int = 30) -> DataFrame:
    """Principal components of the correlation matrix; the largest weight of each is positive."""
    return matrix.sparkSession.createDataFrame(_components(moments(matrix, flags), flags, least), COMPONENT_SCHEMA)


def _components(found: Moments, flags: list[str], least: int) -> list[tuple]:
    n, sums, cross = found
    used = varying(n, sums, flags, least)
    if len(used) < 2:
        return []
    values, vectors = np.linalg.eigh(correlation(n, sums[used], cross[np.ix_(used, used)]))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    share = values / values.sum()
    return [
        (k + 1, float(values[k]), float(share[k]), float(share[: k + 1].sum()), flags[used[i]], float(vectors[i, k]), float(vectors[i, k] * np.sqrt(values[k])))
        for k in range(len(values))
        for i in range(len(used))
    ]


def by_stratum(matrix: DataFrame, flags: list[str], by: str, least: int = 30, tolerance: float = 1e-12) -> dict[str, DataFrame]:
    """Inflation, condition indices and components within each stratum, from one aggregation."""
    found = sorted(moments_by(matrix, flags, by).items(), key=lambda item: str(item[0]))
    solved = {
        "vif": (VIF_SCHEMA, lambda m: _inflation(m, flags, least, tolerance)),
        "condition": (CONDITION_SCHEMA, lambda m: _conditions(m, flags, least, tolerance)),
        "pca": (COMPONENT_SCHEMA, lambda m: _components(m, flags, least)),
    }
    return {
        name: matrix.sparkSession.createDataFrame(
            [(by, str(value), *row) for value, m in found for row in solve(m)], f"RECORTE_COLUNA string, RECORTE_VALOR string, {schema}"
        )
        for name, (schema, solve) in solved.items()
    }
