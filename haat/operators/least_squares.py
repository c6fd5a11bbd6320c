"""Least squares for every group at once, from normal equations.

The sums of products that a fit needs are one aggregate per group, combined
map-side; whatever the number of rows, a group becomes one row.  Those rows
are solved by Cholesky factors in tasks, a few hundred numbers each.  A group
never meets in one task as rows, and nothing goes through the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_equations(df: DataFrame, by: list[str], features: dict[str, Column], label: Column) -> DataFrame:
    """Per group: xx (upper triangle, row by row), xy, y, yy, n.  Rows with a
    null feature or label are left out; the intercept is the first feature."""
    names = [f"_x{i}" for i in range(len(features))]
    rows = df.select(*by, *[c.cast("double").alias(n) for n, c in zip(names, features.values())],
                     label.cast("double").alias("_y")).dropna(subset=[*names, "_y"])
    cols = [F.lit(1.0), *[F.col(n) for n in names]]
    y = F.col("_y")
    return rows.groupBy(*by).agg(
        F.array(*[F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]]).alias("xx"),
        F.array(*[F.sum(a * y) for a in cols]).alias("xy"),
        F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.count(F.lit(1)).alias("n"))


def solve(equations: DataFrame, by: list[str], ridge: float = 0.0, centred: bool = True) -> DataFrame:
    """Per group: beta (intercept first), sse, r2, n.  ``ridge`` is added to
    the diagonal, but for the intercept's.  With ``centred`` the features are
    taken about their means, which keeps digits.  Where the equations have no
    unique solution beta is null."""
    kinds = {f.name: f.dataType.simpleString() for f in equations.schema.fields}
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", beta array<double>, sse double, r2 double, n long"

    def run(frames):
        for frame in frames:
            out = [_solve(r.xx, r.xy, r.y, r.yy, r.n, ridge, centred) for r in frame.itertuples()]
            yield pd.concat([frame[by].reset_index(drop=True),
                             pd.DataFrame(out, columns=["beta", "sse", "r2"]), frame[["n"]].reset_index(drop=True)], axis=1)

    return equations.mapInPandas(run, schema)


def _solve(xx, xy, y, yy, n, ridge, centred):
    p = len(xy)
    a = np.zeros((p, p))
    a[np.triu_indices(p)] = xx
    a = a + np.triu(a, 1).T
    b = np.array(xy, dtype=np.float64)
    mean, top = b[0] / n, yy - y * y / n
    middle = a[0, 1:] / n if centred else np.zeros(p - 1)
    s = a[1:, 1:] - n * np.outer(middle, middle) if centred else a[1:, 1:]
    t = b[1:] - n * middle * mean if centred else b[1:]
    try:
        if centred:
            slopes = _cholesky(s + ridge * np.eye(p - 1), t)
            beta = np.concatenate([[mean - slopes @ middle], slopes])
        else:
            beta = _cholesky(a + ridge * np.diag([0.0] + [1.0] * (p - 1)), b)
    except np.linalg.LinAlgError:
        return None, None, None
    sse = max(0.0, yy - 2 * beta @ b + beta @ a @ beta)
    if centred:
        sse = max(0.0, top - 2 * slopes @ t + slopes @ s @ slopes)
    return beta.tolist(), sse, (1 - sse / top if top > 0 else None)


def _cholesky(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solve a x = b for a positive definite a; a pivot lost to rounding
    counts as none."""
    if not len(b):
        return b
    scale = np.sqrt(np.diag(a))
    if (scale <= 0).any():
        raise np.linalg.LinAlgError
    low = np.linalg.cholesky(a / np.outer(scale, scale))
    if np.diag(low).min() < 1e-6:
        raise np.linalg.LinAlgError
    return np.linalg.solve(low.T, np.linalg.solve(low, b / scale)) / scale
