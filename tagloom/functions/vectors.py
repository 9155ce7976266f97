"""Vector helpers: JVM-side array expressions and a size-checked broadcast
of a small matrix (centroids) for Arrow-batched scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest matrix (rows x dims) we ship to executors as a broadcast variable.
MAX_BROADCAST_CELLS = 20_000_000


def dot(a, b) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def collect_matrix(df: DataFrame, key: str, vec: str, max_cells: int = MAX_BROADCAST_CELLS):
    """Collect a small (key, vector) table as (keys, float64 matrix).

    The size is checked before anything moves: rows x dims must stay under
    ``max_cells``; a larger table raises instead of flooding the driver.
    """
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("d")).first()
    n, d = int(stats["n"] or 0), int(stats["d"] or 0)
    if n * d > max_cells:
        raise ValueError(f"matrix {n}x{d} is above the broadcast bound {max_cells} cells")
    rows = df.select(key, vec).orderBy(key).collect()
    keys = [r[0] for r in rows]
    mat = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), d)
    return keys, mat
