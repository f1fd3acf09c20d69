"""The nearest rows by blocks of vectors.

Queries and rows are dealt into blocks of about BLOCK each, and every two blocks meet in
one task, which works out their distances as a matrix product and returns K rows for each
query. So nothing has a row for each pair; the arithmetic still grows with the product of
the two sides, as an exact search without an index does.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _compare(k: int, cosine: bool, apart: bool):
    def run(_, table):
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        x = _matrix(table.column("v"))
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_q, out_r, out_d = [np.empty(0, ids.dtype)], [np.empty(0, ids.dtype)], [np.empty(0)]
        size = (x**2).sum(1)
        for at in range(0, len(q) if len(r) else 0, 256):
            part = q[at : at + 256]
            far = -(x[part] @ x[r].T) if cosine else size[part][:, None] + size[r] - 2 * (x[part] @ x[r].T)
            if apart:
                far[ids[part][:, None] == ids[r]] = np.inf
            n = min(k, len(r))
            # rounding may hide ties: all as near as the last one are worked out once more, each pair alike
            last = np.partition(far, n - 1, 1)[:, n - 1]
            slack = 1e-9 * (1 + (0 if cosine else size[part] + size[r].max()))
            i, j = np.nonzero((far <= (last + slack)[:, None]) & np.isfinite(far))
            a, b = x[part[i]], x[r[j]]
            d = -(a * b).sum(1) if cosine else np.sqrt(((a - b) ** 2).sum(1))
            order = np.lexsort((ids[r[j]], d, i))
            i, j, d = i[order], j[order], d[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q.append(ids[part[i[keep]]])
            out_r.append(ids[r[j[keep]]])
            out_d.append(d[keep])
        return pa.table({"q": pa.array(np.concatenate(out_q)), "r": pa.array(np.concatenate(out_r)), "d": pa.array(np.concatenate(out_d))})

    return run


def neighbours(queries: DataFrame, rows: DataFrame, k: int, cosine: bool, apart: bool = False, block: int = BLOCK) -> DataFrame:
    """(q, r, d): the k rows nearest to each query, the least id of equally near ones.

    queries and rows have id (a long) and v (an array of doubles, never null, all of one
    size). d is the distance, or with cosine the negative product of the vectors; apart
    leaves out a row with the query's own id.
    """
    deal = lambda n: max(1, math.ceil(n / block))
    nq, nr = deal(queries.count()), deal(rows.count())
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = queries.select("id", "v", F.lit(True).alias("asks"), own(nq).alias("a"), all_of(nr).alias("b"))
    answering = rows.select("id", "v", F.lit(False).alias("asks"), all_of(nq).alias("a"), own(nr).alias("b"))
    found = asking.union(answering).groupBy("a", "b").applyInArrow(_compare(k, cosine, apart), "q long, r long, d double")
    best = F.row_number().over(Window.partitionBy("q").orderBy("d", "r"))  # k for each block of rows
    return found.withColumn("_n", best).where(F.col("_n") <= k).drop("_n")
