"""What several operators need: row numbers, hashes, components, slices of batches."""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import drop, save

#: Rows that one task numbers at most on average, see number_rows.
ROWS_PER_BUCKET = 50_000


def ship(spark: SparkSession, thing) -> Broadcast:
    """Broadcast an object of this package, by value; received() gives it back.

    For what has a bounded size only.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(shared: Broadcast):
    """What ship() was given."""
    return pickle.loads(shared.value)


def doc_key(text: Column) -> Column:
    """With doc_id, this tells rows apart; rows that agree in both count as one document."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def number_rows(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """Add out: the row's gapless 0-based number within its group of by.

    No group meets in one task: rows are dealt to hashed buckets, as many as there are
    shuffle partitions and so many that ROWS_PER_BUCKET is their mean, numbered there by
    order, and shifted by the sizes of the buckets before. df is read three times, so
    give a saved table. Rows that agree in all of order may take each other's number.
    """
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spread, math.ceil(df.count() / ROWS_PER_BUCKET))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*by, "_bucket"]
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = df.groupBy(*keys).count().select(*keys, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_inside", inside).join(shift, keys).withColumn(out, (F.col("_shift") + F.col("_inside")).cast("long")).drop("_bucket", "_shift", "_inside")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose results look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Forest:
    """Union-find over whatever can be a dict's key; the least member is the root."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            if y < x:
                x, y = y, x
            self.up[y] = x
            self.up.setdefault(x, x)

    def edges(self):
        """(member, root) of all that are not roots."""
        return [(x, r) for x in list(self.up) if (r := self.root(x)) != x]


def _thin(batches):
    """Edges of a partition, reduced to a spanning forest."""
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            forest.join(u, v)
    edges = forest.edges()
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long): root is the least node reachable.

    Each partition first reduces its edges to a spanning forest. Then large-star and
    small-star rounds run until the edges stay the same; each node keeps only its
    least neighbour, by partial aggregation, so a hub never meets in one task. Each
    round is a saved table. Null nodes and loops are ignored.
    """
    now = save(edges.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_thin, "u long, v long"), "edges")
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        # the minima are tables of their own, so that Spark can split the rows of a hub in the joins
        least = save(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = save(large, "large")
        low = save(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("u"), F.col("m").alias("v"))
        after = save(small.union(low.select("a", "m")).distinct(), "edges")
        drop(now, least, large, low)
        now = after
        was, mark = mark, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if was == mark:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def take_batches(batches, most_bytes: int = 4 << 20, column: str = "text"):
    """Slices of Arrow batches whose text column holds about most_bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at)
        if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type) or pa.types.is_binary(col.type)):
            yield batch
            continue
        width = np.int64 if pa.types.is_large_string(col.type) else np.int32
        ends = np.frombuffer(col.buffers()[1], width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most_bytes, "right")) - 1
            stop = min(batch.num_rows, max(start + 1, stop))
            yield batch.slice(start, stop - start)
            start = stop
