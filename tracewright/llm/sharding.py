"""Sharding by a k-d tree over document metadata, with DataFrame operations only.

The tree's points are groups of equal texts with their bytes as weight, so copies stay
on one shard. A group of over a SLICES-th of a shard is cut into slices by the hash of
doc_id; those are a few per shard at most. A node that is to give m shards is cut along
the dimension that is widest in it, against its width over all, so that m // 2 of m
parts of its bytes lie below. The weighted median is found by digits of a 56-bit key,
the coordinate and then 16 bits of the point's hash: each pass sums the bytes of each
value of the next digit and keeps one value per node. So only a few numbers per node
ever come to the driver, and a value that a third of all rows share is cut like others.

The law is ``bytes``: shards differ in size by a document or slice at each cut. A null
text has no bytes and groups with the empty text; null metadata are a value of their
own. Repeated rows each take a slot. An empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import drop, save
from .shared import number_rows

SHARDS, SLICES, DIGIT, DIGITS, TIE = 8, 200, 14, 4, 16
_POINT = ("h", "text_crc32", "size")


def _small(spark, rows: list[tuple], columns: str) -> DataFrame:
    """A table of literals; as many rows as the tree has nodes."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({', '.join(f'{v}L' for v in r)})" for r in rows) + f" AS t({columns})")


def kd_tree(points: DataFrame, dimensions: list[str], shards: int) -> DataFrame:
    """points (weight, tie, and a long below 2^40 for each dimension) with a column shard."""
    spark, now = points.sparkSession, save(points.withColumn("node", F.lit(0).cast("long")), "kd")
    nodes, number = {0: (0, shards)}, 1  # node -> first shard, how many
    widths = [lambda d=d: F.max(d) - F.min(d) for d in dimensions]
    full = None
    while any(m > 1 for _, m in nodes.values()):
        found = now.groupBy("node").agg(F.sum("weight").alias("w"), *(w().alias(f"w{k}") for k, w in enumerate(widths))).collect()
        if full is None:
            full = [max([1, *(r[f"w{k}"] or 0 for r in found)]) for k in range(len(dimensions))]
        cuts = {}  # node -> dimension, digits so far, bytes still to go below
        for r in found:
            m = nodes[r["node"]][1]
            if m > 1:
                cuts[r["node"]] = [max(range(len(dimensions)), key=lambda k: (r[f"w{k}"] or 0) / full[k]), 0, r["w"] * (m // 2) / m]
        if not cuts:
            break
        key = lambda: F.shiftleft(F.element_at(F.array(*(F.col(d) for d in dimensions)), (F.col("cut") + 1).cast("int")), TIE).bitwiseOR(F.col("tie"))
        for digit in range(DIGITS):
            table = _small(spark, [(n, c[0], c[1], int(c[2])) for n, c in cuts.items()], "node, cut, prefix, goal")
            low = DIGIT * (DIGITS - 1 - digit)
            own = now.join(table, "node").withColumn("key", key()).where(F.shiftright("key", low + DIGIT) == F.col("prefix"))
            sums = own.groupBy("node", "goal", F.shiftright("key", low).bitwiseAND((1 << DIGIT) - 1).alias("digit")).agg(F.sum("weight").alias("w"))
            # running sums within ranges of digits, and over the ranges: no task holds a node's digits
            sums = sums.withColumn("range", F.shiftright("digit", DIGIT // 2))
            inside = sums.withColumn("inside", F.sum("w").over(Window.partitionBy("node", "range").orderBy("digit")))
            earlier = Window.partitionBy("node").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
            ranges = sums.groupBy("node", "range").agg(F.sum("w").alias("all")).select("node", "range", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("before"))
            upto = inside.join(ranges, ["node", "range"]).withColumn("upto", F.col("before") + F.col("inside"))
            ends = F.max_by(F.struct("digit", "upto", "w"), "digit").alias("last")
            first = F.min(F.when(F.col("upto") >= F.col("goal"), F.struct("digit", "upto", "w"))).alias("first")
            for r in upto.groupBy("node").agg(first, ends).collect():
                at, c = r["first"] or r["last"], cuts[r["node"]]
                c[1], c[2], last = (c[1] << DIGIT) | at["digit"], c[2] - (at["upto"] - at["w"]), at["w"]
                if digit == DIGITS - 1 and c[2] > last / 2:
                    c[1] += 1  # the points on the cut go below
        table, after = [], {}
        for n, (first, m) in nodes.items():
            if n in cuts:
                table.append((n, cuts[n][0], cuts[n][1], number, number + 1))
                after[number], after[number + 1] = (first, m // 2), (first + m // 2, m - m // 2)
                number += 2
            else:
                after[n] = (first, m)
        cut = now.join(_small(spark, table, "node, cut, bound, below, above"), "node", "left").withColumn("key", key())
        was, now = now, save(cut.withColumn("node", F.when(F.col("cut").isNull(), F.col("node")).when(F.col("key") < F.col("bound"), F.col("below")).otherwise(F.col("above"))).drop("cut", "bound", "below", "above", "key"), "kd")
        drop(was)
        nodes = after
    return now.join(_small(spark, [(n, first) for n, (first, _) in nodes.items()], "node, shard"), "node").withColumn("shard", F.col("shard").cast("int")).drop("node")


def shard(docs: DataFrame, shards: int | None = SHARDS, target_bytes: int | None = None, metadata: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs.

    Give the number of shards, or None and the bytes that a shard should have. The
    dimensions are the text's size and the hashes of the columns named in metadata.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    coordinate = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\0")).cast("binary"))
    rows = save(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
        *(coordinate(c).alias(f"d{k}") for k, c in enumerate(metadata)),
    ), "rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / target_bytes))
    slice_bytes = max(1, total // (shards * SLICES))
    # groups of over slice_bytes: shards * SLICES at most
    large = rows.groupBy(*_POINT).count().select(*_POINT, F.ceil(F.col("count") * F.col("size") / F.lit(slice_bytes)).alias("slices")).where("slices > 1 AND count > 1")
    large = F.broadcast(large) if shards * SLICES <= 100_000 else large
    cut = rows.join(large, list(_POINT), "left").withColumn("slice", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("slices")), F.lit(0))).drop("slices")
    cut = save(cut, "cut")
    point = [*_POINT, "slice"]
    dims = [f"d{k}" for k in range(len(metadata))]
    points = cut.groupBy(*point).agg(F.sum("size").alias("weight"), *(F.min(d).alias(d) for d in dims))
    points = points.withColumn("tie", F.xxhash64("h", "slice").bitwiseAND((1 << TIE) - 1)).withColumn("d_size", F.col("size"))
    placed = kd_tree(points, ["d_size", *dims], shards).select(*point, "shard")
    done = save(cut.join(placed, point).select("doc_id", "size", "text_crc32", "shard"), "placed")
    return number_rows(done, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    """Every row of documents in shards 0 to 7 of nearly equal bytes."""
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
