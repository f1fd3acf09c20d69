"""Time-bounded joins of labels with logs and metrics, and nearest vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import micros
from .neighbours import BLOCK, neighbours

MINUTE = 60_000_000


def label_range_join(rows: DataFrame, labels: DataFrame, key: str, time: str, label_key: str, label_time: str, minutes: float = 3) -> DataFrame:
    """rows with flag anomaly: whether a label of the same key is less than or exactly minutes earlier.

    Each row stays once for each such label, and once without one. Labels are split into
    intervals' buckets of time, so the join is an equality on key and bucket, whatever
    the sizes of the two sides.
    """
    span = int(minutes * MINUTE)
    tagged = labels.select(F.col(label_key).alias("_key"), micros(label_time).alias("_from"), *labels.columns)
    slots = F.explode(F.sequence(F.floor(F.col("_from") / span), F.floor(F.col("_from") / span) + 1))
    tagged = tagged.withColumn("_slot", slots)
    at = micros(time)
    keyed = rows.withColumn("_at", at).withColumn("_slot_of", F.floor(F.col("_at") / span))
    on = (keyed[key] == tagged["_key"]) & (F.col("_slot_of") == F.col("_slot")) & (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_from") + span)
    out = keyed.join(tagged, on, "left").withColumn("anomaly", F.col("_from").isNotNull())
    return out.drop("_key", "_from", "_slot", "_slot_of", "_at")


def graded_label_ratio(rows: DataFrame, labels: DataFrame, key: str, time: str, label_key: str, label_time: str) -> DataFrame:
    """rows with anomaly and ratio for samples that cover the minute before them.

    From one to three minutes after a label the ratio is 1; in the first and fourth
    minute it is the share of the sample's minute inside; else 0 and no anomaly.
    """
    out = label_range_join(rows, labels.withColumn("_label_at", micros(label_time)), key, time, label_key, label_time, 4)
    m = (micros(time) - F.col("_label_at")) / MINUTE
    out = out.withColumn("ratio", F.when(m < 1, m).when(m <= 3, 1.0).when(m < 4, 4 - m).otherwise(0.0))
    return out.withColumns({"ratio": F.coalesce("ratio", F.lit(0.0)), "anomaly": F.coalesce(F.col("ratio") > 0, F.lit(False))}).drop("_label_at")


def merge_logs_and_traces(logs: DataFrame, traces: DataFrame, suffix: str) -> DataFrame:
    """Inner join on seq_id with the suffix pattern cut from the traces' ids."""
    cut = traces.withColumn("seq_id", F.regexp_replace("seq_id", suffix + r"\z", ""))
    return logs.join(cut.withColumnsRenamed({c: f"trace_{c}" for c in cut.columns if c in logs.columns and c != "seq_id"}), "seq_id")


def unit(vector: Column) -> Column:
    """A vector at length 1; a null or zero one is null."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm))


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, nearest, similarity): the row of largest cosine for each query, the least key of equal ones."""
    units = lambda df: df.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("v")).where("v IS NOT NULL")
    found = neighbours(units(queries), units(rows), 1, True, block=block)
    return found.select(F.col("q").alias(key), F.col("r").alias("nearest"), (-F.col("d")).alias("similarity"))
