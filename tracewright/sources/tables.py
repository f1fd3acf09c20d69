"""The driver's tables as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    """events as one log; a user's events are a sequence and errors are anomalies."""
    return as_log(table(spark, folder, "events"))


def as_log(e: DataFrame) -> DataFrame:
    """The log of events, of a table or a stream."""
    message = F.concat(F.lit("user "), "user_id", F.lit(" "), "event_type", F.lit(" id "), "event_id", F.lit(" "), "props")
    return e.select(F.col("event_id").alias("row_id"), message.alias("m_message"), F.col("ts").alias("m_timestamp"), F.col("user_id").cast("string").alias("seq_id"), (F.col("event_type") == "error").alias("anomaly"), "event_type")


def log_documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents as multi-line messages."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("row_id"), F.col("text").alias("m_message"), F.col("source").alias("seq_id"), "lang")


def labelled(log: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """What is left of a log of documents with anomaly: toxic ones are, unlabelled ones are not known.

    Drop the text before, so that it isn't shuffled.
    """
    labels = table(spark, folder, "labels").select(F.col("doc_id").alias("row_id"), (F.col("toxic") == 1).alias("anomaly"))
    return log.join(labels, "row_id", "left")


def log_turns(spark: SparkSession, folder: str) -> DataFrame:
    """conversations; each is a sequence of turns."""
    c = table(spark, folder, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), F.col("text").alias("m_message"), F.col("conv_id").cast("string").alias("seq_id"), "role")
