"""AEL: messages in bins of equal token and parameter counts.

A bin with more than LEAST_EVENTS different messages becomes one template: the positions
where its messages differ are parameters. A message whose tokens are those of the bin's
first message, but spaced otherwise, is never merged, and neither are messages without
tokens. All of it is grouping, so no order but the first row of each bin matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...model import ROW
from ...scratch import save

WILD, LEAST_EVENTS = "<*>", 2


def short_id(template: Column) -> Column:
    """The first eight hexadecimal digits of the MD5 sum."""
    return F.substring(F.md5(template), 1, 8)


def blank_split(message: Column) -> Column:
    """Tokens between white space, none of them empty."""
    return F.filter(F.split(message, r"\s+"), lambda t: t != "")


def parse_ael(df: DataFrame, column: str = "e_message_normalized", least_events: int = LEAST_EVENTS) -> DataFrame:
    """df with e_event_ael_id and e_template_ael; null messages have neither."""
    texts = save(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.min(ROW).alias("first")), "texts")
    tokens = texts.withColumn("tokens", blank_split(F.col("text")))
    binned = tokens.withColumns({"size": F.size("tokens"), "params": F.size(F.filter("tokens", lambda t: t == WILD))})
    head = binned.groupBy("size", "params").agg(F.count("*").alias("events"), F.min_by("tokens", "first").alias("head"), F.min_by("text", "first").alias("head_text"))
    joined = binned.join(head, ["size", "params"])
    merges = (F.col("events") > least_events) & (F.col("size") > 0) & ((F.col("tokens") != F.col("head")) | (F.col("text") == F.col("head_text")))
    joined = joined.withColumn("merges", merges)
    words = joined.where("merges").select("size", "params", "text", F.posexplode("tokens").alias("pos", "word"))
    at = words.groupBy("size", "params", "pos").agg(F.min("word").alias("low"), F.max("word").alias("high"), F.count("*").alias("n"))
    shown = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILD)
    merged = at.groupBy("size", "params").agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("word")))).alias("parts"), F.max("n").alias("n"))
    merged = merged.where("n > 1").select("size", "params", F.array_join(F.transform("parts", lambda p: p["word"]), " ").alias("merged"))
    named = joined.join(merged, ["size", "params"], "left").select("text", F.when(F.col("merges"), F.coalesce("merged", "text")).otherwise(F.col("text")).alias("e_template_ael"))
    out = df.join(named, df[column] == named["text"], "left").drop("text")
    return out.withColumn("e_event_ael_id", short_id(F.col("e_template_ael")))


parse_ael.id_column, parse_ael.more_columns = "e_event_ael_id", ("e_template_ael",)
