"""Brain: templates from how often each word stands at each position of the corpus.

A message's root is the frequency that most of its words have (the earliest of equal
ones). Messages of equal length and root are a group. Positions whose frequency is not
the root's in the group's first message are looked at: where the group has two words or
more, these words are variable in the whole group. So are words with a digit share of
DIGITS or more. Everything is grouping and joins. Words travel with their message's first
row as its number, never with its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...model import ROW
from ...scratch import save
from ..windows import numbered
from .bins import WILD

LEAST_WORDS, DIGITS = 2, 0.3
_GROUP = ("size", "root", "root_words")


def parse_brain(df: DataFrame, column: str = "e_message_normalized", threshold: int = LEAST_WORDS) -> DataFrame:
    """df with e_event_brain_id and e_template_brain; ids by the first row of each template."""
    spaced = F.regexp_replace(F.regexp_replace("text", ",", ", "), " +", " ")
    texts = save(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.min(ROW).alias("first"), F.count("*").alias("n")), "texts")
    split = texts.select("first", "n", F.split(spaced, " ").alias("tokens"))
    words = split.select("first", "n", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "word"))
    often = words.groupBy("pos", "word").agg(F.sum("n").alias("often"))
    # dealt by message once: the root and its join need no further shuffle
    counted = words.join(often, ["pos", "word"]).select("first", "size", "pos", "word", "often").repartition("first")
    share = counted.groupBy("first", "size", "often").agg(F.count("*").alias("words"), F.min("pos").alias("pos"))
    root = share.groupBy("first", "size").agg(F.min(F.struct((-F.col("words")).alias("less"), "pos", "often")).alias("root")).select("first", F.col("root.often").alias("root"), (-F.col("root.less")).alias("root_words"))
    words = save(counted.join(root, "first"), "brain-words")
    head = words.groupBy(*_GROUP).agg(F.min("first").alias("first"))
    looked = words.where("often <> root").join(head, [*_GROUP, "first"]).select(*_GROUP, "pos")
    at = words.select(*_GROUP, "pos", "word").distinct().join(looked, [*_GROUP, "pos"])
    varied = at.groupBy(*_GROUP, "pos").agg(F.count("*").alias("words")).where(F.col("words") >= threshold).drop("words")
    variable = at.join(varied, [*_GROUP, "pos"]).select(*_GROUP, "word").distinct().withColumn("variable", F.lit(True))
    digits = F.char_length(F.regexp_replace("word", r"[^\p{Nd}]", ""))
    hidden = F.contains("word", F.lit(WILD)) | F.coalesce("variable", F.lit(False)) | ((digits > 0) & (digits / F.char_length("word") >= DIGITS))
    shown = words.join(variable, [*_GROUP, "word"], "left").select("first", "pos", F.when(hidden, WILD).otherwise(F.col("word")).alias("shown"))
    made = shown.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("pos", "shown"))).alias("parts"))
    made = save(made.select("first", F.array_join(F.transform("parts", lambda p: p["shown"]), " ").alias("e_template_brain")), "brain-templates")
    ids = numbered(made.groupBy("e_template_brain").agg(F.min("first").alias("first")), "first", "_k")
    ids = ids.select("e_template_brain", F.concat(F.lit("E"), F.col("_k") - 1).alias("e_event_brain_id"))
    named = texts.select("text", "first").join(made.join(ids, "e_template_brain"), "first").drop("first")
    return df.join(named, df[column] == named["text"], "left").drop("text")


parse_brain.id_column, parse_brain.more_columns = "e_event_brain_id", ("e_template_brain",)
