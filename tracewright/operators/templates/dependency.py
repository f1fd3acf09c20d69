"""Tipping: templates from how words depend on each other.

Two words of a message are interdependent if each occurs with the other in at least
threshold of the messages that it occurs in. A message's key is the component of
interdependent words with the largest total of occurrences; messages with the same key
are one event. Words with digits take no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...model import ROW
from ...scratch import save
from ..windows import numbered
from .bins import WILD, blank_split


def _components(batches):
    """(first, key words) from a message's words, their occurrences and its edges."""
    for batch in batches:
        keys = []
        for words, edges in zip(batch.column("words").to_pylist(), batch.column("edges").to_pylist(), strict=True):
            often = {w["word"]: w["n"] for w in words}
            up = {w: w for w in often}

            def top(w, up=up):
                while up[w] != w:
                    up[w] = up[up[w]]
                    w = up[w]
                return w

            for e in edges or ():
                a, b = top(e["a"]), top(e["b"])
                up[max(a, b)] = min(a, b)
            parts: dict[str, list[str]] = {}
            for w in up:
                parts.setdefault(top(w), []).append(w)
            keys.append(max((sorted(p) for p in parts.values()), key=lambda p: (sum(often[w] for w in p), len(p), p), default=None))
        yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array(keys, pa.list_(pa.string()))], ["first", "key"])


def parse_tip(df: DataFrame, column: str = "e_message_normalized", threshold: float = 0.5, templates: bool = False) -> DataFrame:
    """df with e_event_tip_id and with templates also e_event_tip_template, the least of the event's.

    Ids are numbered by first row; a null message, or one without words, has e_null.
    """
    texts = save(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.min(ROW).alias("first"), F.count("*").alias("n")), "texts")
    words = texts.select("first", "n", F.explode(F.array_distinct(F.filter(blank_split(F.col("text")), lambda t: ~t.rlike("[0-9]")))).alias("word"))
    often = words.groupBy("word").agg(F.sum("n").alias("often"))
    known = words.join(often, "word").groupBy("first", "n").agg(F.array_sort(F.collect_list(F.struct("word", F.col("often").alias("n")))).alias("words"))
    known = save(known, "tip-words")
    # the pairs of a message's words, of those that may depend on each other by how often they occur at all
    heads = known.select("first", "n", "words", F.posexplode("words").alias("at", "a"))
    later = F.expr("slice(words, at + 2, size(words))")
    may = lambda b: F.least(F.col("a.n"), b["n"]) >= threshold * F.greatest(F.col("a.n"), b["n"])
    pairs = heads.select("first", "n", "a", F.explode(F.filter(later, may)).alias("b"))
    pairs = pairs.select("first", "n", F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.greatest("a.n", "b.n").alias("most"))
    strong = pairs.groupBy("a", "b").agg(F.sum("n").alias("both"), F.max("most").alias("most")).where(F.col("both") >= threshold * F.col("most")).select("a", "b")
    edges = pairs.join(strong, ["a", "b"]).groupBy("first").agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    keyed = save(known.select("first", "words").join(edges, "first", "left").mapInArrow(_components, "first long, key array<string>"), "tip-keys")
    shown = F.array_join(F.transform(blank_split(F.col("text")), lambda t: F.when(F.array_contains("key", t), t).otherwise(WILD)), " ")
    events = keyed.join(texts, "first").withColumn("shown", shown).groupBy("key").agg(F.min("first").alias("_first"), F.min("shown").alias("e_event_tip_template"))
    ids = numbered(events, "_first", "_k").select("key", "e_event_tip_template", F.concat(F.lit("e"), F.col("_k")).alias("e_event_tip_id"))
    named = texts.select("text", "first").join(keyed.join(ids, "key"), "first").select("text", "e_event_tip_id", *(["e_event_tip_template"] if templates else []))
    out = df.join(named, df[column] == named["text"], "left").drop("text")
    return out.withColumn("e_event_tip_id", F.coalesce("e_event_tip_id", F.lit("e_null")))


parse_tip.id_column, parse_tip.more_columns = "e_event_tip_id", ("e_event_tip_template",)
