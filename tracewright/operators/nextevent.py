"""Next-event prediction from n-grams of event ids within sequences.

A sequence is padded with SoS before and one EoS after it. A context is the ngrams - 1
events before a position. Contexts and counts are tables; positions come from lag, so a
long sequence is never an array.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ROW, SEQUENCE
from .sequences import in_row_order

START, END, UNSEEN = "SoS", "EoS", "<UNSEEN>"


class NextEventPredictionNgram:
    """Fit on and predict events (seq_id, row_id, event)."""

    def __init__(self, ngrams: int = 5):
        if ngrams < 2:
            raise ValueError("ngrams must be 2 or more")
        self.ngrams = ngrams
        self.pairs = self.contexts = None

    def slices(self, events: DataFrame) -> DataFrame:
        """(seq_id, pos, context, event): one row per event and one for the end of each sequence."""
        rows = events.select(SEQUENCE, F.lit(0).alias("last"), F.col(ROW), F.col("event").cast("string").alias("event"))
        ends = events.select(SEQUENCE).distinct().select(SEQUENCE, F.lit(1).alias("last"), F.lit(None).cast("long").alias(ROW), F.lit(END).alias("event"))
        w = Window.partitionBy(SEQUENCE).orderBy("last", ROW)
        before = [F.lag("event", k, START).over(w) for k in range(self.ngrams - 1, 0, -1)]
        return rows.union(ends).select(SEQUENCE, (F.row_number().over(w) - 1).alias("pos"), F.array(*before).alias("context"), "event")

    def fit(self, events: DataFrame) -> NextEventPredictionNgram:
        sliced = self.slices(events)
        # first seen: by sequence, then position
        self.pairs = sliced.groupBy("context", "event").agg(F.count("*").alias("n"), F.min(F.struct(SEQUENCE, "pos")).alias("first"))
        best = F.min(F.struct((-F.col("n")).alias("less"), "first", "event")).alias("best")
        self.contexts = self.pairs.groupBy("context").agg(F.sum("n").alias("context_n"), best).select("context", "context_n", F.col("best.event").alias("predicted"), (-F.col("best.less")).alias("best_n"))
        return self

    def score(self, events: DataFrame) -> DataFrame:
        """(seq_id, pos, event, nep_predict, nep_corr, nep_abs, nep_prob_nsum, nep_prob_nmax) per position."""
        joined = self.slices(events).join(self.contexts, "context", "left").join(self.pairs.select("context", "event", "n"), ["context", "event"], "left")
        n = F.coalesce("n", F.lit(0)).cast("long")
        over = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(1))
        return joined.select(
            SEQUENCE, "pos", "event", F.coalesce("predicted", F.lit(UNSEEN)).alias("nep_predict"),
            F.coalesce((F.col("predicted") == F.col("event")).cast("int"), F.lit(0)).alias("nep_corr"), n.alias("nep_abs"),
            (n / over("context_n")).alias("nep_prob_nsum"), (n / over("best_n")).alias("nep_prob_nmax"),
        )

    def per_sequence(self, events: DataFrame) -> DataFrame:
        """Lists by position, and average, largest and least of counts and probabilities, per sequence."""
        scored = self.score(events)
        lists = [in_row_order(F.col(c), "pos").alias(c) for c in ("nep_predict", "nep_corr", "nep_abs", "nep_prob_nsum", "nep_prob_nmax")]
        stats = [f(c).alias(f"{c}_{k}") for c in ("nep_abs", "nep_prob_nmax") for k, f in (("avg", F.avg), ("max", F.max), ("min", F.min))]
        return scored.groupBy(SEQUENCE).agg(*lists, *stats, perplexity("nep_prob_nmax").alias("nep_prob_nmax_perp"))


def perplexity(column: str):
    """exp(-mean(ln p)); infinite if any p is 0."""
    log = F.when(F.col(column) == 0, F.lit(float("-inf"))).otherwise(F.ln(column))
    return F.exp(-F.avg(log))
