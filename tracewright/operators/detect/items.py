"""Detectors over bags of items: rarity and out-of-vocabulary.

A bag is a column of strings or of lists of strings. Strings are tokenised as in
tokens(); lists are used as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...model import ROW
from ...scratch import save


def tokens(column: Column) -> Column:
    """Lower-cased runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(column), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def items_of(df: DataFrame, column: str) -> Column:
    """The bag column as a list; ValueError for other types."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return tokens(F.col(column))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.col(column)
    raise ValueError(f"{column} must hold strings or lists of strings")


def exploded(df: DataFrame, column: str, *keep) -> DataFrame:
    """The items of each row, one per row; a row without items stays with a null term.

    The outer form keeps Spark from testing the list in a filter below, which would
    compute a costly column again.
    """
    return df.select(*keep, F.explode_outer(items_of(df, column)).alias("term"))


def term_counts(df: DataFrame, column: str, key: str = ROW) -> DataFrame:
    """(key, term, n) of every term of each row; null terms don't count."""
    return exploded(df, column, key).where("term IS NOT NULL").groupBy(key, "term").agg(F.count("*").alias("n"))


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """(term, n) over all rows."""
    return exploded(df, column).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))


class RarityModel:
    """Rarity of a term: 0 where its share of all terms is over common_threshold, else -(ln share)^3.

    A row scores the sum over its known terms by count, divided by how many different
    ones it has; over threshold it is an anomaly.
    """

    def __init__(self, threshold: float = 10, common_threshold: float = 0.01):
        self.threshold, self.common = threshold, common_threshold
        self.rarities = None

    def fit(self, df: DataFrame, column: str) -> RarityModel:
        counts = save(vocabulary(df, column), "vocabulary")
        share = F.col("n") / F.col("total")
        log = F.ln(share)
        self.rarities = counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("term", F.when(share > self.common, 0.0).otherwise(-log * log * log).alias("rarity"))
        return self

    def predict(self, df: DataFrame, column: str, key: str = ROW) -> DataFrame:
        """(key, score, pred_ano) for every row of df."""
        counts = exploded(df, column, key).groupBy(key, "term").agg(F.count("*").alias("n")).join(self.rarities, "term", "left")
        known = F.count("rarity")
        mean = F.when(known > 0, F.sum(F.col("n") * F.col("rarity")) / known).otherwise(0.0)
        return counts.groupBy(key).agg(mean.alias("score")).withColumn("pred_ano", (F.col("score") > self.threshold).cast("int"))


class OOV_detector:
    """Scores a row by how many of its items are not in the vocabulary; over threshold it is an anomaly."""

    def __init__(self, threshold: float = 1, len_col: str | None = None):
        self.threshold, self.len_col = threshold, len_col
        self.known = None

    def fit(self, df: DataFrame, column: str) -> OOV_detector:
        self.known = vocabulary(df, column).select("term")
        return self

    def predict(self, df: DataFrame, column: str, key: str = ROW) -> DataFrame:
        """(key, score, pred_ano) for every row of df."""
        # a null item has a place, a row without items has none
        rows = df.select(key, *([self.len_col] if self.len_col in df.columns else []), F.posexplode_outer(items_of(df, column)).alias("pos", "term"))
        size = F.max(self.len_col) if self.len_col in df.columns else F.sum("n")
        counts = rows.groupBy(key, "term").agg(F.count("pos").alias("n"), *([F.max(self.len_col).alias(self.len_col)] if self.len_col in df.columns else []))
        joined = counts.join(self.known.withColumn("known", F.lit(True)), "term", "left")
        score = (F.coalesce(size, F.lit(0)) - F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0))).cast("long")
        return joined.groupBy(key).agg(score.alias("score")).withColumn("pred_ano", (F.col("score") > self.threshold).cast("int"))


def tfidf(df: DataFrame, column: str, key: str = ROW) -> DataFrame:
    """(key, term, weight): counts times ln((1 + rows) / (1 + rows with the term)) + 1, at length 1 per row."""
    counts = save(term_counts(df, column, key), "terms")
    rows = df.agg(F.count("*").alias("rows"))
    frequency = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(rows))
    idf = frequency.select("term", (F.ln((1 + F.col("rows")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighted = counts.join(idf, "term").select(key, "term", (F.col("n") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # a row's terms
    return weighted.select(key, "term", (F.col("w") / norm).alias("weight"))
