"""Feature vectors and train/test splits for the learned detectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml import Transformer
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...model import ROW, TIME, micros
from .items import items_of

VOCABULARY = 1 << 20


def test_train_split(df: DataFrame, test_frac: float = 0.9, shuffle: bool = True, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last int(test_frac * n) rows by hash, or by start_time or m_timestamp, are the test.

    The cut is a quantile of the order; only rows that tie with it are ranked.
    """
    n = df.count()
    wanted = n - int(test_frac * n)
    if wanted >= n:
        return df, df.limit(0)
    name = next((c for c in ("start_time", TIME) if c in df.columns), None)
    order = F.xxhash64(F.lit(seed), F.col(ROW)) if shuffle or name is None else micros(name)
    order = F.col(ROW) if not shuffle and name is None else order
    keyed = df.withColumn("_o", F.coalesce(order.cast("long"), F.lit(-(1 << 62))))
    cut, below = _split_at(keyed, wanted)
    ties = keyed.where(F.col("_o") == cut).orderBy(ROW).limit(max(0, wanted - below)).select(ROW)
    first = keyed.where(F.col("_o") < cut).select(ROW).union(ties)
    return df.join(first, ROW, "left_semi"), df.join(first, ROW, "left_anti")


def _split_at(keyed: DataFrame, wanted: int) -> tuple[int, int]:
    """The value of _o at place wanted, and how many rows are below it; found by halving the range's digits."""
    low, high, below = -(1 << 63), (1 << 63) - 1, 0
    while high > low:
        step = max(1, (high - low) // 4096 + 1)
        # 4096 counts at most
        counts = {r[0]: r[1] for r in keyed.where(F.col("_o").between(low, high)).groupBy(F.floor((F.col("_o").cast("decimal(38,0)") - F.lit(str(low)).cast("decimal(38,0)")) / F.lit(str(step)).cast("decimal(38,0)")).cast("long")).count().collect()}
        for k in sorted(counts):
            if below + counts[k] >= wanted:
                low, high = low + k * step, min(high, low + (k + 1) * step - 1)
                break
            below += counts[k]
        else:
            return high, below
    return low, below


class Vectorizer:
    """Bags of items, embeddings and numbers as one vector column ``features``.

    vectorizer says what a bag becomes: "count", "tfidf" (smoothed inverse document
    frequencies, at length 1), or a function that makes a Spark ML estimator or
    transformer from the names of its input column, lists of strings, and its output
    column, vectors.
    """

    def __init__(self, item_list_col: str | None = None, numeric_cols: list[str] | None = None, emb_list_col: str | None = None, vectorizer: str | Callable = "count"):
        if not (item_list_col or numeric_cols or emb_list_col):
            raise ValueError("No columns to make features of")
        self.items, self.numbers, self.embedding = item_list_col, list(numeric_cols or []), emb_list_col
        if vectorizer not in ("count", "tfidf") and not callable(vectorizer):
            raise ValueError(f"No vectorizer {vectorizer}")
        self.vectorizer = vectorizer
        self.bag: Transformer | None = None
        self.weights: list[float] | None = None

    def _items(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_items", F.coalesce(F.filter(items_of(df, self.items), lambda x: x.isNotNull()), F.array().cast("array<string>")))

    def fit(self, df: DataFrame) -> Vectorizer:
        if not self.items:
            return self
        rows = self._items(df)
        if callable(self.vectorizer):
            made = self.vectorizer("_items", "_bag")
            self.bag = made.fit(rows) if hasattr(made, "fit") else made
            return self
        self.bag = CountVectorizer(inputCol="_items", outputCol="_bag", vocabSize=VOCABULARY, minDF=1).fit(rows)
        if self.vectorizer == "tfidf":
            counted = IDF(inputCol="_bag", outputCol="_idf").fit(self.bag.transform(rows))
            self.weights = [math.log((1 + counted.numDocs) / (1 + n)) + 1 for n in counted.docFreq]
        return self

    def _bags(self, df: DataFrame) -> DataFrame:
        out = self.bag.transform(self._items(df))
        if self.weights is None:
            return out
        scaled = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol="_bag", outputCol="_scaled").transform(out)
        return Normalizer(inputCol="_scaled", outputCol="_unit").transform(scaled).drop("_bag", "_scaled").withColumnRenamed("_unit", "_bag")

    def transform(self, df: DataFrame) -> DataFrame:
        parts = []
        out = df
        if self.items:
            out, parts = self._bags(out), ["_bag"]
        if self.embedding:
            out, parts = out.withColumn("_emb", array_to_vector(F.col(self.embedding).cast("array<double>"))), [*parts, "_emb"]
        for k, c in enumerate(self.numbers):
            out, parts = out.withColumn(f"_n{k}", F.col(c).cast("double")), [*parts, f"_n{k}"]
        out = VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="error").transform(out)
        return out.drop("_items", *parts)

    def names(self, size: int) -> list[str]:
        """What each position of a vector is."""
        bag = list(getattr(self.bag, "vocabulary", []))
        middle = size - len(bag) - len(self.numbers)
        if self.bag is not None and not bag:  # features of another vectorizer have no names of their own
            return [f"feature[{k}]" for k in range(middle)] + self.numbers
        return bag + [f"{self.embedding}[{k}]" for k in range(middle)] + self.numbers
