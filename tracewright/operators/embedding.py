"""Message embeddings by a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PIECES, BATCH = 30, 1000


def with_encoder(df: DataFrame, column: str, name: str, make: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """df with name: what the encoder gives for each message, a null one as empty text.

    make() is called once per task and returns a function from texts to a matrix.
    """

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make()
        for texts in batches:
            rows = [encoder(texts[k : k + BATCH].fillna("").tolist()) for k in range(0, len(texts), BATCH)]
            yield pd.Series([v for m in rows for v in np.asarray(m, np.float32)])

    return df.withColumn(name, encode(F.col(column)))


def hashing_encoder(dimensions: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in where no language model is at hand: each of the first MOST_PIECES words gives a fixed
    random vector, and a message is their mean over all MOST_PIECES places, empty ones included."""

    def vector(word: str) -> np.ndarray:
        return np.random.default_rng(xxhash.xxh64_intdigest(word)).normal(size=dimensions)

    def encode(texts: list[str]) -> np.ndarray:
        known: dict[str, np.ndarray] = {}
        out = np.zeros((len(texts), dimensions))
        for k, text in enumerate(texts):
            for word in text.lower().split()[:MOST_PIECES]:
                if word not in known:
                    known[word] = vector(word)
                out[k] += known[word]
        return out / MOST_PIECES

    return encode
