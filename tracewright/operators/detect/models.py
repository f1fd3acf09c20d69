"""Detectors without a counterpart in Spark: isolation forest, local outliers and one-class SVM.

What they learn is bounded: trees over samples of at most 256 rows, random features of a
fixed number. Rows are scored by Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...model import ROW
from ...scratch import save
from ..neighbours import BLOCK, neighbours


def _sample(df: DataFrame, most: int, seed: int) -> np.ndarray:
    """At most ``most`` feature rows, those of least hash."""
    rows = df.select("features").orderBy(F.xxhash64(F.lit(seed), F.col(ROW)), ROW).limit(most).collect()
    return np.array([r[0].toArray() for r in rows])


def _average_path(n) -> float:
    """The mean path length of an unsuccessful search among n."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class IsolationForest:
    """Trees that cut random features at random values; short paths are anomalies.

    decision = 0.5 - 2^(-mean path / c); a negative one is an anomaly. score = 1 - decision.
    """

    def __init__(self, n_estimators: int = 100, max_samples: int = 256, seed: int = 42):
        self.n, self.most, self.seed, self.trees, self.norm = n_estimators, max_samples, seed, [], 1.0

    def fit(self, df: DataFrame) -> IsolationForest:
        pool = _sample(df, 16 * self.most, self.seed)
        if not len(pool):
            return self
        rng = np.random.default_rng(self.seed)
        size = min(self.most, len(pool))
        depth = int(np.ceil(np.log2(max(2, size))))
        self.trees = [self._tree(pool[rng.choice(len(pool), size, replace=False)], depth, rng) for _ in range(self.n)]
        self.norm = max(_average_path(size), 1e-12)
        return self

    def _tree(self, x, depth, rng, above=0):
        """(path length, rows) of a leaf; (feature, threshold, left, right, rows) of a split."""
        varied = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 else []
        if depth == 0 or not len(varied):
            return above + _average_path(len(x)), float(len(x))
        k = int(rng.choice(varied))
        at = rng.uniform(x[:, k].min(), x[:, k].max())
        left = x[:, k] <= at
        return k, float(at), self._tree(x[left], depth - 1, rng, above + 1), self._tree(x[~left], depth - 1, rng, above + 1), float(len(x))

    def _paths(self, tree, x, rows, out):
        if len(tree) == 2:
            out[rows] += tree[0]
            return
        k, at, low, high, _ = tree
        left = x[rows, k] <= at
        self._paths(low, x, rows[left], out)
        self._paths(high, x, rows[~left], out)

    def decide(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            self._paths(tree, x, np.arange(len(x)), total)
        return 0.5 - 2 ** (-total / max(1, len(self.trees)) / self.norm)

    def transform(self, df: DataFrame) -> DataFrame:
        return _scored(df, lambda x: (d := self.decide(x), 1 - d)[1], lambda s: s > 1)


class Outside:
    """An object with fit and predict for arrays, fitted on the driver and applied by batches."""

    def __init__(self, model):
        self.model = model

    def fit(self, df: DataFrame, most: int, seed: int) -> Outside:
        labelled = "_y" in df.columns
        rows = df.orderBy(F.xxhash64(F.lit(seed), F.col(ROW)), ROW).limit(most).collect()
        x = np.array([r["features"].toArray() for r in rows])
        try:
            self.model.fit(x, np.array([r["_y"] for r in rows])) if labelled else self.model.fit(x)
        except TypeError:  # it takes no labels
            self.model.fit(x)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        made = np.asarray(self.model.predict(x), float)
        return np.where(made < 0, 1.0, np.where((made == 1) & (self._signed()), 0.0, made))

    def _signed(self) -> bool:
        """Whether it says 1 for normal rows and -1 for others."""
        return bool(getattr(self.model, "signed", hasattr(self.model, "decision_function") and not hasattr(self.model, "classes_")))

    def transform(self, df: DataFrame) -> DataFrame:
        return _scored(df, self.score, lambda s: s >= 0.5)


class OneClassSVM:
    """The smallest half-space of random Fourier features that holds all but a share nu of the rows.

    A sample of at most ``most`` rows fits it; a negative decision is an anomaly.
    """

    def __init__(self, nu: float = 0.5, features: int = 256, most: int = 4096, rounds: int = 1000, seed: int = 42):
        self.nu, self.features, self.most, self.rounds, self.seed = nu, features, most, rounds, seed

    def _map(self, x):
        return np.sqrt(2 / self.features) * np.cos(x @ self.directions + self.phases)

    def fit(self, df: DataFrame) -> OneClassSVM:
        x, rng = _sample(df, self.most, self.seed), np.random.default_rng(self.seed)
        if not len(x):
            x = np.zeros((1, 1))
        gamma = 1 / (x.shape[1] * max(float(x.var()), 1e-9))
        self.directions = rng.normal(size=(x.shape[1], self.features)) * np.sqrt(2 * gamma)
        self.phases = rng.uniform(0, 2 * np.pi, self.features)
        z = self._map(x)
        w, rho = z.mean(0), 0.0
        for k in range(1, self.rounds + 1):
            score = z @ w
            rho = float(np.quantile(score, self.nu))
            out = score < rho
            w -= (w - z[out].sum(0) / (self.nu * len(z))) / k if out.any() else w / k
        self.w, self.rho = w, float(np.quantile(z @ w, self.nu))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return _scored(df, lambda x: self.rho - self._map(x) @ self.w, lambda s: s > 0)


def _scored(df: DataFrame, score, anomalous) -> DataFrame:
    @F.pandas_udf("double")
    def of(vectors: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(vectors.to_numpy())) if len(vectors) else np.empty(0))

    out = df.withColumn("score", of(vector_to_array("features")))
    return out.withColumn("pred_ano", anomalous(F.col("score")).cast("int"))


class LocalOutlierFactor:
    """How much thinner a row's surroundings are than its neighbours', with k neighbours among the training rows.

    Rows meet the training rows block by block, see operators.neighbours. A factor over
    1.5 is an anomaly.
    """

    def __init__(self, n_neighbors: int = 20, block: int = BLOCK, limit: float = 1.5):
        self.k, self.block, self.limit = n_neighbors, block, limit

    def _neighbours(self, rows: DataFrame, same: bool) -> DataFrame:
        """(key, other, d) of the k nearest training rows of each row."""
        as_arrays = lambda df: df.select(F.col(ROW).alias("id"), vector_to_array("features").alias("v"))
        found = neighbours(as_arrays(rows), as_arrays(self.train), self.k, False, same, self.block)
        return save(found.select(F.col("q").alias("key"), F.col("r").alias("other"), "d"), "neighbours")

    def fit(self, df: DataFrame) -> LocalOutlierFactor:
        self.train = df.select(ROW, "features")
        near = self._neighbours(self.train, True)
        self.reach = near.groupBy("key").agg(F.max("d").alias("reach")).withColumnRenamed("key", "other")
        self.density = self._density(near).withColumnsRenamed({"key": "other", "density": "other_density"})
        return self

    def _density(self, near: DataFrame) -> DataFrame:
        far = near.join(self.reach, "other").groupBy("key").agg(F.avg(F.greatest("d", "reach")).alias("m"))
        return far.select("key", (1 / (F.col("m") + 1e-10)).alias("density"))

    def transform(self, df: DataFrame) -> DataFrame:
        near = self._neighbours(df, False)
        ratio = near.join(self.density, "other").join(self._density(near), "key").groupBy("key").agg((F.avg("other_density") / F.max("density")).alias("score"))
        out = df.join(ratio.withColumnRenamed("key", ROW), ROW, "left").withColumn("score", F.coalesce("score", F.lit(1.0)))
        return out.withColumn("pred_ano", (F.col("score") > self.limit).cast("int"))
