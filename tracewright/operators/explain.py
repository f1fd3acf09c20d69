"""Explanations: nearest normal events, wrong predictions, and contributions of features."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ROW
from .joins import nearest

MOST_FEATURES, MOST_CELLS = 1500, 1_500_000


class NNExplainer:
    """The normal row of largest cosine for each predicted anomaly.

    df has row_id, features (a vector), pred_ano and the label.
    """

    def __init__(self, df: DataFrame, id_col: str = ROW, pred_col: str = "pred_ano", label_col: str = "anomaly"):
        self.df, self.id, self.pred, self.label = df, id_col, pred_col, label_col

    def mapping(self) -> DataFrame:
        """(id, nearest, similarity) for every predicted anomaly."""
        rows = self.df.select(self.id, self.pred, vector_to_array("features").alias("_v"))
        return nearest(rows.where(F.col(self.pred) == 1), rows.where(F.col(self.pred) != 1), self.id, "_v")

    def content(self, column: str) -> DataFrame:
        """(id, anomalous, nearest, normal): the column of both rows of each pair."""
        pairs = self.mapping()
        text = self.df.select(self.id, column)
        return pairs.join(text.withColumnRenamed(column, "anomalous"), self.id).join(text.select(F.col(self.id).alias("nearest"), F.col(column).alias("normal")), "nearest").select(self.id, "anomalous", "nearest", "normal", "similarity")

    def false_positives(self) -> DataFrame:
        return self.df.where((F.col(self.pred) == 1) & ~F.col(self.label).cast("boolean"))

    def false_negatives(self) -> DataFrame:
        return self.df.where((F.col(self.pred) != 1) & F.col(self.label).cast("boolean"))

    def plane(self) -> DataFrame:
        """(id, x, y, pred): the rows on their two main components, for a plot."""
        out = PCA(k=2, inputCol="features", outputCol="_p").fit(self.df).transform(self.df)
        xy = vector_to_array("_p")
        return out.select(self.id, F.get(xy, F.lit(0)).alias("x"), F.get(xy, F.lit(1)).alias("y"), self.pred)


class ShapExplainer:
    """Shapley values of a trained AnomalyDetector's features for its test rows.

    Linear models have them in closed form, weight times distance from the mean. For trees
    they are exact, by weighing both ways at each split with a feature that isn't known
    (path-dependent expectations), for up to MOST_FEATURES features. Those of an isolation
    forest explain the mean path length: negative ones make a row more of an anomaly.
    """

    def __init__(self, detector, ignore_warning: bool = False):
        self.detector, self.ignore = detector, ignore_warning
        self.kind = {"LR": "linear", "LSVM": "linear", "DT": "tree", "RF": "tree", "XGB": "tree", "IsolationForest": "tree"}.get(detector.name)
        if self.kind is None:
            raise NotImplementedError(f"No explanation for {detector.name}")

    def _check(self, rows: int, features: int) -> None:
        if not self.ignore and (features >= MOST_FEATURES or rows * features >= MOST_CELLS):
            raise ResourceWarning(f"{rows} rows of {features} features; pass ignore_warning=True to go on")

    def values(self) -> DataFrame:
        """(row_id, shap): an array of values, one per feature."""
        rows, model = self.detector.test_x, self.detector.model
        size = rows.select(F.size(vector_to_array("features"))).first()
        self._check(rows.count(), size[0] if size else 0)
        x = vector_to_array("features")
        if self.kind == "linear":
            from pyspark.ml.stat import Summarizer

            weights = np.asarray((model.coefficients if self.detector.name == "LSVM" else model.coefficientMatrix).toArray()).ravel()
            train, _, _ = self.detector._rows(self.detector.filter_anos)
            mean = train.select(Summarizer.mean(train["features"]).alias("m")).first()["m"].toArray()

            @F.pandas_udf("array<double>")
            def linear(v: pd.Series) -> pd.Series:
                return pd.Series(list((np.stack(v.to_numpy()) - mean) * weights)) if len(v) else pd.Series([], dtype=object)

            return rows.select(ROW, linear(x).alias("shap"))
        if self.detector.name == "IsolationForest":
            trees = [(t, 1 / len(model.trees)) for t in model.trees]
        else:
            trees = [(self._tree(t._call_java("rootNode"), self.detector.name), w) for t, w in self._trees(model)]

        @F.pandas_udf("array<double>")
        def by_trees(v: pd.Series) -> pd.Series:
            return pd.Series([tree_shap(trees, row) for row in v])

        return rows.select(ROW, by_trees(x).alias("shap"))

    @staticmethod
    def _trees(model):
        if not hasattr(model, "trees"):
            return [(model, 1.0)]
        weights = list(model.treeWeights)
        scale = 1.0 if type(model).__name__.startswith("GBT") else sum(weights)
        return [(t, w / scale) for t, w in zip(model.trees, weights, strict=True)]

    def _tree(self, node, name):
        """(value, weight) of a leaf; (feature, threshold, left, right, weight) of a split."""
        weight = float(node.impurityStats().count())
        if node.subtreeDepth() == 0:
            value = node.prediction() if name == "XGB" else self._share(node)
            return value, weight
        split = node.split()
        left, right = self._tree(node.leftChild(), name), self._tree(node.rightChild(), name)
        return split.featureIndex(), split.threshold(), left, right, left[-1] + right[-1]

    @staticmethod
    def _share(node) -> float:
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0

    def feature_names(self) -> list[str]:
        size = self.detector.test_x.select(F.size(vector_to_array("features"))).first()[0]
        return self.detector.used.names(size)

    def sorted_shapvalues(self) -> DataFrame:
        """(feature, total): the sum of absolute values of each feature, largest first."""
        totals = self.values().select(F.posexplode("shap").alias("k", "v")).groupBy("k").agg(F.sum(F.abs("v")).alias("total"))
        names = self.detector.train_df.sparkSession.createDataFrame(list(enumerate(self.feature_names())), "k long, feature string")
        return totals.join(names, "k").select("feature", "total").orderBy(F.desc("total"), "feature")

    def sorted_featurenames(self, width: int = 16) -> list[str]:
        """Feature names by importance, cut to width characters."""
        return [r["feature"][:width] for r in self.sorted_shapvalues().limit(MOST_FEATURES).collect()]

    def plot_data(self, top: int = 20) -> DataFrame:
        """(row_id, feature, value, shap) of the top features, for a plot."""
        names = self.detector.train_df.sparkSession.createDataFrame(list(enumerate(self.feature_names())), "k long, feature string")
        best = self.sorted_shapvalues().limit(top).select("feature")
        long = self.values().select(ROW, F.posexplode("shap").alias("k", "shap")).join(names, "k").join(best, "feature", "left_semi")
        x = self.detector.test_x.select(ROW, F.posexplode(vector_to_array("features")).alias("k", "value"))
        return long.join(x, [ROW, "k"]).select(ROW, "feature", "value", "shap")


def tree_shap(trees, x) -> list[float]:
    """Shapley values of weighted trees at x under path-dependent expectations.

    Each leaf's game is a product over the features on its path: a known one passes (1) or
    blocks (0) it, an unknown one lets the share of training rows through. The values of
    such a product come from the elementary symmetric sums of the others' terms.
    """
    out = np.zeros(len(x))

    def leaf(value: float, path: dict[int, list[float]]) -> None:
        features = list(path)
        n = len(features)
        for f in features:
            # sizes[s]: sum over sets of s other known features of the product of all terms
            sizes = np.zeros(n)
            sizes[0] = 1.0
            for g in features:
                if g != f:
                    share, hit = path[g]
                    sizes[1:] = sizes[1:] * share + sizes[:-1] * hit
                    sizes[0] *= share
            weight = np.array([1.0 / (n * _choose(n - 1, s)) for s in range(n)])
            share, hit = path[f]
            out[f] += value * (hit - share) * float(sizes @ weight)

    def walk(node, scale: float, path: dict[int, list[float]]) -> None:
        if len(node) == 2:
            if path:
                leaf(node[0] * scale, path)
            return
        f, at, left, right, weight = node
        for child, goes in ((left, x[f] <= at), (right, x[f] > at)):
            share, hit = path.get(f, (1.0, 1.0))
            walk(child, scale, path | {f: [share * child[-1] / max(weight, 1e-300), hit * float(goes)]})

    for tree, scale in trees:
        walk(tree, scale, {})
    return out.tolist()


def _choose(n: int, k: int) -> float:
    from math import comb

    return float(comb(n, k))
