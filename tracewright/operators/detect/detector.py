"""AnomalyDetector: split, vectorise, train by name, predict and keep results."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml import classification as C
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...model import ROW
from ...scratch import save
from . import metrics
from .features import Vectorizer, test_train_split
from .items import OOV_detector, RarityModel
from .models import IsolationForest, LocalOutlierFactor, OneClassSVM, Outside

SUPERVISED = ("LR", "DT", "LSVM", "RF", "XGB")
UNSUPERVISED = ("IsolationForest", "LOF", "KMeans", "OneClassSVM", "RarityModel", "OOVDetector")
#: Folds of the linear SVM's calibration, and rows that an object from outside learns from at most.
FOLDS, MOST_ROWS = 3, 100_000
RESULTS = "run long, model string, supervised boolean, signature string, accuracy double, f1 double, auc double, tp long, fp long, fn long, tn long"


def _margin():
    return F.get(vector_to_array("rawPrediction"), F.lit(1))


class AnomalyDetector:
    """Detectors over one item column, numeric columns and an embedding column.

    predict() returns the test rows with pred_ano and score; evaluate() also keeps their
    measures, which results() returns.
    """

    def __init__(self, item_list_col=None, numeric_cols=None, emb_list_col=None, label_col="anomaly", seed=42, vectorizer="count"):
        self.items, self.numbers, self.embedding, self.label, self.seed = item_list_col, list(numeric_cols or []), emb_list_col, label_col, seed
        self.vectorizer = vectorizer
        self.vectors = Vectorizer(item_list_col, numeric_cols, emb_list_col, vectorizer)
        self.model = self.name = None
        self.stored: list[tuple] = []

    @property
    def signature(self) -> str:
        return "+".join(c for c in [self.items, self.embedding, *self.numbers] if c)

    # --- data

    def test_train_split(self, df: DataFrame, test_frac: float = 0.9, shuffle: bool = True, vectorizer=None) -> None:
        """Split df and fit the features; vectorizer, if given, replaces the detector's, see Vectorizer."""
        if vectorizer is not None:
            self.vectorizer = vectorizer
            self.vectors = Vectorizer(self.items, self.numbers, self.embedding, vectorizer)
        self.train_df, self.test_df = test_train_split(df, test_frac, shuffle, self.seed)
        self.prepare()

    def set_data(self, train: DataFrame, test: DataFrame) -> None:
        self.train_df, self.test_df = train, test
        self.prepare()

    def prepare(self) -> None:
        """Fit the features on the training rows, and others on those that are no anomalies."""
        labelled = self.label in self.train_df.columns
        clean = self.train_df.where(~F.col(self.label).cast("boolean")) if labelled else self.train_df
        self.labelled = labelled
        self.clean_df = clean
        self.x = self.vectors.fit(self.train_df)
        self.x_clean = Vectorizer(self.items, self.numbers, self.embedding, self.vectorizer).fit(clean) if labelled else self.x

    def _rows(self, filter_anos: bool) -> tuple[DataFrame, DataFrame, Vectorizer]:
        vectors, train = (self.x_clean, self.clean_df) if filter_anos else (self.x, self.train_df)
        return vectors.transform(train), vectors.transform(self.test_df), vectors

    # --- training

    def train(self, name: str, filter_anos: bool | None = None, **options) -> AnomalyDetector:
        """Train a detector of SUPERVISED or UNSUPERVISED; options go to it."""
        if name in SUPERVISED and not self.labelled:
            raise ValueError(f"{name} needs the label column {self.label}")
        default = name in ("LOF", "RarityModel", "OOVDetector")
        self.filter_anos = default if filter_anos is None else filter_anos
        self.name = name
        if name in ("RarityModel", "OOVDetector"):
            if self.items is None:
                raise ValueError(f"{name} needs an item column")
            rows = self.clean_df if self.filter_anos else self.train_df
            made = RarityModel(**({"threshold": 250} | options)) if name == "RarityModel" else OOV_detector(**options)
            self.model = made.fit(rows, self.items)
            return self
        train, self.test_x, self.used = self._rows(self.filter_anos)
        if name in SUPERVISED:
            train = train.where(F.col(self.label).isNotNull()).withColumn("_y", F.col(self.label).cast("boolean").cast("double"))
        self.model = getattr(self, f"_{name}")(train, **options)
        return self

    def _LR(self, train, max_iter=4000, tol=0.0003):
        n = max(1, train.count())
        return C.LogisticRegression(labelCol="_y", maxIter=max_iter, tol=tol, regParam=1 / n, elasticNetParam=0, standardization=False).fit(train)

    def _DT(self, train, max_depth=30):
        return C.DecisionTreeClassifier(labelCol="_y", maxDepth=max_depth, seed=self.seed).fit(train)

    def _LSVM(self, train, max_iter=400, tol=0.01, C_=1.0):
        """The margin's logistic, fitted on margins of FOLDS models that have not seen their rows, gives the score."""
        n = max(1, train.count())
        fit = lambda rows, share: C.LinearSVC(labelCol="_y", maxIter=max_iter, tol=tol, regParam=1 / (C_ * max(1, n * share)), standardization=False).fit(rows)
        fold = F.pmod(F.xxhash64(F.lit(self.seed), F.col(ROW)), F.lit(FOLDS))
        folds = []
        for k in range(FOLDS):
            others = train.where(fold != k)
            if others.select("_y").distinct().count() == 2:
                folds.append(fit(others, 1 - 1 / FOLDS).transform(train.where(fold == k)).select("_y", _margin().alias("_m")))
        self.platt = (1.0, 0.0)
        if folds:
            rows = VectorAssembler(inputCols=["_m"], outputCol="_v").transform(save(reduce(DataFrame.union, folds), "margins"))
            if rows.select("_y").distinct().count() == 2:
                slope = C.LogisticRegression(featuresCol="_v", labelCol="_y", standardization=False).fit(rows)
                self.platt = (float(slope.coefficients[0]), float(slope.intercept))
        return fit(train, 1)

    def _RF(self, train, n_estimators=100, max_depth=15):
        return C.RandomForestClassifier(labelCol="_y", numTrees=n_estimators, maxDepth=max_depth, seed=self.seed).fit(train)

    def _XGB(self, train, n_estimators=100, max_depth=6):
        return C.GBTClassifier(labelCol="_y", maxIter=n_estimators, maxDepth=max_depth, stepSize=0.3, seed=self.seed).fit(train)

    def _KMeans(self, train, n_clusters=2):
        return KMeans(k=n_clusters, seed=self.seed).fit(train)

    def _IsolationForest(self, train, **options):
        return IsolationForest(seed=self.seed, **options).fit(train)

    def _LOF(self, train, **options):
        return LocalOutlierFactor(**options).fit(train)

    def _OneClassSVM(self, train, **options):
        return OneClassSVM(seed=self.seed, **options).fit(train)

    def train_model(self, model, name: str | None = None, filter_anos: bool = False, most: int = MOST_ROWS) -> AnomalyDetector:
        """Train any object.

        A Spark ML estimator, whose columns features, label and prediction are set where
        it has such parameters, learns from all rows. Any other object with fit(x) or
        fit(x, y), and predict(x), for arrays of features, learns on the driver from at
        most ``most`` training rows, by the hash of row_id; it predicts on the executors,
        1 or -1 as an anomaly's class. Give a new object, it is changed.
        """
        train, self.test_x, self.used = self._rows(filter_anos)
        self.filter_anos, self.name = filter_anos, name or type(model).__name__
        if self.labelled:
            train = train.where(F.col(self.label).isNotNull()).withColumn("_y", F.col(self.label).cast("boolean").cast("double"))
        if hasattr(model, "extractParamMap"):
            for key, value in (("featuresCol", "features"), ("labelCol", "_y"), ("predictionCol", "prediction")):
                if model.hasParam(key):
                    model.set(model.getParam(key), value)
            self.model = model.fit(train)
        else:
            self.model = Outside(model).fit(train.select(ROW, "features", *(["_y"] if self.labelled else [])), most, self.seed)
        return self

    def __getattr__(self, name):
        """train_LR(), train_DT() and so on."""
        if name.startswith("train_") and name[6:] in SUPERVISED + UNSUPERVISED:
            return lambda **options: self.train(name[6:], **options)
        raise AttributeError(name)

    # --- prediction

    def predict(self) -> DataFrame:
        if self.model is None:
            raise ValueError("Train a model first")
        if self.name in ("RarityModel", "OOVDetector"):
            return self.test_df.join(self.model.predict(self.test_df, self.items), ROW)
        if isinstance(self.model, (IsolationForest, LocalOutlierFactor, OneClassSVM, Outside)):
            return self.model.transform(self.test_x).drop("features")
        out = self.model.transform(self.test_x)
        if self.name == "KMeans":
            return self._far(out)
        if self.name == "LSVM":
            score = 1 / (1 + F.exp(-(self.platt[0] * _margin() + self.platt[1])))
        elif "probability" in out.columns:
            score = F.get(vector_to_array("probability"), F.lit(1))
        else:
            score = F.col("prediction").cast("double")
        return out.withColumns({"score": score, "pred_ano": F.col("prediction").cast("int")}).drop("features", "rawPrediction", "probability", "prediction")

    def _far(self, out: DataFrame) -> DataFrame:
        """Distance to the nearest centre; more than three deviations over the mean is an anomaly."""
        centres = [[float(v) for v in c] for c in self.model.clusterCenters()]
        d = F.least(*(F.sqrt(F.aggregate(F.zip_with("_x", F.array(*map(F.lit, c)), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)) for c in centres), F.lit(math.inf))
        out = out.withColumn("_x", vector_to_array("features")).withColumn("score", d).drop("_x", "features", "prediction")
        limit = out.agg((F.avg("score") + 3 * F.coalesce(F.stddev("score"), F.lit(0.0))).alias("limit"))
        return out.crossJoin(F.broadcast(limit)).withColumn("pred_ano", (F.col("score") > F.col("limit")).cast("int")).drop("limit")

    # --- evaluation

    def evaluate(self, run: int = 0) -> DataFrame:
        """predict(), with its measures kept."""
        out = self.predict()
        if self.labelled:
            out = save(out, "predictions")
            measured = metrics.measures(out, self.label).crossJoin(metrics.auc_roc(out, self.label)).first()
            self.stored.append((run, self.name, self.name in SUPERVISED, self.signature, measured["accuracy"], measured["f1"], measured["auc"], measured["tp"], measured["fp"], measured["fn"], measured["tn"]))
        return out

    def evaluate_all_ads(self, disabled_methods: tuple[str, ...] = ()) -> DataFrame:
        return self.evaluate_with_params({n: {} for n in SUPERVISED + UNSUPERVISED if n not in disabled_methods})

    def evaluate_with_params(self, models: dict[str, dict]) -> DataFrame:
        for name, options in models.items():
            if (name not in SUPERVISED or self.labelled) and (self.items is not None or name not in ("RarityModel", "OOVDetector")):
                self.train(name, **options).evaluate()
        return self.results()

    def results(self) -> DataFrame:
        return self.train_df.sparkSession.createDataFrame(self.stored, RESULTS)

    def average_scores(self, score_type: str = "accuracy", metric: str = "mean") -> DataFrame:
        return metrics.average_scores(self.results(), score_type, metric)

    def importances(self, top: int = 10) -> DataFrame:
        """(feature, importance) of the largest absolute weights of LR, LSVM, DT, RF or XGB."""
        if self.name in ("LR", "LSVM"):
            weights = (self.model.coefficients if self.name == "LSVM" else self.model.coefficientMatrix).toArray().ravel()
        elif self.name in ("DT", "RF", "XGB"):
            weights = self.model.featureImportances.toArray()
        else:
            raise NotImplementedError(f"{self.name} has no feature importances")
        names = self.used.names(len(weights))
        rows = sorted(((n, float(w)) for n, w in zip(names, weights, strict=True)), key=lambda r: (-abs(r[1]), r[0]))[:top]
        return self.train_df.sparkSession.createDataFrame(rows, T.StructType().add("feature", "string").add("importance", "double"))
