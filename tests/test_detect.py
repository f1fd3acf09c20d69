import itertools
import random

import numpy as np
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from tracewright.operators.detect import metrics
from tracewright.operators.detect.detector import SUPERVISED, UNSUPERVISED, AnomalyDetector
from tracewright.operators.detect.features import Vectorizer
from tracewright.operators.detect.features import test_train_split as split
from tracewright.operators.detect.items import OOV_detector, RarityModel, items_of
from tracewright.operators.explain import NNExplainer, ShapExplainer, tree_shap
from tracewright.sources.sinks import load_model, save_model


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(0)
    rows = []
    for k in range(300):
        bad = k % 6 == 0
        words = rng.choices("a b c d e".split(), k=8) + (["error", f"x{rng.randrange(3)}"] if bad else [])
        rows.append((k, words, float(len(words)), bad))
    return spark.createDataFrame(rows, "row_id long, e_words array<string>, n double, anomaly boolean").cache()


def test_split_is_exact(spark, log):
    for frac, shuffle in itertools.product((0.0, 0.2, 0.9, 1.0), (True, False)):
        train, test = split(log, frac, shuffle)
        assert (train.count(), test.count()) == (300 - int(frac * 300), int(frac * 300))
        assert not {r.row_id for r in train.collect()} & {r.row_id for r in test.collect()}
    train, _ = split(log, 0.9, False)
    assert sorted(r.row_id for r in train.collect()) == list(range(30))


def test_every_detector_finds_the_errors(log):
    ad = AnomalyDetector("e_words")
    ad.test_train_split(log, 0.5)
    results = {r.model: r for r in ad.evaluate_all_ads(("OneClassSVM",)).collect()}
    assert set(results) == {*SUPERVISED, *UNSUPERVISED} - {"OneClassSVM"}
    for name in SUPERVISED:
        assert results[name].f1 > 0.95 and results[name].auc > 0.95, name
    for name in ("IsolationForest", "OOVDetector"):  # the others do not see words that only anomalies have
        assert results[name].auc > 0.9, name
    assert sum(results["LR"][c] for c in ("tp", "fp", "fn", "tn")) == 150
    table = {r["model"]: r for r in ad.average_scores("f1").collect()}
    assert "Column Average" in table and table["DT"]["e_words"] == table["DT"]["Row Average"]
    ad.train("OneClassSVM").predict().count()
    with pytest.raises(ValueError):
        unlabelled = AnomalyDetector("e_words")
        unlabelled.set_data(log.drop("anomaly"), log.drop("anomaly"))
        unlabelled.train("LR")


def test_rarity_sees_rare_known_words(spark):
    rng = random.Random(1)
    rows = [(k, rng.choices("abcde", k=8) + ["odd"] * (5 if k % 6 == 0 else k % 50 == 1), k % 6 == 0) for k in range(600)]
    ad = AnomalyDetector("e_words")
    ad.test_train_split(spark.createDataFrame(rows, "row_id long, e_words array<string>, anomaly boolean"), 0.5)
    ad.train("RarityModel", threshold=100).evaluate()
    r = ad.results().first()
    assert r.auc > 0.9 and r.f1 > 0.9


def test_explanations(log):
    ad = AnomalyDetector("e_words", ["n"])
    ad.test_train_split(log, 0.5)
    for name in ("LR", "LSVM", "DT", "RF", "XGB"):
        out = ad.train(name, **({"n_estimators": 5} if name in ("RF", "XGB") else {})).predict()
        assert out.count() == 150
        assert ad.importances().first()["feature"] in ("error", "n")
        top = ShapExplainer(ad).sorted_shapvalues().first()
        assert top.feature in ("error", "n") and top.total > 0
    with pytest.raises(NotImplementedError):
        ShapExplainer(ad.train("KMeans"))
    rows = ad.train("DT").test_x.join(ad.predict().select("row_id", "pred_ano"), "row_id")
    pairs = NNExplainer(rows).content("e_words").collect()
    assert pairs and all("error" in p.anomalous and "error" not in p.normal for p in pairs)
    assert NNExplainer(rows).false_positives().count() == NNExplainer(rows).false_negatives().count() == 0
    assert NNExplainer(rows).plane().count() == 150


def test_tree_values_are_shapley():
    tree = (0, 0.5, (1, 0.5, (1.0, 3.0), (5.0, 2.0), 5.0), (0, 1.5, (2.0, 4.0), (2, 0.1, (7.0, 1.0), (0.0, 6.0), 7.0), 11.0), 16.0)

    def expect(node, x, known):
        if len(node) == 2:
            return node[0]
        f, at, left, right, w = node
        if f in known:
            return expect(left if x[f] <= at else right, x, known)
        return (left[-1] * expect(left, x, known) + right[-1] * expect(right, x, known)) / w

    for x in itertools.product((0.0, 1.0, 2.0), repeat=3):
        want = np.zeros(3)
        for order in itertools.permutations(range(3)):
            known = set()
            for f in order:
                before = expect(tree, x, known)
                known.add(f)
                want[f] += (expect(tree, x, known) - before) / 6
        assert np.allclose(tree_shap([(tree, 1.0)], x), want)


def test_rarity_and_oov(spark):
    train = spark.createDataFrame([(k, ["a"] * 98 + ["b", "c"]) for k in range(1)], "row_id long, w array<string>")
    test = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["z"]), (3, None), (4, ["a"])], "row_id long, w array<string>")
    rare = -np.log(0.01) ** 3
    got = {r.row_id: r.score for r in RarityModel(common_threshold=0.01).fit(train, "w").predict(test, "w").collect()}
    assert np.allclose([got[k] for k in (1, 2, 3, 4)], [-rare, 0, 0, 0]) or np.allclose([got[k] for k in (1, 2, 3, 4)], [abs(rare), 0, 0, 0])
    got = {r.row_id: (r.score, r.pred_ano) for r in OOV_detector(threshold=0).fit(train, "w").predict(test, "w").collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (0, 0), 4: (0, 0)}
    with pytest.raises(ValueError):
        items_of(spark.range(1), "id")


def test_metrics_are_exact(spark):
    rng = random.Random(4)
    rows = [(rng.random() < 0.3, float(rng.randrange(12)), int(rng.random() < 0.4)) for _ in range(200)] + [(None, 1.0, 1), (True, None, None)]
    df = spark.createDataFrame(rows, "anomaly boolean, score double, pred_ano int").repartition(5)
    known = [(y, s) for y, s, _ in rows if y is not None and s is not None]
    pos, neg = [s for y, s in known if y], [s for y, s in known if not y]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert np.isclose(metrics.auc_roc(df).first().auc, want)
    f1 = lambda t: 2 * sum(s >= t for s in pos) / (sum(s >= t for _, s in known) + len(pos))
    best = max(((f1(t), t) for t in {s for _, s in known}))
    got = metrics.best_f1(df).first()
    assert np.isclose(got.f1, best[0]) and got.threshold == best[1]
    one = df.where("anomaly")
    assert metrics.auc_roc(one).first().auc is None
    assert metrics.f1_accuracy(df.limit(0)).first().f1 == 0.0
    assert sum(r.n for r in metrics.histogram(df, "score", 4).collect()) == 201
    vectors = df.where("score IS NOT NULL").withColumn("features", array_to_vector(F.array("score")))
    assert vectors.count() == 201


def test_any_object_is_trained(log):
    class Threshold:
        """Anomalies have more than the training rows' median sum."""

        def fit(self, x, y=None):
            self.limit = np.median(x.sum(1)) + 0.5
            return self

        def predict(self, x):
            return (x.sum(1) > self.limit).astype(int)

    ad = AnomalyDetector("e_words")
    ad.test_train_split(log, 0.5)
    for model, name in ((Threshold(), "Threshold"), (NaiveBayes(), "Bayes")):
        out = ad.train_model(model, name).evaluate()
        assert out.count() == 150 and {"score", "pred_ano"} <= set(out.columns)
    got = {r.model: r for r in ad.results().collect()}
    assert set(got) == {"Threshold", "Bayes"} and all(r.auc > 0.95 for r in got.values())


def test_tfidf_features(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"], True), (2, ["a"], False), (3, ["c"], False)], "row_id long, w array<string>, anomaly boolean")
    v = Vectorizer("w", vectorizer="tfidf").fit(df)
    got = {r.row_id: dict(zip(v.names(3), r.features.toArray(), strict=True)) for r in v.transform(df).collect()}
    one, two = np.log(4 / 3) + 1, np.log(4 / 2) + 1
    size = np.hypot(2 * one, two)
    assert np.isclose(got[1]["a"], 2 * one / size) and np.isclose(got[1]["b"], two / size) and got[2]["a"] == 1.0 and got[3]["c"] == 1.0
    own = Vectorizer("w", ["row_id"], vectorizer=lambda i, o: HashingTF(inputCol=i, outputCol=o, numFeatures=16)).fit(df)
    assert len(own.transform(df).first().features) == 17 and own.names(17)[-1] == "row_id"
    with pytest.raises(ValueError):
        Vectorizer("w", vectorizer="other")
    ad = AnomalyDetector("w", vectorizer="tfidf")
    ad.set_data(df, df)
    assert ad.train("DT").predict().count() == 3


def test_margins_are_calibrated(spark):
    rng = random.Random(3)
    rows = [(k, [x := rng.gauss(0, 1)], rng.random() < 1 / (1 + np.exp(-2 * x))) for k in range(2000)]
    df = spark.createDataFrame([(k, float(x[0]), bool(y)) for k, x, y in rows], "row_id long, x double, anomaly boolean")
    ad = AnomalyDetector(numeric_cols=["x"])
    ad.test_train_split(df, 0.5)
    out = ad.train("LSVM").predict().collect()
    for low in (0.0, 0.25, 0.5, 0.75):
        part = [r for r in out if low <= r.score < low + 0.25]
        assert abs(np.mean([r.anomaly for r in part]) - np.mean([r.score for r in part])) < 0.1


@pytest.mark.parametrize("name", ["LR", "IsolationForest", "LOF", "OneClassSVM", "RarityModel", "OOVDetector"])
def test_models_are_kept(spark, log, tmp_path, name):
    ad = AnomalyDetector("e_words", ["n"])
    ad.test_train_split(log, 0.5)
    ad.train(name)
    before = {r.row_id: (r.score, r.pred_ano) for r in ad.predict().collect()}
    save_model(ad.model, f"{tmp_path}/m")
    ad.model = load_model(spark, f"{tmp_path}/m")
    after = {r.row_id: (r.score, r.pred_ano) for r in ad.predict().collect()}
    assert after.keys() == before.keys() and all(np.isclose(after[k][0], before[k][0]) and after[k][1] == before[k][1] for k in before)
    save_model(ad.used if name not in ("RarityModel", "OOVDetector") else ad.x, f"{tmp_path}/v")
    assert load_model(spark, f"{tmp_path}/v").transform(log).count() == 300


def test_forest_is_explained(log):
    ad = AnomalyDetector("e_words", ["n"])
    ad.test_train_split(log, 0.5)
    ad.train("IsolationForest", n_estimators=10)
    rows = ad.test_x.select("row_id", "features").limit(5).collect()
    values = {r.row_id: r.shap for r in ShapExplainer(ad).values().collect()}
    model = ad.model

    def mean(tree):
        return tree[0] if len(tree) == 2 else (mean(tree[2]) * tree[2][-1] + mean(tree[3]) * tree[3][-1]) / tree[-1]

    expected = np.mean([mean(t) for t in model.trees])
    for r in rows:
        x, total = r.features.toArray()[None], np.zeros(1)
        for t in model.trees:
            model._paths(t, x, np.arange(1), total)
        assert np.isclose(expected + sum(values[r.row_id]), total[0] / 10)
    assert ShapExplainer(ad).sorted_featurenames()
