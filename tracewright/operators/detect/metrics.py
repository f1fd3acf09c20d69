"""Measures of predictions, from counts.

Scores are counted per distinct value first. The running counts that AUC and the best F1
need go over those values, in ranges (see operators.windows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...scratch import save
from ..windows import running_sums


def confusion_matrix(df: DataFrame, label: str = "anomaly", predicted: str = "pred_ano") -> DataFrame:
    """One row: tp, fp, fn, tn; rows with a null in either don't count."""
    y, p = F.col(label).cast("boolean"), F.col(predicted).cast("boolean")
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def measures(df: DataFrame, label: str = "anomaly", predicted: str = "pred_ano") -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1, from one aggregation; a share of nothing is 0."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return confusion_matrix(df, label, predicted).select("*", share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def f1_accuracy(df: DataFrame, label: str = "anomaly", predicted: str = "pred_ano") -> DataFrame:
    """One row: accuracy, precision, recall, f1."""
    return measures(df, label, predicted).drop("tp", "fp", "fn", "tn")


def _by_score(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp): counts at a score, and at it or above."""
    y = F.col(label).cast("boolean")
    counts = df.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    down = [-F.col("score")]
    return running_sums(save(counts, "scores"), {"tp": F.col("pos"), "fp": F.col("neg")}, down)


def auc_roc(df: DataFrame, label: str = "anomaly", score: str = "score") -> DataFrame:
    """One row: the exact area under the ROC curve, ties counting half; null without both labels."""
    by = _by_score(df, label, score)
    # each negative at a score is below the positives above it, and half of those at it
    won = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") + 0.5 * F.col("pos")))
    total = F.sum("pos") * F.sum("neg")
    return by.agg(F.when(total > 0, won / total).alias("auc"))


def best_f1(df: DataFrame, label: str = "anomaly", score: str = "score") -> DataFrame:
    """One row: the threshold (a row is an anomaly at it or above) with the largest F1, the highest of equal ones."""
    by = _by_score(df, label, score)
    positives = by.agg(F.sum("pos").alias("positives"))
    f1 = by.crossJoin(F.broadcast(positives)).select("score", (2 * F.col("tp") / (F.col("tp") + F.col("fp") + F.col("positives"))).alias("f1"))
    best = F.max(F.struct("f1", "score")).alias("best")
    return f1.agg(best).select(F.col("best.score").alias("threshold"), F.col("best.f1").alias("f1"))


def roc_points(df: DataFrame, label: str = "anomaly", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score."""
    by = _by_score(df, label, score)
    totals = by.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return by.crossJoin(F.broadcast(totals)).select(F.col("score").alias("threshold"), share("fp", "n").alias("fpr"), share("tp", "p").alias("tpr"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, n): equal bins between the least and the largest value."""
    ends = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    x = F.col(column).cast("double")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width > 0, F.least(F.floor((x - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    return df.where(x.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "lo", "hi").agg(F.count("*").alias("n")).select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "n")


def average_scores(results: DataFrame, score: str = "accuracy", metric: str = "mean") -> DataFrame:
    """Results (model, signature, score) as a matrix: a row per model with a column per signature.

    Missing cells are 0. A row ``Column Average`` and a column ``Row Average`` follow; all
    numbers are rounded to three decimals.
    """
    functions = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "count": F.count}
    names = sorted(r[0] for r in results.select("signature").distinct().collect())
    table = results.groupBy("model").pivot("signature", names).agg(functions[metric](score)).na.fill(0)
    row = lambda cols: sum((F.col(f"`{c}`") for c in cols), F.lit(0.0)) / max(1, len(cols))
    table = table.withColumn("Row Average", row(names))
    last = table.agg(F.lit("Column Average").alias("model"), *(F.avg(f"`{c}`").alias(c) for c in [*names, "Row Average"]))
    rounded = [F.format_string("%.3f", F.col(f"`{c}`").cast("double")).alias(c) for c in [*names, "Row Average"]]
    return table.unionByName(last).select("model", *rounded)


def rank_of(df: DataFrame, score: str, out: str = "rank") -> DataFrame:
    """Rows ranked within their run by descending score."""
    return df.withColumn(out, F.rank().over(Window.partitionBy("run").orderBy(F.desc(score))))
