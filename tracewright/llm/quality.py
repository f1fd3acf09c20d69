"""Quality by regularised quadratic discriminant analysis of document statistics.

Each whole text gives counts and shares (STATISTICS), made less skew by logarithms. Of
the labelled rows that may be learned from, all of them, each class gets its mean and
covariance; sums and products are added up per task and then by Spark, so only one
number for each pair of statistics comes to the driver. A class covariance is drawn
towards the pooled one and that towards a multiple of the identity. With the Cholesky
factors, which are computed once, the score is the logistic of the difference of the two
classes' log densities and priors.

A null text counts as empty and is scored like any other. Rows with a null label are not
learned. If a class has no rows, the score is the share of label 1, or 0.5 without
labels. Repeated rows are alike; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .language import fold
from .shared import take_batches

TO_POOLED, TO_IDENTITY, THRESHOLD = 0.2, 0.02, 0.3
STATISTICS = (
    "words", "word length", "upper case", "exclamations", "symbols", "bars", "digits", "distinct words", "repeated neighbours",
    "commonest word", "repeated lines", "line length", "full stops", "commas", "beyond ASCII", "words with symbols", "words without letters",
)
_KIND = np.zeros(256, np.int64)
for _c in range(256):
    _KIND[_c] = 1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 else 3 if 48 <= _c <= 57 else 4 if _c >= 192 else 5 if chr(_c) in "#$%&*@^~<>{}[]=+_\\/`" else 0
_SYMBOL = re.compile(r"[#$%&*@^~<>{}\[\]=+_\\/`]")
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = re.compile(r"\s")
#: A text's words are listed by parts of so many characters, which changes no count.
PART = 1 << 20


def _words(text: str):
    """The words of a text in lists, of about PART characters each."""
    at = 0
    while len(text) - at > PART and (cut := _BLANK.search(text, at + PART)):
        yield text[at : cut.start()].split()
        at = cut.end()
    yield text[at:].split()


def _lines(text: str):
    """The lines of a text that aren't blank, one by one."""
    at = 0
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if (line := text[at:end]).strip():
            yield line
        at = end + 1


def _counts(text: str) -> list[float]:
    """Counts over a whole text; words and lines are told apart by 64-bit hashes, a few bytes for each different one."""
    hashes, numbers = [], []
    total = chars = neighbours = odd = plain = 0
    last, kinds = None, np.zeros(6, np.int64)
    for words in _words(text):
        own = Counter(words)
        hashes.append(np.fromiter(map(hash, own), np.int64, len(own)))
        numbers.append(np.fromiter(own.values(), np.int64, len(own)))
        total += len(words)
        chars += sum(map(len, words))
        odd += sum(n for w, n in own.items() if _SYMBOL.search(w))
        plain += sum(n for w, n in own.items() if not _LETTER.search(w))
        if words:
            neighbours += sum(map(str.__eq__, words, words[1:])) + (words[0] == last)
            last = words[-1]
    for at in range(0, len(text), PART):
        kinds += np.bincount(_KIND[np.frombuffer(text[at : at + PART].encode(errors="replace"), np.uint8)], minlength=6)
    _, where = np.unique(np.concatenate(hashes), return_inverse=True)
    often = np.bincount(where, np.concatenate(numbers))
    lines = np.fromiter(map(hash, _lines(text)), np.int64)
    return [
        total, chars, kinds[1], kinds[2], text.count("!"), kinds[5], text.count("|"), kinds[3],
        len(often), neighbours, often.max(initial=0), len(lines) - len(np.unique(lines)), len(lines),
        text.count("."), text.count(","), kinds[4], odd, plain, len(text),
    ]


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a whole text."""
    a = _counts(text or "")
    words, chars, lines = max(a[0], 1), max(a[18], 1), max(a[12], 1)
    share = lambda x, of: np.log(x / of + 0.01)
    return np.array([
        np.log1p(a[0]), np.log1p(a[1] / words), share(a[2], max(a[2] + a[3], 1)), share(a[4], words), share(a[5], chars), share(a[6], words), share(a[7], chars),
        np.log(1 + a[8]) - np.log(1 + a[0]), share(a[9], words), share(a[10], words), share(a[11], lines), np.log1p(a[0] / lines),
        share(a[13], words), share(a[14], words), share(a[15], chars), share(a[16], words), share(a[17], words),
    ])


def _measure(batches):
    for batch in take_batches(batches):
        x = np.array([statistics(t) for t in batch.column("text").to_pylist()], np.float64).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "held_out", "x"])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) for docs (doc_id, text, held_out)."""
    return docs.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(_measure, "doc_id long, held_out boolean, x array<double>")


def _sums(batches):
    """Per class: products of (1, x) with itself, summed."""
    total = np.zeros((2, len(STATISTICS) + 1, len(STATISTICS) + 1))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.array(batch.column("x").to_pylist())
        x = np.column_stack([np.ones(len(x)), x])
        y = np.array(batch.column("label").to_pylist())
        for k in (0, 1):
            total[k] += x[y == k].T @ x[y == k]
    k, i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel()) for a in (k, i, j, total)], ["k", "i", "j", "v"])


class Discriminant:
    """Two Gaussian classes with cached Cholesky factors."""

    def __init__(self, sums: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        """sums[k]: the sum of the outer products of (1, x) with itself over the rows of class k."""
        n, d = sums[:, 0, 0], sums.shape[1] - 1
        self.share = float(n[1] / n.sum()) if n.sum() else 0.5
        self.classes = []
        if not n.all():
            return
        means = sums[:, 0, 1:] / n[:, None]
        scatter = [sums[k, 1:, 1:] - n[k] * np.outer(means[k], means[k]) for k in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / n.sum()
        for k in (0, 1):
            own = (1 - to_pooled) * scatter[k] / n[k] + to_pooled * pooled
            own = (1 - to_identity) * own + to_identity * max(np.trace(pooled) / d, 1e-6) * np.eye(d)
            factor = np.linalg.cholesky(own)
            self.classes.append((means[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(n[k] / n.sum())))

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row."""
        if not self.classes:
            return np.full(len(x), self.share)
        low, high = (prior - half - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, half, prior in self.classes)
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def fit(measured: DataFrame, labels: DataFrame) -> Discriminant:
    """From measured (doc_id, x) and labels (doc_id, label 0 or 1)."""
    rows = measured.join(labels.where("label IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("label").cast("int")), "doc_id").select("x", "label")
    size = len(STATISTICS) + 1
    sums = np.zeros((2, size, size))
    for k, i, j, v in rows.mapInArrow(_sums, "k long, i long, j long, v double").groupBy("k", "i", "j").agg(F.sum("v")).collect():
        sums[k, i, j] = v
    return Discriminant(sums)


def _score(model: Discriminant):
    def run(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(model.scores(x))], ["doc_id", "held_out", "score"])

    return run


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the probability of quality 1; learned from folds 1 to 4 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    measured = save(measure(docs.withColumn("held_out", fold(5) == 0)), "quality")
    model = fit(measured.where("NOT held_out"), labels)
    scored = measured.mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
