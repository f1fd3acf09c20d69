"""Language ID: multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased and each run of ASCII characters that are no letters counts as one
space. All n-grams of 1 to 3 code points of the whole text are hashed to BUCKETS
features with weight log(1 + count) times the smoothed inverse document frequency, at
length 1. Document frequencies are counted over every document that may be learned from.

The weights are fitted by follow-the-regularised-leader with an L1 and an L2 penalty on
a bounded sample: at most about PER_LANGUAGE documents of each language, chosen by the
hash of doc_id. Every fifth of them is kept out and gives the temperature by which all
scores are divided, at the least log loss.

A null text or one without a letter is ``und`` with score 0; so is every text where
there is nothing to learn from. Null languages are not learned. Repeated rows are alike;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import received, ship, take_batches

BUCKETS, PER_LANGUAGE, EPOCHS = 1 << 15, 400, 6
#: Step size, its offset, L1 and L2 of the regularised leader.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_SPACE = np.array([not chr(c).isalpha() for c in range(128)])


def grams(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(feature, count) of a text's n-grams, by feature."""
    total, shift = np.zeros(buckets, np.int64), np.uint64(64 - (buckets.bit_length() - 1))
    text, before = text.lower(), np.empty(0, np.uint64)
    for at in range(0, len(text), 1 << 20):  # by parts, each with the last two code points kept before it
        code = np.frombuffer(text[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        space = np.where(code < 128, _SPACE[np.minimum(code, 127)], False)
        keep = ~(space & np.append(len(before) > 0 and before[-1] == 32, space[:-1]))
        code = np.append(before, np.where(space, 32, code)[keep].astype(np.uint64))
        value = np.zeros(len(code), np.uint64)
        for n in range(3):  # those that end in this part
            value = value[: len(code) - n] * np.uint64(0x110000) + code[n:] + np.uint64(1)
            own = value[max(0, len(before) - n) :]
            total += np.bincount(((own * np.uint64(_ODD[n])) >> shift).astype(np.int64), minlength=buckets)
        before = code[-2:]
    found = np.flatnonzero(total)
    return found, total[found]


def _count(batches):
    """Document frequencies (language null) and, of sampled documents, their n-grams."""
    df, n = np.zeros(BUCKETS, np.int64), 0
    for batch in take_batches(batches):
        for text, lang, taken, turn in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "taken", "turn")), strict=True):
            found, counts = grams(text)
            df[found] += 1
            n += 1
            if taken:
                yield pa.RecordBatch.from_pylist([{"lang": lang, "turn": turn, "feature": found.astype(np.int32).tobytes(), "counts": counts.astype(np.int32).tobytes(), "bucket": None, "df": None}], _COUNTED)
    at = np.flatnonzero(df)
    none = lambda t: pa.nulls(len(at) + 1, t)
    yield pa.RecordBatch.from_arrays([none(pa.string()), none(pa.int64()), none(pa.binary()), none(pa.binary()), pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], schema=_COUNTED)


_COUNTED = pa.schema([("lang", pa.string()), ("turn", pa.int64()), ("feature", pa.binary()), ("counts", pa.binary()), ("bucket", pa.int64()), ("df", pa.int64())])


class Model:
    """Languages, inverse document frequencies, weights and temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray):
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros((len(idf), len(languages)), np.float32)

    def vector(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf[found]
        return x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(found, counts) @ self.weights[found]

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], kept_out: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> None:
        """rows: (index of the language, features, counts)."""
        z, n = np.zeros(self.weights.shape), np.zeros(self.weights.shape)

        def leader(at):
            part = z[at]
            return np.where(np.abs(part) > L1, (np.sign(part) * L1 - part) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0)

        for _ in range(epochs):
            for y, found, counts in rows:
                x, w = self.vector(found, counts), leader(found)
                p = _softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                step = (np.sqrt(n[found] + g * g) - np.sqrt(n[found])) / ALPHA
                z[found] += g - step * w
                n[found] += g * g
        self.weights = leader(slice(None)).astype(np.float32)
        scores = [(y, self.logits(f, c)) for y, f, c in kept_out] or [(y, self.logits(f, c)) for y, f, c in rows]
        loss = lambda t: -sum(float(np.log(max(_softmax(s / t)[y], 1e-300))) for y, s in scores)
        self.temperature = min((float(t) for t in np.geomspace(0.05, 20, 61)), key=loss)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        p = _softmax(self.logits(*grams(text, len(self.idf))) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model:
    """A model of docs (doc_id, text, lang), all of which may be learned from."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    parts = 1 << 30
    limit = F.create_map(*(F.lit(v) for lang in languages for v in (lang, min(parts, int(parts * per_language / sizes[lang]))))) if languages else None
    if not languages:
        return Model([], np.zeros(BUCKETS))
    turn = F.pmod("h", F.lit(parts))
    rows = docs.select("text", "lang", (turn < limit[F.col("lang")]).alias("taken"), F.shiftright("h", 32).alias("turn")).mapInArrow(_count, "lang string, turn long, feature binary, counts binary, bucket long, df long")
    out = rows.groupBy("lang", "turn", "feature", "counts", "bucket").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(BUCKETS), 0
    sample = []
    for r in out:
        if r["bucket"] is None:
            sample.append((r["turn"], languages.index(r["lang"]), np.frombuffer(r["feature"], np.int32), np.frombuffer(r["counts"], np.int32)))
        elif r["bucket"] < 0:
            n = r["df"]
        else:
            df[r["bucket"]] = r["df"]
    sample.sort(key=lambda s: (s[0], s[1], len(s[2]), s[2].tobytes(), s[3].tobytes()))
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1)
    model.fit([s[1:] for k, s in enumerate(sample) if k % 5 or len(sample) < 10], [s[1:] for k, s in enumerate(sample) if not k % 5 and len(sample) >= 10], epochs)
    return model


def _predict(shared, names):
    def run(batches):
        model = received(shared)
        for batch in take_batches(batches, column="_text"):
            found = [model.predict(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*names, "_lang", "_score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs as columns _0, _1, ... in their order, but the text as _text, and _lang and _score."""
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_{k}" if c != "text" else "_text") for k, c in enumerate(docs.columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", _lang string, _score double"
    # as large as languages x BUCKETS numbers, whatever the input
    return kept.mapInArrow(_predict(ship(docs.sparkSession, model), kept.columns), schema)


def fold(parts: int):
    """crc32 of doc_id as text, modulo parts; a null doc_id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its language; learned from folds 0, 1 and 3 of 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(fold(4) != 2))
    found = predict(docs.select("doc_id", "text", (fold(4) == 2).alias("held_out")), model)
    return found.select(F.col("_0").alias("doc_id"), F.col("_2").alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))
