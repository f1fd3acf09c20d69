import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tracewright.llm import language, quality

STOCK = {"en": "the of and ing tion house water", "de": "der die und schlüssel über straße ich", "fr": "le la être où garçon élève dans"}


def text(rng, lang, n=40):
    return " ".join(rng.choice(STOCK[lang].split()) + rng.choice(["", "s", "er"]) for _ in range(n))


def test_language_on_held_out_rows(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, text(rng, lang := rng.choice(list(STOCK))), lang, 9, "x") for k in range(300)]
    odd = [(900, None, "en", 9, "x"), (901, "", "en", 9, "x"), (902, "12 !? \n", "de", 9, "x"), (903, text(rng, "fr"), None, 9, "x"), (903, text(rng, "fr"), None, 9, "x"), (904, "été " * 300_000, "fr", 9, "x"), (905, "ü", "de", 9, "x")]
    spark.createDataFrame([(t, k, lang, n, x) for k, t, lang, n, x in rows + odd], "text string, doc_id long, lang string, score int, _lang string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op10_language_id(spark, str(tmp_path)).collect()
    again = language.op10_language_id(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again)) and len(out) == len(rows + odd)
    lang = {k: x for k, _, x, *_ in rows}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.lang_pred == lang.get(r.doc_id, {900: "und", 901: "und", 902: "und", 903: "fr", 904: "fr", 905: r.lang_pred}.get(r.doc_id))
    assert sum(r.held_out for r in out) > 40


def naive_grams(text, buckets):
    """n-grams counted one by one; a run of ASCII characters that are no letters is one space."""
    plain = re.sub("[\x00-\x40\x5b-\x60\x7b-\x7f]+", " ", text.lower())
    out, shift, wrap = Counter(), 64 - (buckets.bit_length() - 1), (1 << 64) - 1
    for n in (1, 2, 3):
        for at in range(len(plain) - n + 1):
            value = 0
            for c in plain[at : at + n]:
                value = (value * 0x110000 + ord(c) + 1) & wrap
            out[((value * language._ODD[n - 1]) & wrap) >> shift] += 1
    return out


@pytest.mark.parametrize("text", ["", "a", "Ab é1", "  ..  x", "1 2\n\n3", "ÀÉ漢🙂 straße, ñ--o I\u0307"])
def test_grams_are_counted(text):
    found, counts = language.grams(text)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == naive_grams(text, language.BUCKETS)


def test_grams_in_parts_are_grams():
    part = "Ab é1, " + "xyz ñ " * 3
    text = part * (3 * (1 << 20) // len(part)) + "." * 1_100_000 + "ü" + " " * 1_050_000 + "end"
    found, counts = language.grams(text)
    assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == naive_grams(text, language.BUCKETS)


def test_weights_are_those_of_the_regularised_leader():
    rng = random.Random(6)
    rows = [(rng.randrange(3), np.array(sorted(rng.sample(range(16), 5))), np.array([rng.randrange(1, 4) for _ in range(5)])) for _ in range(60)]
    model = language.Model(["a", "b", "c"], np.linspace(1, 2, 16))
    model.fit(rows, rows[:20], 2)
    z, n = defaultdict(float), defaultdict(float)

    def weight(k):
        if abs(z[k]) <= language.L1:
            return 0.0
        return -(z[k] - math.copysign(language.L1, z[k])) / ((language.BETA + math.sqrt(n[k])) / language.ALPHA + language.L2)

    for _ in range(2):
        for y, found, counts in rows:
            x = [math.log1p(c) * (1 + f / 15) for f, c in zip(found.tolist(), counts.tolist(), strict=True)]
            x = [v / math.sqrt(sum(u * u for u in x)) for v in x]
            w = {(f, c): weight((f, c)) for f in found.tolist() for c in range(3)}
            e = [math.exp(sum(v * w[f, c] for f, v in zip(found.tolist(), x, strict=True))) for c in range(3)]
            for f, v in zip(found.tolist(), x, strict=True):
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == y))
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / language.ALPHA * w[f, c]
                    n[f, c] += g * g
    assert np.allclose(model.weights, [[weight((f, c)) for c in range(3)] for f in range(16)], atol=1e-5)
    loss = lambda t: -sum(math.log(max(language._softmax(model.logits(f, c) / t)[y], 1e-300)) for y, f, c in rows[:20])
    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.05, 20, 61))) + 1e-9


def test_query_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert language.op10_language_id(spark, str(tmp_path)).count() == 0
    assert quality.op5_quality_classifier(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [r.score for r in quality.op5_quality_classifier(spark, str(tmp_path)).collect()] == [0.5, 0.5]


def test_language_without_rows(spark):
    schema = "doc_id long, text string, lang string"
    assert language.train(spark.createDataFrame([], schema)).languages == []
    docs = spark.createDataFrame([(1, "abc", None)], schema)
    assert [(r["_lang"], r["_score"]) for r in language.predict(docs, language.train(docs)).collect()] == [("und", 0.0)]


def test_quality_on_held_out_rows(spark, tmp_path):
    rng = random.Random(8)
    junk = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", " | "), lambda t: t.replace(" ", "%%% "), lambda t: " ".join(w for w in t.split()[:8] for _ in range(12))]
    rows, labels = [], []
    for k in range(500):
        good = rng.random() < 0.7
        t = text(rng, rng.choice(list(STOCK)), rng.randrange(10, 200)) + "."
        rows.append((k, t if good else rng.choice(junk)(t)))
        if k % 3:
            labels.append((k, int(good), 0))
    rows += [(700, None), (701, ""), (702, "a " * 700_000), (1, rows[1][1])]
    labels += [(2, None, 1), (9999, 1, 0)]
    spark.createDataFrame([(t, k, "y") for k, t in rows], "text string, doc_id long, x string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = quality.op5_quality_classifier(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    truth = {k: y for k, y, _ in labels if y is not None}
    right = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(right) > 40 and np.mean(right) > 0.97
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(2)
    d = len(quality.STATISTICS)
    x = [rng.normal(k, 1 + k, (80, d)) for k in (0, 1)]
    one = [np.column_stack([np.ones(80), v]) for v in x]
    model = quality.Discriminant(np.stack([v.T @ v for v in one]))
    pooled = sum((v - v.mean(0)).T @ (v - v.mean(0)) for v in x) / 160
    logs = []
    for v in x:
        cov = 0.8 * np.cov(v.T, bias=True) + 0.2 * pooled
        cov = 0.98 * cov + 0.02 * np.trace(pooled) / d * np.eye(d)
        gap = x[1][:5] - v.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap) - 0.5 * np.linalg.slogdet(cov)[1])
    assert np.allclose(model.scores(x[1][:5]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700))))
    assert (quality.Discriminant(np.zeros((2, d + 1, d + 1))).scores(x[0][:2]) == 0.5).all()


def naive_statistics(text):
    """The 17 statistics, from the whole text at once."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    w, c, n = max(len(words), 1), max(len(text), 1), max(len(lines), 1)
    upper, lower = (len(re.findall(r, text)) for r in ("[A-Z]", "[a-z]"))
    share = lambda x, of: math.log(x / of + 0.01)
    odd, beyond = "#$%&*@^~<>{}[]=+_\\/`", [b for b in text.encode(errors="replace") if b >= 192]
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / w), share(upper, max(upper + lower, 1)), share(text.count("!"), w),
        share(sum(x in odd for x in text), c), share(text.count("|"), w), share(sum(x in "0123456789" for x in text), c),
        math.log(1 + len(set(words))) - math.log(1 + len(words)), share(sum(a == b for a, b in zip(words, words[1:])), w),
        share(max(Counter(words).values(), default=0), w), share(len(lines) - len(set(lines)), n), math.log1p(len(words) / n),
        share(text.count("."), w), share(text.count(","), w), share(len(beyond), c),
        share(sum(any(x in odd for x in v) for v in words), w), share(sum(not any(x.isalpha() for x in v) for v in words), w),
    ]


def test_statistics_are_counted():
    rng = random.Random(5)
    texts = ["", " ", "A", "a b\na b\n\n c | c! #x 12 É.", "漢字 漢字\x1c\x85z"] + ["".join(rng.choice("aB é.,|!#\n 1") for _ in range(rng.randrange(200))) for _ in range(200)]
    texts.append("one two, three four.\n" * 60_000 + "x" * 1_200_000 + " y" * 900_000)  # beyond one part
    for text in texts:
        assert np.allclose(quality.statistics(text), naive_statistics(text)), text[:50]
    assert np.allclose(quality.statistics(None), naive_statistics(""))


def test_sums_of_classes(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, len(quality.STATISTICS))), rng.integers(0, 2, 50)
    measured = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "doc_id long, x array<double>").repartition(3)
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)] + [(3, None), (99, 1)], "doc_id long, label int")
    one = np.column_stack([np.ones(50), x])
    want = quality.Discriminant(np.stack([one[y == k].T @ one[y == k] for k in (0, 1)]))
    assert np.allclose(quality.fit(measured, labels).scores(x), want.scores(x))
