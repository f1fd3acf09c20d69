import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
from tracewright.llm import decontaminate as d


def brute(text, items):
    """Words, hit words and items of a text, by trying every place."""
    own = d.words(text)
    hit, found = set(), set()
    for item, phrase_text in items:
        phrase = d.words(phrase_text)
        n = min(10, len(phrase))
        for at in range(max(0, len(phrase) - n + 1) if n else 0):
            for k in range(len(own) - n + 1):
                if own[k : k + n] == phrase[at : at + n]:
                    hit.update(range(k, k + n))
                    found.add(str(item))
    return len(own), len(hit), ",".join(sorted(found))


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "Über", "naïve", "x1", "b", "c", "漢字", "d-e", "É"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 9, 10, 11, 25])))) for k in range(12)] + [(5, "again the of b"), (99, None), (100, "rare word nowhere")]
    docs = [(0, None), (1, ""), (2, "!! --"), (3, "\n".join(t or "" for _, t in items))]
    for k in range(4, 40):
        parts = [rng.choice([rng.choice(items)[1] or "", " ".join(rng.choices([*vocabulary, "other", "Words"], k=8))]) for _ in range(rng.randrange(6))]
        docs.append((k, rng.choice([" ", "\n", ", "]).join(parts)))
    return items, docs + docs[-3:]


def test_suffix_search():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = d.FMIndex(text, 5)
    phrases = rng.integers(1, 5, (40, 3))
    got = sorted(zip(*(x.tolist() for x in index.search(phrases)), strict=True))
    assert got == [(w, k) for w in range(40) for k in range(len(text) - 2) if (text[k : k + 3] == phrases[w]).all()]


def test_scan_is_brute_force(spark):
    for seed in range(3):
        items, docs = case(seed)
        frame = spark.createDataFrame([(t, k, 1, "a") for k, t in docs], "text string, doc_id long, n_hit int, _n string").repartition(3)
        bench = spark.createDataFrame(items, "item_id long, text string")
        for block in (d.BLOCK_WORDS, 20):
            found = d.scan(frame, bench, block_words=block).collect()
            got = sorted((r["_1"], r["_n"], sum(s.last - s.first for s in r["_spans"]), ",".join(sorted(r["_items"]))) for r in found)
            assert got == sorted((k, *brute(t, items)) for k, t in docs)
        cleaned = d.decontaminate(frame, bench)
        assert cleaned.columns == frame.columns and cleaned.count() == len(docs)
        spans = {r["_1"]: r["_spans"] for r in found}
        for r in cleaned.collect():
            text, at, want = dict(docs)[r.doc_id], 0, ""
            for s in spans[r.doc_id]:
                want, at = want + text[at : s.start], s.end
            assert r.text == (None if text is None else want + text[at:])


def test_query_and_empty_tables(spark, tmp_path):
    items, docs = case(7)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for r in d.op3_benchmark_decontamination(spark, str(tmp_path)).collect():
        n, hit, ids = brute(dict(docs)[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hit, len([*filter(None, ids.split(","))]), hashlib.sha256(ids.encode()).hexdigest(), hit > 0)
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.scan(none, bench).count() == 0
    assert [r["_n"] for r in d.scan(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).collect()] == [2]


def test_long_text():
    phrases = d.Phrases([("7", [f"w{k}" for k in range(10)])], 10)
    text = "pad " * 700_000 + " ".join(f"W{k}" for k in range(10)) + " end"
    ((n, spans, items),) = d.scan_shard(pa.array([text]), phrases)
    assert n == 700_011 and spans == [[700_000, 700_010, 2_800_000, 2_800_029]] and items == ["7"]


def test_item_without_id(spark, tmp_path):
    items = [(None, "an item that has no id but words that stand in a text here"), (4, "a b c")]
    docs = [(1, "x " + items[0][1] + " a b c"), (2, "a b"), (3, None)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, d.op3_benchmark_decontamination(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(d.OP3_SQL).fetchall()) and got[0][:4] == (1, 18, 17, 1)
