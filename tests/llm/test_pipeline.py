import random

import corpus_pipeline
from test_decontaminate import brute as leaks
from test_lines import brute as line_dedup
from test_simhash import brute_components, brute_print
from tracewright.llm import packing


def made():
    rng = random.Random(11)
    stock = {"en": "the of and ing tion house water".split(), "de": "der die und schlüssel über straße ich".split(), "fr": "le la être où garçon élève dans".split()}
    sentence = lambda lang, n: " ".join(rng.choice(stock[lang]) + rng.choice(["", "s", "er", "in"]) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n))
    rows = []
    for k in range(90):
        lang = rng.choice(list(stock))
        rows.append((k, "\n".join(sentence(lang, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 5))), lang, f"s{k % 3}", 0))
    rows += [(100 + k, rows[k][1], *rows[k][2:]) for k in range(6)]
    rows += [(110 + k, rows[k + 10][1].replace(" ", "  ", 1) + " end", *rows[k + 10][2:]) for k in range(6)]
    items = [(k, sentence("en", 15)) for k in range(4)]
    rows += [(120 + k, sentence("en", 9) + " " + items[k][1] + "\n" + sentence("en", 30), "en", "s", 0) for k in range(4)]
    rows += [(130, None, "en", "s", 0), (131, "", "en", "s", 0), (132, "123 456", None, "s", 0), (133, "12 !!", "de", None, None)]
    return rows, items


def test_stages_and_run_are_brute_force(spark, tmp_path):
    rows, items = made()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]

    kept = stages["language ID"](spark, docs, str(tmp_path))
    assert kept.schema.names == docs.schema.names
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert {k for k, *_ in rows} - {k for k, _ in texts} == {130, 131, 132, 133}

    lines = line_dedup(sorted(texts))
    texts = {k: lines[k, t] for k, t in texts}
    got = {r.doc_id: r.text for r in stages["line dedup"](spark, kept, str(tmp_path)).collect()}
    assert got == texts

    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], schema)
    part = brute_components([(k, brute_print(t)) for k, t in texts.items()])
    texts = {k: t for k, t in texts.items() if part[k] == k}
    got = {r.doc_id: r.text for r in stages["SimHash near-dedup"](spark, frame, str(tmp_path)).collect()}
    assert got == texts

    frame = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], schema)
    cleaned = {r.doc_id: r.text for r in stages["benchmark decontamination"](spark, frame, str(tmp_path)).collect()}
    hit = {k for k, t in texts.items() if leaks(t, items)[1]}
    assert hit == {120, 121, 122, 123} and {k for k in texts if cleaned[k] != texts[k]} == hit
    assert not any(leaks(t, items)[1] for t in cleaned.values())

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = packing.Tokens(*packing.default_files())
    want = {k: len(tokens(t)) // 4 + 1 for k, t in cleaned.items()}
    assert {r.doc_id: r.doc_tokens for r in out} == want and sum(r.length for r in out) == sum(want.values())


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_clashing_names(spark, tmp_path):
    rows, items = made()
    names = ["_n", "a.b", "_spans", "_text", "_id", "_th", "th", "fp", "root", "f", "_0", "doc id"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in names)
    spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.drop("doc_id", "text", "lang", "source", "n_chars").distinct().count() == 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
