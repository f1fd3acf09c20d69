import random

import duckdb
import pytest
from tracewright.llm import lines


def brute(docs, run=2, long=8):
    """{(doc_id, text): text without later runs}; docs in order of (doc_id, text's hash)."""
    seen, out = set(), {}
    for k, text in docs:
        if text is None:
            out[k, text] = None
            continue
        all_ = text.split("\n")
        solid = [(n, x.strip(" \t\r\x0b\x0c")) for n, x in enumerate(all_) if x.strip(" \t\r\x0b\x0c")]
        own = [(part[0][0], part[-1][0], tuple(x for _, x in part)) for part in (solid[k : k + run] for k in range(len(solid) - run + 1))]
        own += [(n, n, (a,)) for n, a in solid if len(a.split()) >= long]
        gone = set()
        for n, m, key in sorted(own):
            if key in seen:
                gone.update(range(n, m + 1))
            seen.add(key)
        out[k, text] = "\n".join(x for n, x in enumerate(all_) if n not in gone) if gone else text
    return out


def made(seed):
    rng = random.Random(seed)
    stock = [" ".join(rng.choices("abcdef", k=rng.choice([1, 2, 3, 8, 12]))) for _ in range(12)] + ["", "  ", "é\r", "\tx"]
    return [(k, "\n".join(rng.choices(stock, k=rng.randrange(8)))) for k in range(60)]


def test_is_brute_force(spark):
    docs = [(-3, None), (-2, ""), (-1, "\n\n")] + made(1)
    frame = spark.createDataFrame([(t, k, "x") for k, t in docs + docs[-5:]], "text string, doc_id long, _gone string").repartition(4)
    want, out = brute(docs), lines.dedup_lines(frame)
    assert out.columns == frame.columns
    got = out.collect()
    assert len(got) == len(docs) + 5
    for r in got:
        assert r.text == want[r.doc_id, dict(docs)[r.doc_id]]
    assert sum(r.text != dict(docs)[r.doc_id] for r in got) > 20


@pytest.mark.parametrize("run", [2, 3, 5])
def test_runs_of_any_length(spark, run):
    rng = random.Random(run)
    stock = ["a", "b", "c d", "e f g"]
    docs = [(k, "\n".join(rng.choices(stock, k=rng.randrange(14)))) for k in range(80)] + [(90, "\n".join(["a"] * 9)), (91, "x\n" + "\n".join(["a"] * 7))]
    want = brute(docs, run)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), run=run).collect()}
    assert got == {k: want[k, t] for k, t in docs}
    assert any(got[k] != t for k, t in docs)


@pytest.mark.parametrize("run", [2, 3, 5])
def test_selects_minima_only(run):
    rng = random.Random(run)
    text = "\n".join(f"line {rng.random()}" for _ in range(3000))
    found = lines.selected(text, run)
    assert abs(len(found) / 3000 - 2 / (run + 1)) < 0.04  # the density of winnowing
    spans = sorted((first, last) for _, own in found for _, first, last in own)
    assert spans == [(k, k + run - 1) for k in range(3000 - run + 1)]  # each window chose one
    part = "\n".join(text.split("\n")[1000 : 1000 + run])
    assert {fp for fp, _ in lines.selected(part, run)} < {fp for fp, _ in found}


def test_same_id_other_text(spark):
    long = "one two three four five six seven eight"
    docs = [(1, long), (1, long), (1, long + "\nmore"), (None, long)]
    got = sorted((r.doc_id or -1, r.text) for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert sum(long in t for _, t in got) in (1, 2) and len(got) == 4
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_is_its_sql(spark, tmp_path):
    docs = [*made(2), (100, "tail"), (101, "")]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({lines.OP2_SQL})").fetchall())
    assert sorted(map(tuple, lines.op2_line_dedup(spark, str(tmp_path)).collect())) == want


def test_very_long_texts(spark):
    rng = random.Random(8)
    lines_ = [f"line {rng.randrange(150_000)} of {rng.randrange(3)}" for _ in range(150_000)]
    docs = [(1, "\n".join(lines_)), (2, "\n".join(["new", *lines_[70_000:70_005], "end"])), (3, "one line " * 300_000)]
    assert len(docs[0][1]) > 2_000_000
    want = brute(docs)
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {k: want[k, t] for k, t in docs} and got[2] == "new\nend"
