import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from tracewright.llm import passages as p


def parts(text):
    """Lines and pieces of a text: [(kind, ord, words, start, end)], cut by the module's own choice of sentence ends."""
    out = []
    parsed = p.Parsed(pa.array([text], pa.string()))
    data = (text or "").encode()
    for kind, spans in ((0, parsed.lines), (1, parsed.pieces)):
        for k, (a, b) in enumerate(zip(*(x.tolist() for x in spans), strict=True)):
            words = tuple(data[s:e].decode() for s, e in zip(parsed.starts[a:b].tolist(), parsed.ends[a:b].tolist(), strict=True))
            start, end = len(data[: parsed.starts[a]].decode()), len(data[: parsed.ends[b - 1]].decode())
            out.append((kind, k, tuple("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words), start, end))
    return out


def brute(docs):
    """{(doc_id, text): spans} by comparing everything."""
    docs = sorted(dict.fromkeys(docs), key=lambda d: d[0])
    units = [(k, o, d, t, kind, words, s, e) for d, (k, t) in enumerate(docs) for kind, o, words, s, e in parts(t)]
    lines = [u for u in units if u[4] == 0 and len(u[5]) >= p.MIN_WORDS]
    sets = [frozenset(u[5][i : i + 5] for i in range(max(1, len(u[5]) - 4))) for u in lines]
    root = list(range(len(lines)))
    for _ in lines:
        for i in range(len(lines)):
            for j in range(i):
                if root[i] != root[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                    root[i] = root[j] = min(root[i], root[j])
    gone = {d: [] for d in range(len(docs))}
    for u, r in zip(lines, root, strict=True):
        if lines[r] is not u:
            gone[u[2]].append((u[6], u[7]))
    first = {}
    for u in units:
        if u[4] == 1 and len(u[5]) >= p.LEAST_PIECE:
            first.setdefault(u[5], (u[2], u[1]))
    for d in gone:
        run = []
        for u in [*(u for u in units if u[4] == 1 and u[2] == d), None]:
            again = u is not None and len(u[5]) >= p.LEAST_PIECE and first[u[5]] != (d, u[1])
            if again:
                run.append(u)
            elif run:
                if sum(len(x[5]) for x in run) >= p.MIN_WORDS:
                    gone[d].append((run[0][6], run[-1][7]))
                run = []
    out = {}
    for d, spans in gone.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
            else:
                merged.append((s, e))
        out[docs[d]] = merged
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.choice([1, 3, 5])))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(4, 12))).capitalize() + rng.choice(".!?")
    paragraph = lambda n: " ".join(sentence() for _ in range(n))
    stock = [paragraph(rng.randrange(3, 12)) for _ in range(10)]
    passage = paragraph(9)
    docs = []
    for k in range(50):
        own = []
        for _ in range(rng.randrange(1, 5)):
            x = rng.choice(stock) if rng.random() < 0.6 else paragraph(rng.randrange(1, 8))
            if rng.random() < 0.4:
                w = x.split(" ")
                w[rng.randrange(len(w))] = "edited"
                x = " ".join(w)
            if rng.random() < 0.2:
                x = paragraph(2) + " " + passage + " " + paragraph(2)
            own.append(x)
        docs.append((k, rng.choice(["\n", "\n\n", "\r\n"]).join(own)))
    return docs, passage


@pytest.mark.parametrize("block", [3, p.BLOCK])
def test_is_brute_force(spark, block):
    docs = [(-3, None), (-2, ""), (-1, " \n\t")] + made(2)[0]
    frame = spark.createDataFrame([(t, k, "x") for k, t in docs + docs[-4:]], "text string, doc_id long, spans string").repartition(3)
    want = brute(docs)
    found = p.repeats(frame, block).collect()
    assert sorted(r.doc_id for r in found) == sorted(k for k, _ in docs + docs[-4:])
    for r in found:
        assert [(s.start, s.end) for s in r.spans] == want[r.doc_id, dict(docs)[r.doc_id]]
        assert bool(r.keepers) == bool(r.spans)
    assert sum(bool(r.spans) for r in found) > 20


def test_removal(spark):
    docs, passage = made(5)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    left = {r.doc_id: r.text for r in p.remove_repeats(frame).collect()}
    want = brute(docs)
    for k, text in docs:
        at, out = 0, ""
        for s, e in want[k, text]:
            out, at = out + text[at:s], e
        assert left[k] == out + text[at:]
    assert sum(passage in t for _, t in docs) > 3 and sum(passage in t for t in left.values()) == 1
    assert sum(passage[40:-40] in t for t in left.values()) == 1
    assert p.repeats(frame.limit(0)).count() == 0


def test_bands_find_what_is_near():
    assert 1 - (1 - 0.8**p.ROWS) ** p.bands() >= 0.999
    rng, found = random.Random(1), 0
    for _ in range(60):
        w = [str(rng.random()) for _ in range(100)]
        x = list(w)
        for k in rng.sample(range(100), 2):
            x[k] = "other"
        q = p.Parsed(pa.array([" ".join(w), " ".join(x)]))
        keys = q.keys(*q.lines)
        found += bool((keys[0] == keys[1]).any())
        assert p.near(frozenset(q.shingles(0, 100).tolist()), frozenset(q.shingles(100, 200).tolist()))
    assert found == 60
    assert len({tuple(k) for k in np.array(keys).T.tolist()}) == p.bands()


@pytest.mark.parametrize("repeated", [False, True])
def test_passage_without_sentence_marks_inside_other_lines(spark, repeated):
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    docs = []
    for k in range(20):
        passage = words(2) * 50 if repeated else words(100)
        docs += [(2 * k, " ".join(words(90) + passage + words(80))), (2 * k + 1, " ".join(words(70) + passage + words(95)))]
    found = {r.doc_id: r for r in p.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[2 * k + 1].spans and found[2 * k + 1].keepers == [2 * k] for k in range(20))
    assert repeated or all(not found[2 * k].spans for k in range(20))


def test_clashing_names(spark):
    long = " ".join(f"word{k}" for k in range(40))
    schema = "doc_id long, _spans string, `a.b` int, text string, _id int, _text string, th int"
    docs = spark.createDataFrame([(1, "s", 2, long, 3, "t", 4), (2, "s", 2, f"x\n{long}\ny", 3, "t", 4), (2, "s", 5, None, 3, "t", 4)], schema)
    out = p.remove_repeats(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text or "", r["a.b"]) for r in out.collect()) == [(1, long, 2), (2, "", 5), (2, "x\n\ny", 2)]


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(1 << 40)}" for _ in range(200_000)]
    passage = " ".join(words[100_000:100_070])
    docs = [(1, " ".join(words)), (2, "Here " + passage + " there"), (3, "other " * 5), (4, None)]
    assert len(docs[0][1]) > 2_000_000
    got = {r.doc_id: (r.spans, r.keepers) for r in p.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][0] == got[3][0] == got[4][0] == [] and got[2][1] == [1]
    assert sum(s.end - s.start for s in got[2][0]) > 0.6 * len(passage)


@pytest.mark.parametrize("block", [2, 5, 40])
def test_crowded_keys_lose_no_link(spark, block):
    """Templates with edits, and a chain of which only neighbours are near each other, in keys of more than block."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(40):
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 4)):
            own[k] = f"x{rng.randrange(10**9)}"
        texts.append(" ".join(own))
    for k in range(0, 90, 3):
        texts.append(" ".join([f"y{j}" for j in range(k)] + base[k:]))
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    want = brute(docs)
    found = p.repeats(spark.createDataFrame(docs, "doc_id long, text string"), block).collect()
    assert {r.doc_id: [(s.start, s.end) for s in r.spans] for r in found} == {k: want[k, t] for k, t in docs}


def test_verifying_keeps_few_shingles_as_objects():
    """A batch of 4,000 paragraphs of 100 shingles would be about 17 MB of Python numbers and lists."""
    sets = [np.random.default_rng(k).integers(-(2**62), 2**62, 100) for k in range(4000)]
    n = len(sets)
    same = pa.array(np.arange(n) // 2)  # keys of two paragraphs
    batch = pa.RecordBatch.from_arrays(
        [same, pa.array(np.arange(n)), pa.array(np.zeros(n, bool)), pa.array(np.zeros(n, np.int64)), pa.array(np.zeros(n, np.int64)), pa.array([sets[k - k % 2 * (k % 3 > 0)] for k in range(n)], pa.list_(pa.int64()))],
        ["key", "pid", "close", "a", "b", "shingles"],
    )
    tracemalloc.start()
    (out,) = p._verify([batch])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(zip(out.column("u").to_pylist(), out.column("v").to_pylist(), strict=True)) == [(k, k - 1) for k in range(1, n, 2) if k % 3]
    assert peak < 4e6


def test_a_task_has_one_python_worker(spark, monkeypatch):
    """What goes to components, which starts with a Python step, has none in its last stage."""
    plans = []

    def spied(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return components(edges)

    components = p.components
    monkeypatch.setattr(p, "components", spied)
    words = [f"w{k}" for k in range(40)]
    docs = spark.createDataFrame([(k, " ".join(["x" * (k + 1), *words])) for k in range(3)], "doc_id long, text string")
    assert sorted(len(r.spans) for r in p.repeats(docs).collect()) == [0, 1, 1]
    (plan,) = plans
    assert "MapInArrow" not in plan
