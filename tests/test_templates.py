import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tracewright.operators import templates as t
from tracewright.operators.events import EventLogEnhancer
from tracewright.operators.templates.online import Drain, IndexedSpell, LenMa, LimitedDrain, Spell
from tracewright.plans import templates as plans
from tracewright.streaming import drain as stream


def lines(seed=0, n=150):
    rng = random.Random(seed)
    shapes = ["open file {} ok", "close file {} by {}", "user {} logged in from {}", "job {} failed with code {} on {}", "ping", "", "retry  {} times", "a b c {}"]
    return [(k, rng.choice(shapes).format(*(rng.choice(["x", "y", "7", "longword", "zz"]) for _ in range(3)))) for k in range(n)]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([*lines(), (1000, None)], "row_id long, e_message_normalized string").repartition(6)


def by_id(df, name):
    groups = defaultdict(list)
    for r in df.collect():
        groups[r[name]].append(r.row_id)
    return dict(groups)


def test_online_parsers_are_sequential(spark, log):
    texts = lines()

    def run(machines, split, key):
        out = {}
        for k, text in texts:
            tokens = split(text)
            m = machines.setdefault(key(tokens), [])
            m = m or machines[key(tokens)]
            if not m:
                machines[key(tokens)] = m = [machines["make"]()]
            out[k] = (key(tokens), m[0].add(tokens))
        return out, machines

    white = lambda s: s.replace("_", " ").split()
    cases = [
        (t.parse_drain(log, templates=True), "e_event_drain_id", *run({"make": Drain}, white, lambda w: (len(w), "<*>" if w and any(c.isdigit() for c in w[0]) else w[0] if len(w) > 1 else None))),
        (t.parse_lenma(log.withColumn("e_words", F.split("e_message_normalized", " "))), "e_template_lenma", *run({"make": LenMa}, lambda s: s.split(" "), lambda w: (len(w), w[0]))),
        (t.parse_spell(log), "e_template_spell", *run({"make": Spell}, lambda s: " ".join(s.split()).split(" "), lambda w: 0)),
    ]
    for df, name, want, machines in cases:
        rows = {r.row_id: r for r in df.collect()}
        assert len(rows) == len(texts) + 1
        got = {k: rows[k][name] for k, _ in texts}
        if name == "e_event_drain_id":
            assert len(set(zip(got.values(), want.values()))) == len(set(got.values())) == len(set(want.values()))
        else:
            assert got == {k: machines[key][0].template(c) for k, (key, c) in want.items()}


def test_spell_index_loses_no_template(spark):
    """Against a search through every template, with words that repeat and a literal star."""

    class Plain(Spell):
        def _candidates(self, words, least):
            return range(len(self.found))

    rng = random.Random(4)
    one, other = Spell(), Plain()
    for _ in range(600):
        words = [rng.choice(["a", "b", "c", "d", "*", "", "e1", "e2"]) for _ in range(rng.randrange(1, 9))]
        assert one.add(words) == other.add(words)
    assert one.found == other.found


def test_spell_does_not_go_through_the_holders_of_common_words():
    class Watched(dict):
        def items(self):
            raise AssertionError("all templates with a common word")

    s = Spell()
    for k in range(50):
        s.add(["the", f"a{k}", f"b{k}", f"c{k}"])
    assert len(s.found) == 50
    s.holders["the"] = Watched(s.holders["the"])
    assert s.add(["the", "a7", "x", "c7"]) == 7 and s.found[7] == ["the", "a7", "*", "c7"]


@pytest.mark.parametrize("near", [0, 3, 64])
def test_indexed_spell_is_spell(near):
    """Lines that repeat, near copies, literal stars; known lines are compared with what changed or searched for again."""
    rng = random.Random(6)
    words = ["the", "of", "*", "", *(f"w{k}" for k in range(25))]
    kinds = [[rng.choice(words) for _ in range(rng.randrange(1, 14))] for _ in range(120)]
    kinds += [[rng.choice(words) if rng.random() < 0.2 else w for w in rng.choice(kinds)] for _ in range(120)]
    one, other, known = Spell(), IndexedSpell(), {}
    other.NEAR = near
    for _ in range(1500):
        line = rng.choice(kinds)
        known[tuple(line)] = now = other.again(line, known.get(tuple(line)))
        assert now[0] == one.add(line)
    assert one.found == other.found and one.changes == other.changes
    plain, alone = Spell(), IndexedSpell()
    assert [plain.add(line) for line in kinds] == [alone.add(line) for line in kinds]


def test_spell_by_row_for_repeated_lines(spark):
    """A text that changes its cluster, rows of one number, rows without one and messages of other spacing."""
    texts = ["a b c d e f", "a b x y", "a b  x y", "p q a b x y", "b x y", "a b x y", None, " "]
    rng = random.Random(8)
    rows = [(k // 2 if k < 40 else k, rng.choice(texts)) for k in range(200)] + [(None, "a b x y")]
    df = spark.createDataFrame(rows, "row_id long, e_message_normalized string").repartition(5)
    got = t.parse_spell(df).collect()
    assert sorted(((r.row_id, r.e_message_normalized) for r in got), key=str) == sorted(rows, key=str)
    s, clusters = Spell(), {}
    for k, mark, x in sorted((-1 if k is None else k, mark_of(" ".join(x.split())), x) for k, x in rows if x is not None):
        clusters[k, mark] = s.add(" ".join(x.split()).split(" "))
    for r in got:
        if r.e_message_normalized is not None:
            assert r.e_template_spell == s.template(clusters[-1 if r.row_id is None else r.row_id, mark_of(" ".join(r.e_message_normalized.split()))])


def mark_of(text):
    return hashlib.md5(text.encode()).digest()


def test_remembered_lines_change_nothing(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice(["<*>", "x", "y", "7", "z"]) for _ in range(3))) for k in range(400)]
    got = {r.row_id: r.e_event_drain_id for r in t.parse_drain(spark.createDataFrame(rows, "row_id long, e_message_normalized string")).collect()}
    machines, first, want = {}, {}, {}
    for k, text in rows:
        tokens = text.split()
        key = "<*>" if any(c.isdigit() for c in tokens[0]) else tokens[0]
        at = (key, machines.setdefault(key, Drain()).add(tokens))
        want[k] = f"e{first.setdefault(at, len(first) + 1)}"
    assert got == want


def test_drain_with_limits(spark):
    d = LimitedDrain(0.5, max_clusters=2)
    a, b, c = "a x y".split(), "b p q".split(), "c r s".split()
    assert [d.add(w) for w in (a, b, a, c)] == [0, 1, 0, 2]  # b was used longest ago and is forgotten
    assert [d.add(w) for w in (a, b)] == [0, 3]
    d = LimitedDrain(0.5, max_children=3)
    assert [d.add(w.split()) for w in ("a 1", "b 2", "c 3", "d 3", "a 1")] == [0, 1, 2, 2, 0]
    assert set(d.branches[2]) == {"a", "b", "<*>"} and d.template(2) == "<*> 3"
    d = LimitedDrain()
    assert [d.add(w.split()) for w in ("7z same tail", "new same tail", "new other words", "new same tail", "", "", "one", "two")] == [0, 0, 1, 2, 3, 3, 4, 5]
    rows = [(k, text) for k, text in lines(7)]
    got = {r.row_id: r.e_event_drain_id for r in t.parse_drain(spark.createDataFrame(rows, "row_id long, e_message_normalized string").repartition(5), limits=(5, 3)).collect()}
    one = LimitedDrain(0.4, 5, 3)
    assert got == {k: f"e{one.add(text.split()) + 1}" for k, text in rows}


def test_drain_numbers_and_templates(spark):
    df = spark.createDataFrame([(5, "get x now"), (1, "get y now"), (3, "put"), (7, "get z now")], "row_id long, e_message_normalized string")
    rows = {r.row_id: (r.e_event_drain_id, r.e_event_drain_template) for r in t.parse_drain(df, templates=True).collect()}
    assert rows == {1: ("e1", "get y now"), 3: ("e2", "put"), 5: ("e1", "get <*> now"), 7: ("e1", "get <*> now")}


def test_spell_templates():
    s = Spell()
    for words in (["a", "b", "c", "d"], ["a", "x", "c", "d"], ["a", "b", "c", "q", "d"]):
        s.add(words)
    assert [s.template(k) for k in range(len(s.found))] == ["a * c * d"]


def test_ael_keeps_spacing_variants(spark):
    df = spark.createDataFrame(list(enumerate(["a b", "a  b", "a c", "x", "y", "p q r", ""])), "row_id long, e_message_normalized string")
    rows = {r.row_id: r.e_template_ael for r in t.parse_ael(df).collect()}
    assert rows == {0: "a <*>", 1: "a  b", 2: "a <*>", 3: "x", 4: "y", 5: "p q r", 6: ""}


def test_bijection(spark):
    texts = [f"open {f} ok" for f in "abc"] * 3 + ["conn from h1 port 1", "conn from h2 port 2", "conn from h1 port 1"] + ["one"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, e_message_normalized string")
    got = {r.row_id: r for r in t.parse_pliplom(df).collect()}
    assert all(got[k].e_template_pliplom.startswith("open") for k in range(9)) and got[12].e_template_pliplom == "one"
    assert len({r.e_event_pliplom_id for r in got.values()}) == len({(r.e_event_pliplom_id, r.e_template_pliplom) for r in got.values()})
    iplom = {r.row_id: (r.e_event_iplom_id, r.e_template_iplom) for r in t.parse_iplom(df.union(spark.createDataFrame([(99, None), (98, " ")], df.schema))).collect()}
    assert len(iplom) == len(texts) + 2 and iplom[99][0] == iplom[98][0] == "e_null" and iplom[0] == iplom[3]
    rare = by_id(t.parse_pliplom(df, FST=0.2), "e_event_pliplom_id")
    assert 12 in rare["outlier_e"]


@pytest.mark.parametrize("parse", [t.parse_ael, t.parse_brain, t.parse_iplom, t.parse_pliplom, t.parse_tip, t.parse_drain, t.parse_spell])
def test_partitions_do_not_matter(log, parse):
    columns = ["row_id", parse.id_column]
    a = sorted(map(tuple, parse(log).select(*columns).fillna("").collect()))
    b = sorted(map(tuple, parse(log.repartition(2)).select(*columns).fillna("").collect()))
    assert a == b and len(a) == 151
    assert parse(log.limit(0)).count() == 0


def test_enhancer_parses_once(log):
    e = EventLogEnhancer(log)
    first = e.parse(t.parse_ael)
    assert e.parse(t.parse_ael) is first and e.parse(t.parse_ael, reparse=True).columns == first.columns


def test_tip_groups_by_dependent_words(spark):
    texts = ["open file x1 done", "open file y2 done", "open file z3 done", "close socket a9", "close socket b8"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, e_message_normalized string")
    rows = {r.row_id: (r.e_event_tip_id, r.e_event_tip_template) for r in t.parse_tip(df, templates=True).collect()}
    assert rows[0] == rows[1] == rows[2] == ("e1", "open file <*> done") and rows[3] == rows[4] == ("e2", "close socket <*>")


def test_streamed_and_kept_state(spark, tmp_path):
    rows = [(k, text) for k, text in lines(3, 60) if text]
    schema = "row_id long, e_message_normalized string"
    for part in range(2):
        spark.createDataFrame([r for r in rows if (r[0] >= 30) == bool(part)], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    state = stream.DrainState(spark, f"{tmp_path}/state")
    kept = {}
    for part in range(2):
        out = state.parse(spark.read.parquet(f"{tmp_path}/in/{part}"))
        kept |= {r.row_id: (r.e_event_drain_id, r.e_event_drain_template) for r in out.collect()}
    assert set(kept) == {k for k, _ in rows}
    whole = {r.row_id: r.e_event_drain_id for r in t.parse_drain(spark.createDataFrame(rows, schema)).collect()}
    assert len({(kept[k][0], whole[k]) for k in kept}) == len({v[0] for v in kept.values()}) == len(set(whole.values()))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.parse_stream(source).writeStream.format("memory").queryName("drained").outputMode("append").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    seen = spark.sql("SELECT * FROM drained").collect()
    assert sorted(r.row_id for r in seen) == sorted(kept)
    assert len({(r.e_event_drain_id, whole[r.row_id]) for r in seen}) == len(set(whole.values()))
    enriched = stream.enhance_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/0"), "e_message_normalized")
    assert enriched.isStreaming and "e_words" in enriched.columns


def test_cover_looks_words_up_in_a_set(spark):
    rows = [(["a", "*", "b"], ["b", "c", "a"], True), (["a", "a", "z"], ["a", "b"], False), (["*"], ["q"], True), (["*", ""], [""], True), ([], ["a"], True), ([], None, True), (["a"], [], False), (None, ["a"], None), (["a"], None, None)]
    df = spark.createDataFrame(rows, "t array<string>, w array<string>, want boolean")
    made = df.select("want", plans._has(F.col("t"), F.col("w"), "*").alias("got"))
    assert all(r.got == r.want for r in made.collect())
    assert "forall" not in made._jdf.queryExecution().toString() and "array_contains" not in made._jdf.queryExecution().toString()
