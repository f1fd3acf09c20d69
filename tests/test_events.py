import bz2
import math
import random

import pytest
from pyspark.sql import functions as F
from tracewright import model
from tracewright.functions import text
from tracewright.operators import distance, joins, windows
from tracewright.operators.distance import LogDistance
from tracewright.operators.embedding import hashing_encoder, with_encoder
from tracewright.operators.events import EventLogEnhancer
from tracewright.operators.nextevent import NextEventPredictionNgram, perplexity
from tracewright.operators.sequences import SequenceEnhancer
from tracewright.sources import sinks


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "m string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "message, masked",
    [
        ("1 2 3 4", "<NUM> <NUM> <NUM> <NUM>"),
        ("-5 x", "-<NUM> x"),
        ("x=-7;+8", "x=<NUM>;+<NUM>"),
        ("task_2008_0001_m_000590_0/part", "task_<NUM>_<NUM>_m_<NUM>_<NUM>/part"),
        ("at 10.0.0.1:80\nsecond 5", "at <IP>:<NUM>"),
        ("mac 0a:1b:2c:3d up", "mac <ID> up"),
        ("0xfF at", "<HEX> at"),
        ('executed cmd "ls -l"', "executed cmd <CMD>"),
        ("", ""),
        (None, None),
    ],
)
def test_masks(spark, message, masked):
    assert one(spark, message, text.mask(F.col("m"))) == masked


def test_text_columns(spark):
    col = F.col("m")
    assert one(spark, "a  b ", text.words(col)) == ["a", "", "b", ""] and one(spark, "", text.words(col)) == [""]
    assert one(spark, "a\r\nb\nc", text.line_count(col)) == 3
    assert sorted(one(spark, "abcd\nxyz", text.trigram_bag(col))) == ["abc", "bcd", "xyz", "xyz", "xyz"]
    assert one(spark, "abcd", text.char_ngrams(col)) == ["abc", "bcd"] and one(spark, "ab", text.char_ngrams(col)) == [] and one(spark, "ab", text.char_ngrams(col, 0)) == []
    assert one(spark, "a1-b_c", text.alphanumerics(col)) == ["a1", "b", "c"]
    df = spark.createDataFrame([("a b",), (None,)], "m_message string")
    rows = model.split_fields(df, "m_message", ["w", "x", "y", "z"]).collect()
    assert [tuple(r)[1:] for r in rows] == [("a", "b", None, None), (None,) * 4]


def test_guards_audit_and_labels(spark):
    df = spark.createDataFrame([(1, "ok", True), (2, None, False), (3, "bad �", None)], "row_id long, m_message string, normal boolean")
    with pytest.raises(ValueError, match="needs columns"):
        EventLogEnhancer(df).words("none")
    with pytest.raises(ValueError, match="mandatory"):
        model.check_mandatory(df)
    with pytest.raises(ValueError, match="timestamp"):
        model.check_mandatory(df.withColumn("m_timestamp", F.lit("x")))
    assert sorted(map(tuple, model.audit(df).collect())) == [("m_message", 1, 1), ("normal", 1, 0)]
    assert [r.anomaly for r in model.with_anomaly(df).orderBy("row_id").collect()] == [False, True, None]
    assert [r.normal for r in model.with_anomaly(df.withColumnRenamed("normal", "anomaly")).orderBy("row_id").collect()] == [False, True, None]
    no, yes = model.partition_by_pattern(df, "^o")
    assert (no.count(), yes.count()) == (1, 1)
    e = EventLogEnhancer(df)
    first = e.words()
    assert e.words() is first and e.length().columns == e.length().columns


def test_reduction_is_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 40).cast("string").alias("seq_id"))
    seq = df.select("seq_id").distinct()
    a, s = model.reduce_rows(df, seq, 0.3)
    assert s.count() == 12 and a.count() == 300
    assert model.reduce_rows(df, seq, 0.001)[1].count() == 1
    b, none = model.reduce_rows(df, None, 0.25)
    assert b.count() == 250 and none is None
    assert sorted(r.row_id for r in model.reduce_rows(df.repartition(7), None, 0.25)[0].collect()) == sorted(r.row_id for r in b.collect())


def test_sequences(spark):
    rows = [(1, "s", "2020-01-01 00:00:00", ["a"], "x", True), (2, "s", "2020-01-01 00:00:03", [], "y", False), (3, "t", "2020-01-01 00:00:01", ["b", "c"], None, False)]
    df = spark.createDataFrame(rows, "row_id long, seq_id string, t string, e_words array<string>, ev string, anomaly boolean").withColumn("m_timestamp", F.col("t").cast("timestamp")).withColumn("m_message", F.col("ev"))
    df = df.withColumn("e_words_len", F.size("e_words")).repartition(3)
    seq = spark.createDataFrame([("s", 0), ("t", 0), ("none", 0)], "seq_id string, seq_len int")
    e = SequenceEnhancer(df, seq)
    e.seq_len().duration().tokens().events("ev").time_stamp().anomaly_ratio()
    e.seq_len()
    got = {r.seq_id: r for r in e.df_seq.collect()}
    assert set(got) == {"s", "t"} and got["s"].seq_len == 2 and got["s"].duration_sec == 3 and got["s"].e_words == ["a"] and got["t"].e_words_len == 2
    assert got["s"].ev == ["x", "y"] and got["t"].ev == [None] and got["s"].anomaly_ratio == 0.5
    assert str(got["s"].time_stamp) == "2020-01-01 00:00:01.500000"
    vectors = spark.createDataFrame([("s", [1.0, 3.0]), ("s", [3.0, 5.0])], "seq_id string, e_bert_emb array<double>")
    assert SequenceEnhancer(vectors).embeddings().df_seq.first().e_bert_emb == [2.0, 4.0]


def test_tokens_joined_as_the_list_would_be(spark):
    rows = [("s", 3, ["c", None, "d"]), ("s", 1, ["a"]), ("s", 2, []), ("s", 4, None), ("s", 5, [""]), ("s", 6, [None]), ("t", 7, None), ("u", 8, ["", ""])]
    df = spark.createDataFrame(rows, "seq_id string, row_id long, e_words array<string>").repartition(3)
    want = {r.seq_id: r.w for r in SequenceEnhancer(df).tokens().df_seq.select("seq_id", F.array_join("e_words", " ").alias("w")).collect()}
    assert {r.seq_id: r.e_words for r in SequenceEnhancer(df).tokens(separator=" ").df_seq.collect()} == want
    assert want == {"s": "a c d ", "t": "", "u": " "}
    sized = SequenceEnhancer(df.withColumn("e_words_len", F.when(F.col("row_id") < 7, 2))).tokens(separator=" ").df_seq
    assert {r.seq_id: (r.e_words, r.e_words_len) for r in sized.collect()} == {"s": ("a c d ", 12), "t": ("", None), "u": (" ", None)}
    assert "collect_list" not in sized._jdf.queryExecution().toString()


@pytest.mark.parametrize("ranges", [1, 3, 64])
def test_running_sum_in_ranges(spark, ranges):
    df = spark.range(500).select(F.col("id").alias("row_id"), F.when(F.col("id") % 9 != 0, (F.col("id") * 7 % 50)).cast("double").alias("o"), (F.col("id") % 4).alias("v")).repartition(5)
    got = {r.row_id: r.s for r in windows.running_sum(df, F.col("v"), [F.col("o"), F.col("row_id")], "s", ranges).collect()}
    total = 0
    for r in sorted(df.collect(), key=lambda r: (r.o is not None, r.o or 0, r.row_id)):
        total += r.v
        assert got[r.row_id] == total


def test_next_events(spark):
    events = spark.createDataFrame([("s", k, e) for k, e in enumerate(["e1", "e2"])], "seq_id string, row_id long, event string")
    sliced = NextEventPredictionNgram(3).slices(events).orderBy("pos").collect()
    assert [" ".join([*r.context, r.event]) for r in sliced] == ["SoS SoS e1", "SoS e1 e2", "e1 e2 EoS"]
    tie = spark.createDataFrame([("a", 1, "x y"), ("a", 2, "p"), ("b", 3, "x y"), ("b", 4, "q")], "seq_id string, row_id long, event string")
    m = NextEventPredictionNgram(2).fit(tie)
    scored = {(r.seq_id, r.pos): r for r in m.score(tie).collect()}
    assert scored["b", 1].nep_predict == "p" and scored["b", 1].nep_corr == 0 and scored["b", 0].nep_predict == "x y" and scored["a", 1].nep_prob_nmax == 1.0
    other = spark.createDataFrame([("c", 1, "new")], "seq_id string, row_id long, event string")
    unseen = {r.pos: r for r in m.score(other).collect()}
    assert unseen[1].nep_predict == "<UNSEEN>" and unseen[1].nep_abs == 0 and unseen[0].nep_prob_nsum == 0.0
    p = spark.createDataFrame([(1.0,), (0.0,)], "p double").select(perplexity("p").alias("x")).first().x
    assert math.isinf(p)


def test_distances(spark):
    df = spark.createDataFrame([(1, "a bb cc"), (2, "bb dd")], "row_id long, m_message string")
    same = LogDistance(df, df).measure_all_distances().first()
    assert abs(same.cosine) < 1e-12 and same.jaccard == same.containment == 0 and same.rows_train == 2 and 0 <= same.compression < 0.5
    none = spark.createDataFrame([(1, "! ?")], "row_id long, m_message string")
    assert tuple(LogDistance(none, none).measure_all_distances().first())[:4] == (None,) * 4
    assert LogDistance(df, none).containment().first().containment == 1.0
    ops = [(r.op, r.line) for r in LogDistance(df, df.where("row_id = 1")).diff_lines().orderBy("pos").collect()]
    assert ops == [(" ", "a bb cc"), ("-", "bb dd")]
    lists = df.select("row_id", F.split("m_message", " ").alias("w"))
    assert LogDistance(lists, lists, "w").cosine().count() == 1


def test_compression_by_pieces(spark, monkeypatch):
    """Against bz2 over the same pieces of the whole texts; no row holds a whole log."""
    monkeypatch.setattr(distance, "PIECE", 100)
    rng = random.Random(3)
    a, b = ([(k, rng.choice([None, "", "é", "x" * 250, "get file 17 of user"])) for k in range(n)] for n in (40, 23))
    size = lambda t: sum(len(bz2.compress(t[k : k + 100])) for k in range(0, len(t), 100)) or 14
    for one, other in ((a, b), (b, a), (a, []), ([(1, "")], b)):
        x, y = (" ".join(m for _, m in r if m is not None).encode() for r in (one, other))
        frames = [spark.createDataFrame(r, "row_id long, m_message string").repartition(3) for r in (one, other)]
        made = LogDistance(*frames).compression()
        assert "collect_list" not in made._jdf.queryExecution().toString()
        assert math.isclose(made.first().compression, (size(x + y) - min(size(x), size(y))) / max(size(x), size(y)))


def test_line_diff_by_parts(spark, monkeypatch):
    """Every log comes back from its difference, and what is alike is found in logs too large for one ndiff."""
    monkeypatch.setattr(distance, "MOST_DIFFED", 200)
    rng = random.Random(6)
    a = [(k, rng.choice([f"line {k}", "often", "", f"first {k}\nsecond", None])) for k in range(300)]
    changed = [(k, m if rng.random() < 0.9 else f"new {k}") for k, m in a if rng.random() < 0.95]
    frame = lambda rows: spark.createDataFrame(rows, "row_id long, m_message string").repartition(3)
    for other, least in ((a, 1.0), (changed, 0.7), ([], 0.0), ([(k, f"x{k}") for k in range(90)], 0.0)):
        rows = LogDistance(frame(a), frame(other)).diff_lines().orderBy("pos").collect()
        assert [r.pos for r in rows] == list(range(len(rows)))
        one, two = ("\n".join(m for _, m in r if m is not None).split("\n") for r in (a, other))
        assert [r.line for r in rows if r.op in " -"] == one and [r.line for r in rows if r.op in " +"] == two
        assert sum(r.op == " " for r in rows) >= least * len(one)


def test_nearest_and_embedding(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None)], "k long, v array<double>")
    got = {r.k: r.nearest for r in joins.nearest(df, df.where("k in (2, 3)"), "k", "v", 3).collect()}
    assert got == {1: 2, 2: 2, 3: 3}
    texts = spark.createDataFrame([(1, "Open file"), (2, "open FILE"), (3, None)], "row_id long, m string")
    rows = {r.row_id: r.e for r in with_encoder(texts, "m", "e", hashing_encoder).collect()}
    assert rows[1] == rows[2] and len(rows[1]) == 64 and not any(rows[3])
    assert EventLogEnhancer(texts).embed(lambda d, c, n: with_encoder(d, c, n, hashing_encoder), "m").columns[-1] == "e_bert_emb"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "k int, t_x string")
    sinks.write_parquet(df, f"{tmp_path}/p")
    sinks.write_tsv(df, f"{tmp_path}/c")
    sinks.write_lines(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/t").collect()) == ["1 a b", "2"]
    assert spark.read.csv(f"{tmp_path}/c", sep="\t", header=True).columns == ["k", "t_x"]
    assert "t\\_x" in sinks.latex_table(df)


@pytest.mark.parametrize("chunk", [1, 3, 20])
def test_fills_and_merges_in_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(windows, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [(k, rng.choice(["a", "b", None]), rng.choice([None, None, None, float(k)]), f"m{k}") for k in rng.sample(range(400), 200)]
    df = spark.createDataFrame(rows, "row_id long, file_name string, t double, m_message string").repartition(5)
    last, after, want = {}, {}, {}
    for k, f, t, _ in sorted(rows):
        last[f] = last.get(f) if t is None else t
        want[k] = [last[f]]
    for k, f, t, _ in sorted(rows, reverse=True):
        after[f] = after.get(f) if t is None else t
        want[k].append(after[f])
    got = {r.row_id: [r.t] for r in windows.fill_last_seen(df, "t").collect()}
    for r in windows.fill_next(df, "t").collect():
        got[r.row_id].append(r.t)
    assert got == want
    events, lines = {}, {}
    for k, f, t, m in sorted(rows):
        if t is not None or f not in events:
            events[f] = k
        lines.setdefault((f, events[f]), []).append(m)
    merged = windows.merge_lines(df, F.col("t").isNotNull()).collect()
    assert {(r.file_name, r.row_id): r.m_message.split("\n") for r in merged} == lines


def test_fill_next_goes_once_through_its_rows(spark):
    """A frame that ends with the partition is evaluated anew for each row."""
    df = spark.range(50_000).select(F.col("id").alias("row_id"), F.lit("a").alias("file_name"), F.when(F.col("id") % 5000 == 4999, F.col("id")).alias("t"))
    filled = windows.fill_next(df, "t")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    assert filled.where("t = 5000 * floor(row_id / 5000) + 4999").count() == 50_000


def test_first_rows_and_numbers(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["x", "y", None, "z"]), rng.randrange(5)) for k in range(60)]
    df = spark.createDataFrame(rows, "row_id long, item string, s int").withColumn("m_timestamp", F.timestamp_seconds("s")).repartition(4)
    for direction, key in ((1, lambda r: (r[2], r[0])), (-1, lambda r: (-r[2], r[0])), (0, lambda r: r[0])):
        first = {min((r for r in rows if r[1] == v), key=key)[0] for v in ("x", "y", None, "z")}
        assert {r.row_id for r in windows.mark_first(df, "item", direction).where("_first").collect()} == first
    for most in (10, 1000):
        got = {r.row_id: r.n for r in windows.numbered(df.select((F.col("row_id") * 7).alias("row_id")), "row_id", "n", most).collect()}
        assert got == {7 * k: k + 1 for k in range(60)}


def test_masks_only_run_where_they_can_match(spark):
    """The masks alone and behind what their matches must have give the same; a text without it isn't searched."""
    rng = random.Random(3)
    parts = ["12:ab:cd:ef", "aa:bb:cc", "1.2.3.4", "1.2.3", "abcdef abcdef abcdef", "abcdefabcdefabcdef0", "ABCD 0123 4567 89AB", "ABCD0123", "0x1f", "0x", "-7", "+12", "\u0663", "x9", "9x", 'executed cmd "a"', "word", "_", ":"]
    texts = [rng.choice(["", " ", "=", ","]).join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(x,) for x in [*texts, None, ""]], "m string")
    plain = F.col("m")
    for to, pattern in text.MASKS:
        for _ in range(2):
            plain = F.regexp_replace(plain, pattern, to)
    rows = df.select("m", text.mask(F.col("m")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and len({r.want for r in rows}) > 100
    assert set(text.CORES) == {pattern for _, pattern in text.MASKS[:-1]}
