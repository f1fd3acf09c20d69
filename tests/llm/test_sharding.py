import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from tracewright.llm import sharding


def check(rows, out, shards):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in out) == sorted((k is None, k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return Counter({s: sum(r.size for r in out if r.shard == s) for s in range(shards)})


def test_bytes_are_near_equal_and_copies_together(spark):
    rng = random.Random(6)
    rows = [(k, "x" * int(rng.expovariate(0.003)) + str(k), "en" if k % 3 else None, f"s{min(9, k % 30)}", 7) for k in range(3000)]
    rows += [(10_000 + k, "a copy " * 9, "en", f"s{k}", 7) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int")
    out = sharding.shard(docs).collect()
    sizes = check(rows, out, 8)
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    assert len({r.shard for r in out if r.doc_id >= 10_000}) == 1
    assert sorted(map(tuple, out)) == sorted(map(tuple, sharding.shard(docs.repartition(5)).collect()))


def test_hot_group_is_cut(spark):
    rows = [(k, "the same text " * 20, "en", "s") for k in range(900)] + [(1000 + k, f"{k} " * 70, "en", "s") for k in range(1800)] + [(7, None, None, None), (7, "", "", ""), (7, "", "", "")]
    sizes = check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), shards=5).collect(), 5)
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_target_and_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert sharding.shard(spark.createDataFrame([], schema)).count() == 0
    few = [(1, "a", None, None), (1, "a", None, None), (2, None, "x", "y")]
    check(few, sharding.shard(spark.createDataFrame(few, schema)).collect(), 8)
    rows = [(k, "y" * 99, "en", "s") for k in range(100)]
    assert len({r.shard for r in sharding.shard(spark.createDataFrame(rows, schema), shards=None, target_bytes=2500).collect()}) == 4


def brute_tree(points, dims, shards):
    """points: (id, weight, tie, coordinates); {id: shard} by sorting each node."""
    width = lambda own, k: max(p[3][k] for p in own) - min(p[3][k] for p in own)
    full, out = [max(1, width(points, k)) for k in range(dims)], {}

    def split(own, first, m):
        if m == 1 or not own:
            out.update({p[0]: first for p in own})
            return
        cut = max(range(dims), key=lambda k: width(own, k) / full[k])
        own = sorted(own, key=lambda p: (p[3][cut], p[2]))
        goal, below, at = int(sum(p[1] for p in own) * (m // 2) / m), 0, 0
        while at < len(own):
            key = (own[at][3][cut], own[at][2])
            same = [p for p in own[at:] if (p[3][cut], p[2]) == key]
            last = sum(p[1] for p in same)
            if below + last >= goal:
                at += len(same) if goal - below > last / 2 else 0
                break
            below, at = below + last, at + len(same)
        split(own[:at], first, m // 2)
        split(own[at:], first + m // 2, m - m // 2)

    split(points, 0, shards)
    return out


def test_tree_is_brute_force(spark):
    rng = random.Random(9)
    points = [(k, rng.choice([1, 5, 40, 900]), rng.randrange(1 << 16), (rng.choice([3, 3, rng.randrange(1 << 32)]), rng.choice([7, 1 << 30]), rng.randrange(5000))) for k in range(500)]
    frame = spark.createDataFrame([(k, w, t, *c) for k, w, t, c in points], "id long, weight long, tie long, a long, b long, c long")
    for shards in (1, 2, 5, 8):
        got = {r.id: r.shard for r in sharding.kd_tree(frame, ["a", "b", "c"], shards).collect()}
        assert got == brute_tree(points, 3, shards), shards


def test_very_long_texts_and_other_columns(spark):
    rows = [(k, "long " * (400_000 if k == 3 else 5), "en", "s", 1, 2) for k in range(40)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", "shard", "a.b"]).withColumn("doc_id", F.col("doc_id").cast("int"))
    out = sharding.shard(docs).collect()
    assert {r.size for r in out} == {26, 2_000_001} and len({r.shard for r in out if r.size == 26}) <= 8
