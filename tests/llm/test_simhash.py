import random

import pytest
import xxhash
from tracewright.llm import simhash as s


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace(" ", " ")
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: [(doc_id, fp)] -> {doc_id: least reachable}"""
    left = {k: k for k, _ in prints}
    for _ in prints:
        for a, x in prints:
            for b, y in prints:
                if (x ^ y).bit_count() <= 4:
                    left[a] = left[b] = min(left[a], left[b])
    return left


def test_fingerprint_is_brute_force():
    rng = random.Random(0)
    texts = [None, "", " \n", "One", "One two THREE", "a b c d", "É é ß A B c\td"] + ["".join(rng.choice("ab C\né\t") for _ in range(rng.randrange(300))) for _ in range(200)]
    for text in texts:
        assert s.fingerprint(text) == brute_print(text)
    long = "word and more " * 120_000 + "tail"
    assert s.fingerprint(long) == brute_print(long)


@pytest.mark.parametrize("crowd", [0, 2, 256])
def test_links_are_brute_force(spark, crowd):
    rng = random.Random(5)
    prints = [0, 2**64 - 1]
    for _ in range(6):
        centre = rng.getrandbits(64)
        prints += [centre] + [centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6]))) for _ in range(9)]
    prints = list(dict.fromkeys(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = s.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd)
    from tracewright.llm.shared import components

    got = {r.node: r.root for r in components(edges).collect()}
    want = brute_components(list(zip(signed, [p & (2**64 - 1) for p in signed], strict=True)))
    assert {p: got.get(p, p) for p in signed} == want


def test_rows_and_edges(spark, tmp_path):
    base = [f"w{k}" for k in range(400)]
    near = [*base[:200], "other", *base[201:]]
    rows = [(5, " ".join(base), "a"), (3, " ".join(base), "b"), (9, " ".join(near), "c"), (4, None, "d"), (8, "", "e"), (8, "", "e"), (7, "alone here", "f")]
    spark.createDataFrame(rows, "doc_id long, text string, fp string").write.parquet(f"{tmp_path}/documents.parquet")
    out = s.op4_simhash_near_dedup(spark, str(tmp_path)).collect()
    want = brute_components([(k, brute_print(t)) for k, t, _ in rows])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted((k, f"{brute_print(t):016x}", want[k]) for k, t, _ in rows)
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("crowd", [2, 256])
def test_multiplied_tables_are_not_broadcast(spark, crowd):
    """Spark takes the keys and balls of a few fingerprints for as small as the fingerprints."""
    rng = random.Random(6)
    prints = spark.createDataFrame([(rng.getrandbits(63),) for _ in range(200)], "fp long")
    assert "Broadcast" not in s.links(prints, crowd)._jdf.queryExecution().executedPlan().toString()
