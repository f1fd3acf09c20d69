import math

import duckdb
import numpy as np
import pytest
from tracewright.llm import vectors


def brute(rows, cosine=0.95):
    """{position: (links, component)}"""
    def unit(v):
        if v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float64)
        v = v / np.abs(v).max()
        return v / np.linalg.norm(v)

    units = [unit(v) for _, v in rows]
    near = [[b is not None and a is not None and len(a) == len(b) and a @ b >= cosine for b in units] for a in units]
    left = [k for k, _ in rows]
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if near[i][j] and i != j:
                    left[i] = left[j] = min(left[i], left[j])
    return sorted((rows[i][0], sum(n for j, n in enumerate(near[i]) if j != i), left[i]) for i in range(len(rows)))


def clusters(seed, d=16, count=12, near=0.12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in rng.normal(size=(count, d)):
        for _ in range(rng.integers(1, 14)):
            rows.append((c + rng.normal(size=d) * near * rng.choice([0, 1, 2])) * rng.choice([0.5, 3]))
    return [(k, v.astype(np.float32).tolist()) for k, v in enumerate(rng.permutation(rows))]


@pytest.mark.parametrize("block", [5, vectors.BLOCK])
def test_is_brute_force(spark, block):
    rows = clusters(1) + [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, [float("inf")] * 16), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [3e38] * 16), (909, [1e-38] * 16)]
    frame = spark.createDataFrame([(v, k, 1) for k, v in rows], "embedding array<float>, vec_id long, cid int").repartition(3)
    exact = vectors.R / 2
    got = sorted(map(tuple, vectors.near_vectors(frame, margin=exact, block=block).collect()))
    assert got == brute([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])


def test_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    step = rng.normal(size=base.shape)
    step *= 0.28 / np.linalg.norm(step, axis=1)[:, None]
    x = np.concatenate([base, base + step])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = (y @ y.T >= 0.95).sum() - len(y)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in vectors.near_vectors(frame).collect())
    assert want > 2000 and 0.99 * want <= got <= want


def test_no_rows(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("dims", [2, 4])
def test_every_link_of_a_hot_group(spark, dims):
    rng = np.random.default_rng(5)
    hot = np.zeros((1500, 64))
    hot[:, 0], hot[:, 1 : 1 + dims] = 1, rng.normal(size=(1500, dims)) * 0.25
    x = np.concatenate([hot, rng.normal(size=(1500, 64))])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = (y @ y.T >= 0.95).sum(1) - 1
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    for block in (500, vectors.BLOCK):
        got = {r.vec_id: r.n_links for r in vectors.near_vectors(frame, block=block).collect()}
        assert [got[k] for k in range(len(x))] == want.tolist()


@pytest.mark.parametrize("few", [1, 4096])
def test_probes_are_those_within_the_margin(few, monkeypatch):
    """Against signed distances to every border, with more lists than k-means has members for."""
    monkeypatch.setattr(vectors, "FEW", few)
    rng = np.random.default_rng(8)
    sample = rng.normal(size=(600, 12))
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    index = vectors.Index(sample, 300)
    x = rng.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:50] = index.centres[:50]
    d = ((x[:, None] - index.centres) ** 2).sum(2)
    gap = np.linalg.norm(index.centres[d.argmin(1)][:, None] - index.centres, axis=2)
    want = d - d.min(1)[:, None] <= 2 * vectors.MARGIN * gap + 1e-9
    home, rows, lists = index.probes(x, vectors.MARGIN)
    got = np.zeros(want.shape, bool)
    got[rows, lists] = True
    assert (home == d.argmin(1)).all() and not (want & ~got).any() and (got & ~want).sum() <= 2
    assert want.sum() < 0.9 * want.size


@pytest.mark.parametrize("spread", [1, 4, 16])
def test_large_group_of_few_dimensions(spark, spread):
    """A third of all vectors is one group that k-means cuts up; every link is found at the default margin."""
    rng = np.random.default_rng(spread)
    base = rng.normal(size=(900, 64))
    hot = np.zeros((450, 64))
    hot[:, 0] = 1
    hot[:, 1 : 1 + spread] = rng.normal(size=(450, spread)) * 0.35 / math.sqrt(spread)
    x = np.concatenate([base, hot])
    y = x / np.linalg.norm(x, axis=1)[:, None]
    want = (y @ y.T >= 0.95).sum() - len(y)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in vectors.near_vectors(frame).collect())
    assert want > 1000 and abs(got - want) <= 2


def test_query_is_its_sql(spark, tmp_path):
    rows = clusters(5) + [(900, None), (901, [0.0] * 16), (902, [1.0, 2.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({vectors.OP8_SQL})").fetchall())
    assert sorted(map(tuple, vectors.op8_embedding_near_dedup(spark, str(tmp_path)).collect())) == want
    assert sum(n for _, n, *_ in want) > 20
