"""Embedding near-dedup by product quantisation.

Vectors of equal components are one class. A sample of at most SAMPLE classes, by hash,
and of VALUES components (so fewer classes beyond 512 dimensions), gives the centres of the coarse lists, as many as the square root of the number of classes
(up to SAMPLE lists, so of a thousand million classes), and the codebooks of the
residuals' subspaces. Centres come from k-means where the sample has MEMBERS vectors for
each, and else are vectors of the sample themselves; which links are found doesn't depend
on it. Every class is indexed:
in the list of its nearest centre, as the codes of its residual, with the length of what
the codes leave out. A class also looks into each list whose border lies within MARGIN
= R / 2 of it: a link is at most R long and crosses the border of its ends' lists, so the
end nearer to that border lies within R / 2. That end alone asks, so no link is counted
twice or missed. In a list, table lookups give the distance of each vector to each coded
one; if that, less what the code leaves out, is within R, the exact cosine decides.

Lists near each other form groups of about BLOCK members, and a class is sent once to each
group it looks into. A group's members, and its visitors, are cut into blocks that are
compared two by two, so no list or group has to fit a task. A block returns, for each
vector, how many it links to, and a spanning forest of its links; pairs never become rows.
Vectors that are null, zero, or hold null,
NaN or infinite components link with nothing and are components of their own; vectors of
different dimensions never link. Repeated rows count as vectors each. An empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .shared import components, received, ship

COSINE, SAMPLE, VALUES, MEMBERS, FEW, BLOCK, PARTS, CODES = 0.95, 32_768, 1 << 24, 16, 2048, 8192, 8, 256
R = math.sqrt(2 - 2 * COSINE)
MARGIN = R / 2


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(half - x[at : at + 4096] @ centres.T).argmin(1) for at in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k centres of the rows of x, or fewer if x has fewer rows."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def grouped(centres: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The group of each centre: halves of like weight along the widest direction, over and over."""
    out, todo = np.zeros(len(centres), np.int32), [(np.arange(len(centres)), groups, 0)]
    while todo:
        own, count, first = todo.pop()
        out[own] = first
        if count < 2 or len(own) < 2:
            continue
        apart = centres[own] - centres[own].mean(0)
        own = own[np.argsort(apart @ np.linalg.eigh(apart.T @ apart)[1][:, -1], kind="stable")]
        sums = np.cumsum(weight[own] + 1e-9)
        cut = min(max(1, int(np.searchsorted(sums, sums[-1] * (count // 2) / count))), len(own) - 1)
        todo += [(own[:cut], count // 2, first), (own[cut:], count - count // 2, first + count // 2)]
    return out


class Index:
    """Coarse centres, their groups and the codebooks of the residuals' parts."""

    def __init__(self, sample: np.ndarray, lists: int, groups: int = 1):
        self.centres = k_means(sample[: 4 * MEMBERS * lists], lists, 8 if len(sample) >= MEMBERS * lists else 0)
        home = _nearest(sample, self.centres)
        self.group = grouped(self.centres, np.bincount(home, minlength=len(self.centres)), groups)
        self.between: np.ndarray | None = None
        residual = (sample - self.centres[home])[: 32 * CODES]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(PARTS, sample.shape[1]))
        self.books = [k_means(residual[:, p], CODES) for p in self.parts]

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of each residual, and the length of what they leave out."""
        codes = np.stack([_nearest(residual[:, p], book) for p, book in zip(self.parts, self.books, strict=True)], 1)
        left = np.sqrt(sum(((residual[:, p] - book[codes[:, k]]) ** 2).sum(1) for k, (p, book) in enumerate(zip(self.parts, self.books, strict=True))))
        return codes.astype(np.uint8), left

    def _gaps(self) -> np.ndarray:
        """The distances between all centres, worked out once; for FEW centres at most."""
        if self.between is None:
            size = (self.centres**2).sum(1)
            self.between = np.sqrt(np.maximum(size[:, None] + size - 2 * (self.centres @ self.centres.T), 0))
        return self.between

    def probes(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The home list of each row, and (row, list) of those that are home or whose border is within margin.

        Of FEW centres at most all distances are kept. Of more, they are worked out only for
        the lists whose border can be within margin: a border is at least half as far away
        as the other centre is farther than home.
        """
        c = self.centres
        size = (c**2).sum(1)
        score = x @ c.T - size / 2
        home = score.argmax(1)
        best, whole = score[np.arange(len(x)), home], (x**2).sum(1)
        if len(c) <= FEW:
            rows, lists = np.nonzero(best[:, None] - score <= margin * self._gaps()[home] + 1e-7)  # rounding must lose none
            return home, rows, lists
        reach = np.sqrt(np.maximum(whole - 2 * best, 0)) + 2 * margin + 1e-6
        rows, lists = np.nonzero(score >= (whole - reach**2)[:, None] / 2 - 1e-7)
        near = np.empty(len(rows), bool)
        for at in range(0, len(rows), 65_536):
            i, j = rows[at : at + 65_536], lists[at : at + 65_536]
            gap = np.sqrt(((c[home[i]] - c[j]) ** 2).sum(1))
            near[at : at + 65_536] = best[i] - score[i, j] <= margin * gap + 1e-7
        return home, rows[near], lists[near]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """The rows of x at length 1, in a way in which squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _sound(batches):
    """Vectors as they are; null if they are null, zero, or not finite."""
    for batch in batches:
        column = batch.column("v")
        sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
        x = column.flatten().to_numpy(zero_copy_only=False)  # null components as NaN
        sound = sizes > 0
        if sound.any():
            starts = (np.cumsum(sizes) - sizes)[sound]
            biggest = np.maximum.reduceat(np.abs(x), starts)
            fine = np.isfinite(biggest) & (biggest > 0)
            sound[sound] = fine
        kept = x[np.repeat(sound, sizes)]
        ends = np.append(0, np.cumsum(np.where(sound, sizes, 0))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cid"), pa.ListArray.from_arrays(pa.array(ends), pa.array(kept), mask=pa.array(~sound))], ["vec_id", "cid", "v"])


_LISTED = "home int, own int, visits array<struct<grp: int, lists: array<int>>>, cid long, n long, v "


def _assign(shared, margin: float):
    """A row's home list, that one's group, and the lists it looks into by their group."""

    def run(batches):
        index = received(shared)
        place = np.argsort(np.argsort(index.group, kind="stable"))
        for batch in batches:
            step = max(16, min(1024, (4 << 20) // len(index.centres)))  # scores of about 32 MB at once
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                home, rows, lists = index.probes(_unit(_matrix(part.column("v"))), margin)
                by_group = np.lexsort((place[lists], rows))
                rows, lists = rows[by_group], lists[by_group].astype(np.int32)
                group = index.group[lists]
                first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (group[1:] != group[:-1])))
                inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)).astype(np.int32)), pa.array(lists))
                outer = pa.array(np.searchsorted(rows[first], np.arange(len(home) + 1)).astype(np.int32))
                visits = pa.ListArray.from_arrays(outer, pa.StructArray.from_arrays([pa.array(group[first]), inner], ["grp", "lists"]))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(index.group[home]), visits, *(part.column(c) for c in ("cid", "n", "v"))], ["home", "own", "visits", "cid", "n", "v"])

    return run


_OUT = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])


def _compare(shared, cosine: float):
    r = math.sqrt(2 - 2 * cosine)

    def run(key, table):
        index = received(shared)
        _, a, b = (k.as_py() for k in key)
        x = _unit(_matrix(table.column("v")))
        home, cid, n, chunk, member = (table.column(c).to_numpy() for c in ("home", "cid", "n", "chunk", "member"))
        looks = table.column("lists").combine_chunks()
        rows, lists = np.repeat(np.arange(len(x)), looks.value_lengths().to_numpy()), looks.flatten().to_numpy()
        rows, lists = rows[np.argsort(lists, kind="stable")], np.sort(lists)
        c, size = index.centres, (index.centres**2).sum(1)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))
        for here in np.unique(home[member]).tolist():
            asking = rows[np.searchsorted(lists, here) : np.searchsorted(lists, here, "right")]
            for side, other in {(a, b), (b, a)}:
                asks, answers = asking[chunk[asking] == side], np.flatnonzero(member & (home == here) & (chunk == other))
                if not len(asks) or not len(answers):
                    continue
                codes, left = index.encode(x[answers] - c[here])
                for at in range(0, len(asks), 256):
                    ask = asks[at : at + 256]
                    far = np.zeros((len(answers), len(ask)))
                    for k, (p, book) in enumerate(zip(index.parts, index.books, strict=True)):
                        own = x[ask][:, p] - c[here, p]
                        far += ((book**2).sum(1)[:, None] - 2 * (book @ own.T) + (own**2).sum(1))[codes[:, k]]
                    j, i = np.nonzero(far <= (r + 1e-6 + left[:, None]) ** 2)
                    i, j = ask[i], answers[j]
                    keep = (home[i] != here) | (i < j)
                    i, j = i[keep], j[keep]
                    hit = np.zeros(len(i), bool)
                    for k in range(0, len(i), 65_536):
                        p, q = i[k : k + 65_536], j[k : k + 65_536]
                        low, high = np.minimum(home[p], here), np.maximum(home[p], here)
                        # of the two ends the nearer to the border asks, by one sum for both
                        ahead = ((x[p] + x[q]) * (c[low] - c[high])).sum(1) < size[low] - size[high]
                        hit[k : k + 65_536] = (np.einsum("ij,ij->i", x[p], x[q]) >= cosine) & ((home[p] == here) | (ahead == (home[p] == low)))
                    i, j = i[hit], j[hit]
                    np.add.at(links, i, n[j])
                    np.add.at(links, j, n[i])
                    while (root[i] != root[j]).any():
                        one, two = root[i], root[j]
                        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
                        while (root[root] != root).any():
                            root = root[root]
        some = np.flatnonzero(links)
        joined = np.flatnonzero(root != np.arange(len(x)))
        u = np.append(cid[some], cid[joined])
        return pa.Table.from_arrays([pa.array(u), pa.array(np.append(np.zeros(len(some), np.int64), cid[root[joined]]), mask=np.append(np.ones(len(some), bool), np.zeros(len(joined), bool))), pa.array(np.append(links[some], np.zeros(len(joined), np.int64)))], schema=_OUT)

    return run


def near_vectors(rows: DataFrame, cosine: float = COSINE, margin: float | None = None, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id) for rows (vec_id, embedding)."""
    spark = rows.sparkSession
    margin = math.sqrt(2 - 2 * cosine) / 2 if margin is None else margin
    kind = "array<float>" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.transform("embedding", lambda x: x.cast("double"))
    raw = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.size("embedding"), v).alias("cid"), F.col("embedding").cast(kind).alias("v"))
    named = save(raw.mapInArrow(_sound, f"vec_id long, cid long, v {kind}"), "vectors")
    known = named.where("v IS NOT NULL")
    classes = save(known.groupBy("cid").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("low")), "vector-classes")
    parts = []
    for dimension, count in classes.groupBy(F.size("v")).count().collect():
        own = classes.where(F.size("v") == dimension)
        sample = _unit(_matrix(own.orderBy(F.xxhash64("cid"), "cid").limit(max(1, min(SAMPLE, VALUES // dimension))).select("v").toArrow().column("v")))
        rows_of_block = max(1, block * 64 // max(64, dimension))
        index = ship(spark, Index(sample, min(len(sample), max(1, math.isqrt(count))), -(-count // rows_of_block)))
        listed = save(own.select("cid", "n", "v").mapInArrow(_assign(index, margin), _LISTED + kind), "vector-lists")
        spread = listed.select("*", F.explode("visits").alias("visit")).select("home", "cid", "n", "v", "visit.grp", "visit.lists", (F.col("visit.grp") == F.col("own")).alias("member"))
        blocks = [F.ceil(F.count_if(c) / F.lit(size)).cast("int") for c, size in ((F.col("member"), rows_of_block), (~F.col("member"), 4 * rows_of_block))]
        cuts = spread.groupBy("grp").agg(blocks[0].alias("km"), blocks[1].alias("kv")).where("km > 0")  # a row for each group
        chunk = F.when(F.col("member"), F.pmod(F.xxhash64("cid"), "km")).otherwise(F.col("km") + F.pmod(F.xxhash64("cid"), F.greatest("kv", F.lit(1)))).cast("int")
        chunked = spread.join(F.broadcast(cuts), "grp").withColumn("chunk", chunk)
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("member"), F.col("km") + F.col("kv")).otherwise(F.col("km")) - 1))
        pairs = chunked.select("*", other.alias("other")).withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("other", "km", "kv")
        parts.append(pairs.groupBy("grp", "a", "b").applyInArrow(_compare(index, cosine), "u long, v long, links long"))
    if not parts:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    found = save(found, "vector-links")
    links = found.where("v IS NULL").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("links"))
    roots = components(found.where("v IS NOT NULL").select("u", "v")).withColumnRenamed("node", "cid")
    joined = save(classes.select("cid", "n", "low").join(links, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid")), "vector-components")
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    known_class = joined.join(least, "root").select("cid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = named.join(known_class, (named["cid"] == known_class["cid"]) & named["v"].isNotNull(), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of embeddings with its links and component."""
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: The same rows by every pair; components by walking along the links.
OP8_SQL = """
WITH RECURSIVE u AS (
  SELECT vec_id, CASE WHEN n > 0 AND isfinite(n) THEN list_transform(e, lambda x: x / sqrt(n)) END AS v
  FROM (SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) AS n FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a, u b
  WHERE a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM u UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
)
SELECT vec_id, (SELECT count(*) FROM links WHERE x = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least
"""
