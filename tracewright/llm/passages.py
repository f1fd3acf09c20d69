"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a line of MIN_WORDS words or more; words are split at ASCII white space,
A-Z in lower case. Two paragraphs are near if the Jaccard similarity of their sets of
SHINGLE-word shingles is NEAR or more. Paragraphs of equal words are one class. A class
has BANDS keys of ROWS minima each, so that a pair at NEAR shares none in less than one
case of a thousand (see bands()). The members of each key are compared by their exact
sets until it is known which belong together; keys with the same members are done once.
Of a key with over BLOCK members, those near its first one belong together by that; only
the others meet all members, in blocks, two by two. Classes that are near, over any number
of steps, are a component: its first paragraph (by doc_id, the text's hash and place)
stays, the others go.

So that a passage inside different paragraphs is found too, lines are also cut into pieces
after every sentence of LEAST_PIECE words or more, and inside those pieces where the hash
of the two words at the cut is the least of its neighbourhood (less than LEAST_PIECE words
off), hence alike wherever the passage stands, with or without sentence marks. Pieces are
matched by equality (64-bit hashes). Consecutive pieces that stand earlier elsewhere go if
they have MIN_WORDS words together; a cut piece at either end of a passage stays.

Null and empty texts have no paragraphs. Rows with the same doc_id and text count as one
document and stay alike. An empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .decontaminate import word_hashes
from .shared import Forest, components, doc_key, mixed, take_batches

MIN_WORDS, SHINGLE, NEAR, ROWS, MISS, LEAST_PIECE, BLOCK, SLICE = 20, 5, 0.8, 3, 0.001, 5, 256, 1 << 20
BASE, STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_END = np.array([chr(b) in ".!?" for b in range(256)])


def bands(near: float = NEAR, rows: int = ROWS, miss: float = MISS) -> int:
    """The least number of bands at which a pair of similarity near is missed with probability miss at most."""
    return math.ceil(math.log(miss) / math.log(1 - near**rows))


class Parsed:
    """The words, lines and pieces of the texts of an Arrow column."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.offsets = offsets = offsets - offsets[0]
        self.data, lower, word = data, _LOWER[data], ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        self.starts = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1]))) if len(data) else np.empty(0, np.int64)
        self.ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1 if len(data) else np.empty(0, np.int64)
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.hashes = word_hashes(lower, self.starts, self.ends, BASE)
        n = len(self.starts)
        line = np.cumsum(data == 10)[self.starts] if n else np.empty(0, np.int64)
        fresh = np.ones(n, bool)
        fresh[1:] = (self.doc[1:] != self.doc[:-1]) | (line[1:] != line[:-1])
        sentence = fresh.copy()
        sentence[1:] |= _END[data[self.ends[:-1] - 1]] if n else False
        at, to = self._spans(sentence)
        cut = fresh.copy()
        cut[at[1:][(to - at)[:-1] >= LEAST_PIECE]] = True
        cut |= self._inner_cuts(*self._spans(cut))
        self.lines, self.pieces = self._spans(fresh), self._spans(cut)
        # sums of the words' hashes by powers: the hash of any run of words
        powers = np.full(n, STEP, np.uint64)
        powers[:1] = 1
        self.back = np.full(n, pow(STEP, -1, 1 << 64), np.uint64)
        self.back[:1] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(self.back, out=self.back)
        self.sums = np.append(np.uint64(0), np.cumsum(mixed(self.hashes) * powers, dtype=np.uint64))

    def _inner_cuts(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words in the runs a to b - 1 at which the hash of two words is least among those less than LEAST_PIECE off."""
        n, near, most = len(self.hashes), LEAST_PIECE - 1, np.iinfo(np.uint64).max
        score = np.full(n + 2 * near, most)
        if n:
            at, whole = np.arange(n), b - a
            fit = (at - np.repeat(a, whole) >= LEAST_PIECE) & (np.repeat(b, whole) - at >= LEAST_PIECE)
            pair = mixed(mixed(self.hashes[1:]) + self.hashes[:-1] * np.uint64(STEP))
            score[near + 1 : near + n] = np.where(fit[1:], pair, most)
        own = score[near : near + n]
        out = own < most
        for d in range(1, near + 1):
            out &= (own <= score[near - d : near - d + n]) & (own <= score[near + d : near + d + n])
        tied = np.flatnonzero(out)
        close = np.append(np.diff(tied) < LEAST_PIECE, False)
        last = -LEAST_PIECE
        for at in tied[close | np.append(False, close[:-1])[: len(tied)]].tolist() if len(tied) else []:
            out[at] = at - last >= LEAST_PIECE  # repeated words: pieces are alike from wherever they're counted
            last = at if out[at] else last
        return out

    @staticmethod
    def _spans(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(first)
        return at, np.append(at[1:], len(first)) if len(at) else at

    def run_hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of the words a to b - 1 of each run."""
        return mixed((self.sums[b] - self.sums[a]) * self.back[a] + (b - a).astype(np.uint64))

    def shingles(self, a: int, b: int) -> np.ndarray:
        """The distinct shingles of a run of words, as hashes."""
        at = np.arange(a, max(a + 1, b - SHINGLE + 1))
        return np.unique(self.run_hash(at, np.minimum(at + SHINGLE, b)))

    def order(self, spans: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The place of each line or piece in its document."""
        doc = self.doc[spans[0]]
        return np.arange(len(doc)) - np.searchsorted(doc, doc)

    def characters(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Positions in bytes as positions in characters of the text."""
        lead = np.append(0, np.cumsum((self.data & 0xC0) != 0x80))
        return lead[at] - lead[self.offsets[doc]]

    def keys(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The band keys of each run of words of SHINGLE words or more."""
        count, n = bands(), b - a - SHINGLE + 1
        first = np.append(0, np.cumsum(n)[:-1])
        at = np.repeat(a - first, n) + np.arange(n.sum())
        base = self.run_hash(at, at + SHINGLE)
        out = np.empty((len(a), count), np.uint64)
        for k in range(count):
            key = np.full(len(a), k, np.uint64)
            for j in range(ROWS):
                salt = mixed(np.array([k * ROWS + j + 1], np.uint64))[0] | np.uint64(1)
                key = mixed(key ^ np.minimum.reduceat(base * salt, first)) * np.uint64(STEP)
            out[:, k] = mixed(key + np.uint64(k))
        return out


_UNITS = "doc_id long, th long, kind int, ord int, words int, start int, end int, pid long, keys array<long>"


def _units(batches):
    """A row for each paragraph (kind 0) and piece (kind 1)."""
    for batch in take_batches(batches, SLICE):  # the arrays of a slice are about sixty times as large
        p = Parsed(batch.column("text"))
        out = []
        for kind, spans, least in ((0, p.lines, MIN_WORDS), (1, p.pieces, LEAST_PIECE)):
            a, b = spans
            ok = b - a >= least
            place, a, b = p.order(spans)[ok], a[ok], b[ok]
            doc = p.doc[a]
            ends = [p.characters(x, doc) for x in (p.starts[a], p.ends[b - 1])] if len(a) else [a, a]
            pid = p.run_hash(a, b).view(np.int64)
            if kind == 0 and len(a):
                keys = p.keys(a, b)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            else:
                keys = pa.nulls(len(a), pa.list_(pa.int64()))
            ints = [pa.array(x.astype(np.int32)) for x in (np.full(len(a), kind), place, b - a, *ends)]
            take = pa.array(doc)
            out.append(pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("th").take(take), *ints, pa.array(pid), keys], [x.split()[0] for x in _UNITS.split(", ")]))
        yield from out


def _shingles(batches):
    """(pid, shingles) of the paragraphs whose places are in ords."""
    for batch in take_batches(batches, SLICE):  # the arrays of a slice are about sixty times as large
        p = Parsed(batch.column("text"))
        place, doc, pids, sets = p.order(p.lines), p.doc[p.lines[0]], [], []
        wanted = [set(x) for x in batch.column("ords").to_pylist()]
        for k, (a, b) in enumerate(zip(*(x.tolist() for x in p.lines), strict=True)):
            if place[k] in wanted[doc[k]]:
                pids.append(int(p.run_hash(np.array([a]), np.array([b])).view(np.int64)[0]))
                sets.append(p.shingles(a, b).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["pid", "shingles"])


def near(a: frozenset, b: frozenset, least: float = NEAR) -> bool:
    """Whether two sets have a Jaccard similarity of least or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _join_block(members: list[tuple[int, frozenset]], close: list[tuple[int, frozenset]]) -> list[tuple[int, int]]:
    """A spanning forest of the near pairs of members; pairs already joined, as those of close are, aren't compared."""
    groups: list[list[tuple[int, frozenset]]] = [close] if close else []
    out = []
    for pid, own in members:
        mine = [(pid, own)]
        rest = []
        for g in groups:
            hit = next((p for p, s in g if near(own, s)), None)
            if hit is None:
                rest.append(g)
            else:
                out.append((pid, hit))
                mine = g + mine
        groups = [*rest, mine]
    return out


def _verify(batches):
    """Rows sorted by key, a, b; each such group is a block."""
    key, members, joined, edges = None, [], [], Forest()
    for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):  # few paragraphs' shingles as objects at once
        sets, close = batch.column("shingles").to_pylist(), batch.column("close").to_pylist()
        for k, (this, pid) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in ("key", "a", "b")), strict=True), batch.column("pid").to_pylist(), strict=True)):
            if this != key:
                for e in _join_block(members, joined):
                    edges.join(*e)
                key, members, joined = this, [], []
            (joined if close[k] else members).append((pid, frozenset(sets[k])))
    for e in _join_block(members, joined):
        edges.join(*e)
    found = edges.edges()
    yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in found], pa.int64()), pa.array([e[1] for e in found], pa.int64())], ["u", "v"])


def paragraph_classes(rows: DataFrame, units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(pid, keep) of the paragraphs that have others like them; keep: doc_id, th and ord of the first."""
    spark = rows.sparkSession
    classes = save(units.where("kind = 0").groupBy("pid").agg(F.first("keys").alias("keys"), F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "ord")).alias("origin")), "paragraphs")
    keyed = classes.select("pid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = save(keyed.join(shared, "key"), "paragraph-keys")
    sets = members.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("pid").cast("decimal(38,0)")).alias("mark"))
    once = sets.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key")
    members = save(members.join(once, "key", "left_semi"), "paragraph-sets")
    where = members.select("pid").distinct().join(classes, "pid").groupBy("origin.doc_id", "origin.th").agg(F.collect_set("origin.ord").alias("ords"))
    where = where.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "ords")
    texts = rows.join(where, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))).select("text", "ords")
    shingles = save(texts.mapInArrow(_shingles, "pid long, shingles array<long>").dropDuplicates(["pid"]), "shingles")
    # a key of many: those near its first member are joined through that one, and meet only the others
    heads = save(members.where(F.col("n") > block).groupBy("key").agg(F.min("pid").alias("head")), "paragraph-heads")
    theirs = shingles.select(F.col("pid").alias("head"), F.col("shingles").alias("theirs"))
    both = F.size(F.array_intersect("shingles", "theirs"))
    alike = both >= NEAR * (F.size("shingles") + F.size("theirs") - both) - 1e-9
    stars = save(members.join(heads, "key").join(shingles, "pid").join(theirs, "head").select("key", "pid", "head", alike.alias("close")), "paragraph-stars")
    size = lambda flag: F.ceil(F.count_if(flag) / F.lit(block)).cast("int")
    cuts = save(stars.groupBy("key").agg(size(~F.col("close")).alias("ko"), size(F.col("close")).alias("kc")), "paragraph-cuts")
    one = F.lit(0)
    few = members.where(F.col("n") <= block).select("key", "pid", F.lit(False).alias("close"), one.alias("a"), one.alias("b"))
    own = lambda k: F.pmod(F.xxhash64("pid"), F.col(k)).cast("int")
    many = stars.join(cuts, "key").where("ko > 0").withColumn("chunk", F.when(F.col("close"), F.col("ko") + own("kc")).otherwise(own("ko")))
    last = F.when(F.col("close"), F.col("ko")).otherwise(F.col("ko") + F.col("kc")) - 1
    many = many.select("key", "pid", "close", "chunk", F.explode(F.sequence(F.lit(0), last)).alias("other"))
    many = many.select("key", "pid", "close", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"))
    blocks = few.union(many).join(shingles, "pid").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "pid")
    # a table of its own: in one stage with the thinning of edges each task would keep two Python workers
    found = save(blocks.mapInArrow(_verify, "u long, v long"), "paragraph-edges")
    roots = components(found.union(stars.where("close AND pid <> head").select("pid", "head"))).withColumnRenamed("node", "pid")
    rooted = save(classes.drop("keys").join(roots, "pid", "left").withColumn("root", F.coalesce("root", "pid")), "paragraph-roots")
    keep = rooted.groupBy("root").agg(F.min("origin").alias("keep"), F.sum("n").alias("total")).where("total > 1").drop("total")
    return save(rooted.join(keep, "root").select("pid", "keep"), "paragraph-keep")


_GONE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merge(batches):
    """Per document: which of its later units go, as merged spans, and where they stay."""
    for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):  # few documents' units as objects at once
        spans, keepers = [], []
        for units in batch.column("units").to_pylist():
            gone = [(u["start"], u["end"], u["keep_doc"]) for u in units if u["kind"] == 0]
            run: list[dict] = []
            for u in [*sorted((u for u in units if u["kind"] == 1), key=lambda u: u["ord"]), None]:
                if run and (u is None or u["ord"] != run[-1]["ord"] + 1):
                    if sum(x["words"] for x in run) >= MIN_WORDS:
                        gone += [(run[0]["start"], run[-1]["end"], x["keep_doc"]) for x in run]
                    run = []
                if u is not None:
                    run.append(u)
            merged: list[list[int]] = []
            for s, e, _ in sorted(gone, key=lambda g: g[:2]):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            spans.append([{"start": s, "end": e} for s, e in merged])
            keepers.append(sorted({k for _, _, k in gone if k is not None}))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(spans, _GONE), pa.array(keepers, pa.list_(pa.int64()))], ["doc_id", "th", "spans", "keepers"])


def repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, th, spans, keepers) for every row of docs (doc_id, text).

    spans: start and end, in characters, of what stands elsewhere and goes; keepers: the
    documents in which it stays. th is the text's hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("th"), "text")
    units = save(rows.mapInArrow(_units, _UNITS), "units")
    lines = units.where("kind = 0").join(paragraph_classes(rows, units, block), "pid").drop("pid", "keys")
    pieces = units.where("kind = 1").drop("keys")
    # the aggregates are tables of their own, so that Spark can split a piece with many places in the joins
    twice = save(pieces.groupBy("pid").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "pieces-twice")
    again = save(pieces.join(twice, "pid"), "pieces")
    first = save(again.groupBy("pid").agg(F.min(F.struct("doc_id", "th", "ord")).alias("keep")), "pieces-first")
    later = lines.unionByName(again.join(first, "pid").drop("pid")).where(~F.struct("doc_id", "th", "ord").eqNullSafe(F.col("keep")))
    unit = F.struct("kind", "ord", "words", "start", "end", F.col("keep.doc_id").alias("keep_doc"))
    gone = later.groupBy("doc_id", "th").agg(F.collect_set(unit).alias("units")).mapInArrow(_merge, "doc_id long, th long, spans array<struct<start: int, end: int>>, keepers array<long>")
    gone = gone.where("size(spans) > 0").withColumnsRenamed({"doc_id": "_id", "th": "_th"})
    out = rows.drop("text").join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    return out.select("doc_id", "th", F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")).alias("spans"), F.coalesce("keepers", F.array().cast("array<bigint>")).alias("keepers"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with those spans cut from text; no row goes."""
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)), F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_id"), doc_key(F.col("text")).alias("_th"))
    found = repeats(docs).where("size(spans) > 0").select(F.col("doc_id").alias("_gid"), F.col("th").alias("_gth"), F.col("spans").alias("_spans")).distinct()
    joined = kept.join(found, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left")
    walk = "aggregate(_spans, struct('' AS kept, 0 AS at), (x, s) -> struct(concat(x.kept, substring(_text, x.at + 1, s.start - x.at)) AS kept, s.end AS at), x -> concat(x.kept, substring(_text, x.at + 1)))"
    left = F.expr(f"CASE WHEN _spans IS NULL THEN _text ELSE {walk} END")
    return joined.select(*((left if c == "text" else F.col(f"_{k}")).alias(c) for k, c in enumerate(docs.columns)))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the spans that stand elsewhere and the documents where they stay."""
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cut = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", (F.size("spans") > 0).alias("repeats"), F.size("spans").cast("long").alias("n_spans"), cut.alias("n_removed_chars"), joined.alias("spans"), F.col("keepers").alias("kept_in"))
