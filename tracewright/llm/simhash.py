"""SimHash near-dedup by multi-index hashing.

A text's fingerprint has 64 bits. Two fingerprints link if they differ in at most
MOST_BITS = 4. The bits are cut into three segments with radii 1, 1 and 0. If two
fingerprints were at distance 2, 2 and 1 or more in them, they would differ in 5 bits
or more, so every link agrees in a segment up to its radius. Each fingerprint stands in
a table of each segment under its own bits; it looks there under all keys of the small
Hamming ball about its bits, and what it finds is held against the whole distance.

Equal fingerprints are merged before. A key that holds over CROWD fingerprints makes no
pairs: its members, on both sides, link through the centres of their balls of radius 2.
Two words are within 4 bits exactly if those balls meet, so that way loses and adds
nothing, and its rows are in proportion to the members.

Null and empty texts have fingerprint 0 and link like any other. Rows with the same
doc_id and text are alike. An empty table gives an empty result. Further columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .shared import components, doc_key, take_batches

WORDS, SEED, MOST_BITS = 4, 42, 4
#: (first bit, bits, radius) of the segments.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
CROWD = 256
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_VALUES = (np.arange(256)[:, None] >> np.arange(8)) & 1


def _blocks(data: bytes, most: int = 1 << 20):
    """Parts of data cut at white space, so that a very long text never is a list of words at once."""
    at = 0
    while len(data) - at > most and (cut := _SPACE.search(data, at + most)):
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:]


def fingerprint(text: str | bytes | None, words: int = WORDS) -> int:
    """The unsigned fingerprint of a text; 0 if it has no words."""
    data = b"" if text is None else text.encode() if isinstance(text, str) else text
    ones, total, rest, digest = np.zeros((8, 8), np.int64), 0, [], xxhash.xxh64_intdigest
    for block in _blocks(data.translate(LOWER)):
        rest += block.split()
        if (n := len(rest) - words + 1) < 1:
            continue
        joined = b" ".join(rest)
        ends = np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)) + 1)
        starts = [0, *ends[: n - 1].tolist()]
        hashes = np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)], np.uint64, n)
        columns = hashes.view(np.uint8).reshape(n, 8)
        ones += np.stack([np.bincount(columns[:, j], minlength=256) for j in range(8)]) @ _VALUES
        total += n
        rest = rest[n:]
    if not total:
        return digest(b" ".join(rest), SEED) if rest else 0
    return int(np.packbits((2 * ones > total).ravel(), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in take_batches(batches):
        made = np.array([fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in batch.column("text").cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(made.view(np.int64))], ["doc_id", "th", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th: the text's hash, fp: the fingerprint as a signed long) for every row."""
    return docs.select(F.col("doc_id").cast("long"), doc_key(F.col("text")).alias("th"), "text").mapInArrow(_fingerprints, "doc_id long, th long, fp long")


def _masks(first: int, bits: int) -> list[int]:
    """The single bits of a segment, as signed longs."""
    return [int(np.int64(np.uint64(1 << b))) for b in range(first, first + bits)]


def _balls(batches):
    """Each fp with every centre within 2 bits of it."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    masks = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    for batch in batches:
        found = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(found), 64):
            part = found[at : at + 64]
            centres = (part.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(masks))), pa.array(centres)], ["fp", "centre"])


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (fp) that connect whatever is within MOST_BITS.

    Outside crowded keys these are all links; in crowded ones as many as connect them.
    """
    own, asked = [], []
    for k, (first, bits, radius) in enumerate(SEGMENTS):
        mask = int(np.int64(np.uint64(((1 << bits) - 1) << first)))
        key = F.col("fp").bitwiseAND(F.lit(mask))
        own.append(F.struct(F.lit(k).alias("segment"), key.alias("key")))
        if radius:  # of two keys one bit apart, the one without that bit asks
            asked += [F.when(F.col("fp").bitwiseAND(F.lit(m)) == 0, F.struct(F.lit(k).alias("segment"), key.bitwiseXOR(F.lit(m)).alias("key"))) for m in _masks(first, bits)]
    explode = lambda keys: prints.select("fp", F.inline(F.filter(F.array(*keys), lambda x: x.isNotNull())))
    table = explode(own)
    crowds = table.groupBy("segment", "key").count().where(F.col("count") > crowd).select("segment", "key", F.lit(True).alias("crowded"))
    table = save(table.join(crowds, ["segment", "key"], "left"), "simhash-table")
    asks = explode(asked)
    theirs = table.select(F.col("fp").alias("other"), "segment", "key", "crowded")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= MOST_BITS
    sparse = theirs.where("crowded IS NULL")
    # Spark's estimates leave out what explode and _balls multiply, so it would broadcast these tables through the driver
    sparse = sparse.hint("merge")
    same = table.where("crowded IS NULL").select("fp", "segment", "key").join(sparse, ["segment", "key"]).where((F.col("fp") < F.col("other")) & near)
    flip = asks.join(sparse, ["segment", "key"]).where(near)
    pairs = same.select("fp", "other").union(flip.select("fp", "other")).select(F.col("fp").alias("u"), F.col("other").alias("v"))
    dense = table.where("crowded")
    full = dense.select("segment", "key").distinct()
    members = save(dense.select("fp").union(asks.join(full, ["segment", "key"], "left_semi").select("fp")).distinct(), "simhash-crowded")
    centres = members.repartition("fp").mapInArrow(_balls, "fp long, centre long")
    stars = centres.groupBy("centre").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    return pairs.union(centres.join(stars.hint("merge"), "centre").where("fp != v").select(F.col("fp").alias("u"), "v"))


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for every row of docs (doc_id, text).

    root is the least fingerprint that links reach, and component_id the least doc_id,
    its own included.
    """
    prints = save(fingerprints(docs), "simhash")
    lows = save(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-distinct")
    roots = components(links(lows.select("fp"), crowd)).withColumnRenamed("node", "fp")
    classed = save(lows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-classes")
    named = classed.join(classed.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """The row of least doc_id, then text hash, of each group of near copies; of repeated rows one."""
    rows = near_duplicates(docs).groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("f")).select(F.col("f.doc_id").alias("_first"), F.col("f.th").alias("_hash"), F.col("f.n").alias("_rows"))
    docs_ = docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)), F.col("doc_id").cast("long").alias("_id"), doc_key(F.col("text")).alias("_th"))
    kept = docs_.join(first, F.col("_id").eqNullSafe(F.col("_first")) & (F.col("_th") == F.col("_hash")))
    # only the few rows that agree in doc_id and text are shuffled for that
    one = kept.where("_rows = 1").union(kept.where("_rows > 1").dropDuplicates(["_id", "_th"]))
    return one.select(*(F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its fingerprint in 16 hexadecimal digits and its component."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
