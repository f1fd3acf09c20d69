"""Packing of token sequences, shortest pack first over the histogram of lengths.

A document is the ids of its text and then id 0. It is cut into pieces of at most
``most`` ids; only the last one may be shorter. Pieces are counted by length, and the
counts alone (at most ``most`` numbers) go to the driver. There the lengths are placed
longest first, each into the pack that is shortest so far among those with room; packs
with the same content are one pattern with a count. At the end every piece of a length
takes, by its rank among the pieces of that length, a place in a pattern.

Null and empty texts are the id 0 alone. Rows that agree in everything are packed once
each. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import base64
import re
import sys
import types
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .shared import number_rows, take_batches

#: Entries of a worker's table of words and their ids, about 150 bytes each.
MOST_WORDS = 400_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The tokenizer's own pattern, for texts of ASCII and Latin letters alone.
_PARTS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_OTHER = re.compile(rf"[^\x00-\x7f{_LETTERS}]")
_CUT = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


class _Words(dict):
    """The ids of a word as bytes; it keeps the first MOST_WORDS of them."""

    def __missing__(self, word):
        ids = np.array(self.encode(word), "<u4").tobytes()
        if len(self) < MOST_WORDS:
            self[word] = ids
        return ids


class Tokens:
    """Ids of texts by a byte-level BPE, as little-endian unsigned 32-bit numbers.

    vocabulary is the file for the library tokenizers and ranks the same vocabulary for
    tiktoken, which is quicker and gives the same ids (tests hold them together). A text
    with a special token's string goes to tokenizers. Words are kept with their ids, for
    all tasks of a worker.
    """

    def __init__(self, vocabulary: str, ranks: str):
        self.vocabulary = vocabulary
        kept = sys.modules.setdefault("_tracewright_kept", types.ModuleType("_tracewright_kept")).__dict__
        if ranks not in kept:
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
            words = _Words()
            words.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
            kept[ranks] = words
        self.words, self.kept = kept[ranks], kept

    def special(self, text: str) -> bytes:
        if self.vocabulary not in self.kept:
            from tokenizers import Tokenizer

            self.kept[self.vocabulary] = Tokenizer.from_file(self.vocabulary)
        return np.array(self.kept[self.vocabulary].encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if "<|" in text:
            return self.special(text)
        if _OTHER.search(text):
            return np.array(self.words.encode(text), "<u4").tobytes()
        if len(text) < 1 << 20:
            return b"".join(map(self.words.__getitem__, _PARTS.findall(text)))
        out, at = [], 0
        while at < len(text):  # a very long text never is a list of words at once
            cut = _CUT.search(text, at + (1 << 20))
            end = cut.start() if cut else len(text)
            out.append(b"".join(map(self.words.__getitem__, _PARTS.findall(text, at, end))))
            at = end
        return b"".join(out)


def _pieces(vocabulary: str, ranks: str, most: int, with_ids: bool):
    def run(batches):
        tokens = Tokens(vocabulary, ranks)
        for batch in take_batches(batches):
            docs, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = tokens(text or "") + bytes(4)
                for at in range(0, len(ids), 4 * most):
                    part = ids[at : at + 4 * most]
                    docs.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(len(ids) // 4)
                    if with_ids:
                        parts.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(docs, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def plan(counts: dict[int, int], most: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, how many packs) that hold counts[length] pieces of each length."""
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces = np.zeros(most + 1, bool)  # those that open_ has packs for

    def put(space: int, count: int, pattern: tuple[int, ...]) -> None:
        open_.setdefault(space, []).append((count, pattern))
        spaces[space] = True

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = int(most - np.argmax(spaces[::-1])) if spaces[length:].any() else -1
            if room < length:  # no pack has room: new ones, each filled as far as this length goes
                each = most // length
                if left >= each:
                    put(most - each * length, left // each, (length,) * each)
                if left % each:
                    put(most - (left % each) * length, 1, (length,) * (left % each))
                break
            count, pattern = open_[room].pop()
            if not open_[room]:
                spaces[room] = False
            placed = min(count, left)
            if count > placed:
                put(room, count - placed, pattern)
            put(room - length, placed, (*pattern, length))
            left -= placed
    return sorted(((p, c) for group in open_.values() for c, p in group), reverse=True)


def default_files() -> tuple[str, str]:
    """The 50k byte-level vocabulary, for tokenizers and as ranks."""
    from public_tokenizers import path

    return path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken")


def pack(docs: DataFrame, most: int = 1024, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of docs (doc_id, text) with its sequence_id and offset.

    With with_ids also the piece's ids.
    """
    vocabulary, ranks = files or default_files()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = save(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces(vocabulary, ranks, most, with_ids), schema), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    packs = plan(counts, most)
    width = Counter()  # of a length's places, about: so many ranks make a bucket
    for pattern, _ in packs:
        width.update(pattern)
    width = {length: max(1, counts[length] // n) for length, n in width.items()}
    places, filled, first = [], {}, 0
    for pattern, count in packs:
        at = 0
        for length in pattern:
            low = filled.get(length, 0)
            filled[length] = low + count
            places += [(length, b, low, low + count, first - low, at) for b in range(low // width[length], (low + count - 1) // width[length] + 1)]
            at += length
        first += count
    table = docs.sparkSession.createDataFrame(places, "length long, bucket long, low long, high long, shift long, offset long")
    ranked = number_rows(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "rank")
    # places follow from the counts alone: a few for each of at most `most` lengths. A place lies
    # in the buckets of its ranks, three for each on average at most, so a piece meets few others
    widths = docs.sparkSession.createDataFrame(list(width.items()), "length long, width long")
    bucketed = ranked.join(F.broadcast(widths), "length").withColumn("bucket", F.floor(F.col("rank") / F.col("width")))
    joined = bucketed.join(F.broadcast(table) if len(places) < 100_000 else table, ["length", "bucket"]).where("rank >= low AND rank < high")
    return joined.select(*schema.replace(",", "").split()[::2], (F.col("shift") + F.col("rank")).alias("sequence_id"), "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """All of documents in sequences of at most 1024 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
