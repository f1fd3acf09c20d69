"""Benchmark decontamination with an FM-index of each training shard.

Words are runs of ASCII digits, letters (A-Z in lower case) and characters beyond ASCII.
A test phrase is WINDOW consecutive words of a benchmark item, or all its words where it
has fewer. Texts of about SHARD_BYTES are a shard. Its words become numbers, those of the
phrases or 0. Runs of phrase words that are shorter than every phrase can hold none and
are left out; the rest gets a suffix array, its Burrows-Wheeler transform and a wavelet
matrix. All phrases are searched backwards at once by ranks in that matrix; where they
occur follows from suffix positions sampled at every SAMPLE-th word. Words are compared
as 64-bit hashes first, and what an occurrence covers is compared letter by letter then.

The phrases come to the driver and to the tasks in blocks of at most BLOCK_WORDS words,
with a pass over the texts for each, so their number is not bounded; after every CHAIN
passes the texts are saved with what was found. The texts are never shuffled. Null and empty texts have no words, no hits and stay as they are; an item with
a null id is searched and its words are hits, but it isn't listed. An empty table gives
an empty result; repeated rows are alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .shared import received, ship, take_batches

WINDOW, SHARD_BYTES, SAMPLE, BLOCK_WORDS, CHAIN = 10, 8 << 20, 8, 1 << 20, 2
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IS_WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[str]:
    """The words of a text."""
    return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if text else []


def word_hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash modulo 2^64 of each word lower[start:end]."""
    out, inverse = np.empty(len(starts), np.uint64), np.uint64(pow(base, -1, 1 << 64))
    at = 0
    while at < len(starts):  # by about 1 MB
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + (1 << 20))))
        low, span = starts[at], int(ends[to - 1] - starts[at])
        powers = np.full(span, base, np.uint64)
        powers[0] = 1
        np.cumprod(powers, out=powers)
        sums = np.zeros(span + 1, np.uint64)
        np.cumsum((lower[low : low + span].astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        back = np.full(span, inverse, np.uint64)
        back[0] = 1
        np.cumprod(back, out=back)
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * back[a]
        at = to
    return out


class Phrases:
    """A block of test phrases: their words' hashes and numbers, and the items they are from."""

    def __init__(self, items: list[tuple[str | None, list[str]]], window: int):
        self.items: list[str | None] = [i for i, _ in items]
        found: dict[tuple[str, ...], set[int]] = {}
        for k, (_, own) in enumerate(items):
            for at in range(max(1, len(own) - window + 1)):
                found.setdefault(tuple(own[at : at + window]), set()).add(k)
        self.vocabulary = [w.encode() for w in sorted({w for p in found for w in p})]
        number = {w: k + 1 for k, w in enumerate(self.vocabulary)}
        by_length: dict[int, list] = {}
        for phrase, own in found.items():
            by_length.setdefault(len(phrase), []).append(([number[w.encode()] for w in phrase], sorted(own)))
        self.groups = [(n, np.array([p for p, _ in g], np.int64), [own for _, own in g]) for n, g in sorted(by_length.items())]
        self.least = min(by_length)
        sizes = np.array([len(w) for w in self.vocabulary])
        ends = np.cumsum(sizes + 1) - 1
        joined, self.base = np.frombuffer(b" ".join(self.vocabulary), np.uint8), 0x9E3779B97F4A7C15
        while True:
            hashes = word_hashes(joined, ends - sizes, ends, self.base)
            order = np.argsort(hashes)
            if len(np.unique(hashes)) == len(hashes):
                break
            self.base += 2  # two words of the vocabulary must not share a hash
        self.hashes, self.numbers = hashes[order], order + 1
        self.letters, self.begins, self.sizes = joined, ends - sizes, sizes
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, 0 if it is in no phrase."""
        out = np.zeros(len(hashes), np.int64)
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        out[at] = np.where(self.hashes[place] == hashes[at], self.numbers[place], 0)
        return out

    def same(self, numbers: np.ndarray, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each word lower[start:end] has the letters of the word with its number."""
        out = self.sizes[numbers - 1] == ends - starts
        at, sizes = np.flatnonzero(out), (ends - starts)[out]
        if len(at):
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            equal = lower[np.repeat(starts[at], sizes) + inside] == self.letters[np.repeat(self.begins[numbers[at] - 1], sizes) + inside]
            out[at] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        return out


class FMIndex:
    """Backward search and location in a sequence of numbers; 0 separates."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        text = np.append(symbols + 1, 0)  # an end that is least and alone
        n = len(text)
        rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        while True:
            later = np.full(n, -1, np.int64)
            later[: max(0, n - step)] = rank[step:]
            key = rank * (n + 1) + later + 1
            order = np.argsort(key, kind="stable")
            fresh = np.empty(n, np.int64)
            fresh[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1]))
            rank = fresh
            if rank[order[-1]] == n - 1:
                break
            step *= 2
        self.last = text[order - 1]
        self.before = np.append(0, np.cumsum(np.bincount(text)))
        self.marked = order % sample == 0
        self.nth_mark, self.sampled = np.cumsum(self.marked) - 1, order[self.marked]
        self.levels, row = [], self.last
        for bit in reversed(range(max(1, int(text.max()).bit_length()))):
            ones = (row >> bit) & 1
            sums = np.append(0, np.cumsum(ones)).astype(np.int32)
            self.levels.append((bit, sums, n - int(sums[-1])))
            row = np.concatenate([row[ones == 0], row[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first upto places of the transform."""
        low, high = np.zeros_like(upto), upto
        for bit, sums, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            low = np.where(one, zeros + sums[low], low - sums[low])
            high = np.where(one, zeros + sums[high], high - sums[high])
        return high - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence of the rows of phrases."""
        which = np.flatnonzero((phrases + 1 < len(self.before) - 1).all(1))
        low, high = np.zeros(len(which), np.int64), np.full(len(which), len(self.last), np.int64)
        for column in reversed(range(phrases.shape[1])):
            symbol = phrases[which, column] + 1
            low, high = self.before[symbol] + self.rank(symbol, low), self.before[symbol] + self.rank(symbol, high)
            left = low < high
            which, low, high = which[left], low[left], high[left]
        count = high - low
        rows = np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        return np.repeat(which, count), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text position of each row: back by single words to the next sampled one."""
        out, walking, steps, rows = np.empty(len(rows), np.int64), np.arange(len(rows)), 0, rows.copy()
        while len(walking):
            here = self.marked[rows]
            out[walking[here]] = self.sampled[self.nth_mark[rows[here]]] + steps
            walking, rows = walking[~here], rows[~here]
            symbol = self.last[rows]
            rows, steps = self.before[symbol] + self.rank(symbol, rows), steps + 1
        return out


def scan_shard(column: pa.Array, phrases: Phrases) -> list[tuple[int, list[list[int]], list[str]]]:
    """(words, hit spans [first word, last word + 1, first character, last character + 1], items) of each text."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = [(0, [], []) for _ in range(len(column))]
    if not len(data):
        return out
    lower, word = _LOWER[data], _IS_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (edge[:-1] | ~np.append(False, word[:-1])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.append(word[1:], False))) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    total = np.bincount(doc, minlength=len(column))
    out = [(n, [], []) for n in total.tolist()]
    symbols = phrases.of(word_hashes(lower, starts, ends, phrases.base))
    # runs of phrase words within a text that are long enough for a phrase
    known = symbols > 0
    opens = np.flatnonzero(known & (np.append(True, doc[1:] != doc[:-1]) | ~np.append(False, known[:-1])))
    closes = np.flatnonzero(known & (np.append(doc[1:] != doc[:-1], True) | ~np.append(known[1:], False))) + 1
    wide = closes - opens >= phrases.least
    opens, closes = opens[wide], closes[wide]
    if not len(opens):
        return out
    sizes = closes - opens + 1  # with a separator
    place = np.repeat(opens - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
    kept = np.zeros(len(place), np.int64)
    inside = np.ones(len(place), bool)
    inside[np.cumsum(sizes) - 1] = False
    kept[inside] = symbols[place[inside]]
    index, firsts, sizes, whose, base = FMIndex(kept), [], [], [], 0
    for n, rows, _ in phrases.groups:
        which, at = index.search(rows)
        firsts.append(place[at])
        sizes.append(np.full(len(at), n, np.int64))
        whose.append(which + base)
        base += len(rows)
    first, size, phrase = np.concatenate(firsts), np.concatenate(sizes), np.concatenate(whose)
    # the words of all occurrences, letter by letter
    at = np.flatnonzero(_covered(first, size, len(starts)))
    wrong = np.zeros(len(starts) + 1, np.int64)
    wrong[at + 1] = ~phrases.same(symbols[at], lower, starts[at], ends[at])
    wrong = np.cumsum(wrong)
    true = wrong[first + size] == wrong[first]
    first, size, phrase = first[true], size[true], phrase[true]
    at = np.flatnonzero(_covered(first, size, len(starts)))
    begins = np.searchsorted(doc, np.arange(len(column)))
    lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    opens = at[np.append(True, (np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]))] if len(at) else at
    closes = at[np.append((np.diff(at) > 1) | (doc[at[1:]] != doc[at[:-1]]), True)] + 1 if len(at) else at
    own = doc[opens]
    chars = [lead[x] - lead[offsets[own]] for x in (starts[opens], ends[closes - 1])]
    for k, *span in zip(own.tolist(), (opens - begins[own]).tolist(), (closes - begins[own]).tolist(), *(c.tolist() for c in chars), strict=True):
        out[k][1].append(span)
    # the different phrases of each text
    items: dict[int, set[str]] = {}
    owners = [o for _, _, group in phrases.groups for o in group]
    for k, p in np.unique(np.column_stack([doc[first], phrase]), axis=0).tolist():
        items.setdefault(k, set()).update(phrases.items[i] for i in owners[p])
    for k, own_items in items.items():
        out[k] = (out[k][0], out[k][1], sorted(own_items - {None}))
    return out


def _covered(first: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the runs."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, first + size, -1)
    return np.cumsum(edges[:-1]) > 0


def merge(spans: list[list[int]]) -> list[list[int]]:
    """Spans whose words overlap or touch become one."""
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return out


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """The phrases in blocks of about block_words words."""
    block, size = [], 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        own = words(text)
        if own:
            block.append((item, own))
            size += len(own)
            if size >= block_words:
                yield Phrases(block, window)
                block, size = [], 0
    if block:
        yield Phrases(block, window)


def _pass(shared, n_before: int):
    """A pass over the texts; the last three columns are what earlier passes found, if there were any."""

    def run(batches):
        phrases = received(shared) if shared else None
        for batch in take_batches(batches, SHARD_BYTES, "_text"):
            texts = batch.column("_text")
            found = scan_shard(texts, phrases) if phrases else [(len(words(t)), [], []) for t in texts.to_pylist()]
            if n_before:
                old_spans, old_items = batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
                found = [(n, merge(spans + [list(s.values()) for s in a]), sorted({*items, *b})) for (n, spans, items), a, b in zip(found, old_spans, old_items, strict=True)]
            spans = pa.array([[dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in spans] for _, spans, _ in found], _SPANS)
            columns = [pa.array([f[0] for f in found], pa.int64()), spans, pa.array([f[2] for f in found], pa.list_(pa.string()))]
            rest = [c for c in batch.schema.names if c not in ("_n", "_spans", "_items")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + columns, [*rest, "_n", "_spans", "_items"])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs as columns _0, _1, ... in their order, but the text as _text, and _n words, _spans of hits, _items."""
    kept = [F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != "text"]
    now = docs.select(*kept, F.col("text").alias("_text"))
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in now.schema)
    schema = base + ", _n long, _spans array<struct<first: long, last: long, start: long, end: long>>, _items array<string>"
    passes = 0
    for phrases in _blocks(benchmark, window, block_words):
        if passes and not passes % CHAIN:  # a task holds the phrases of CHAIN passes at most
            now = save(now, "scanned")
        now, passes = now.mapInArrow(_pass(ship(docs.sparkSession, phrases), passes), schema), passes + 1
    return now if passes else now.mapInArrow(_pass(None, 0), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the characters of all hit spans removed from text; no row goes."""
    found = scan(docs, benchmark)
    cleaned = F.expr(
        "aggregate(_spans, struct('' AS kept, 0L AS at), (x, s) -> struct(concat(x.kept, substring(_text, int(x.at) + 1, int(s.start - x.at))) AS kept, s.end AS at),"
        " x -> concat(x.kept, substring(_text, int(x.at) + 1)))"
    )
    return found.select(*(cleaned.alias(c) if c == "text" else F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op3_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with its words, hit words and the items found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        F.col("_0").alias("doc_id"), F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


#: The same rows by joining all windows as strings.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT item, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
    SELECT doc_id, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) AS i FROM docs, (SELECT DISTINCT n FROM phrases))
), hits AS (
  SELECT doc_id, item, i, n FROM windows JOIN phrases USING (n, phrase)
), words AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
