"""Line dedup by winnowing over line hashes.

Lines end at "\\n"; blank ones are passed over and stay. Lines are equal if they are after
white space at their ends is dropped. A run is RUN = 2 or more consecutive lines of a
document, or a single line of LONG = 8 or more words, that also stands at an earlier
place (by doc_id, the text's hash and line number). Every line of such a later run goes;
the first place of a run stays whole, unless an earlier one covers it.

Of each RUN consecutive lines the one of least hash (the last of equal ones) is selected
as a fingerprint; a long line is one by itself. Only selected lines make rows, so a line
makes one at most and many make none. Two places where the same RUN lines stand select
the same line of them: a run of RUN lines or more is sure to share a fingerprint.
Positions are joined by fingerprint, and those whose fingerprint stands nowhere else are
done with. A match of the others is extended to both sides, over those neighbours that
chose the fingerprint: a position carries the hashes of its neighbourhood, as a hash of
each window of RUN lines that chose it, and matches where such a window has an earlier
place. Windows that match one after the other add up to the longest run. A fingerprint
or a window is only ever compared with its first place, so a line that stands everywhere
makes no pairs.

Null and empty texts stay as they are. Rows with the same doc_id and text count as one
document and stay alike. A document whose lines all go keeps its row with an empty text.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import save
from .shared import doc_key, mixed, take_batches

RUN, LONG = 2, 8
_ENDS = " \t\r\x0b\x0c"
_STEP = np.uint64(0xD1342543DE82EF95)


def selected(text: str | None, run: int = RUN, long: int = LONG) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(fingerprint, [(window's hash, first line, last line)]) of each selected line of a text."""
    if not text:
        return []
    lines = [(k, s) for k, x in enumerate(text.split("\n")) if (s := x.strip(_ENDS))]
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(errors="surrogatepass")) for _, s in lines], np.uint64)
    found: dict[int, list[tuple[int, int, int]]] = {}
    if (n := len(lines) - run + 1) > 0:
        least, chosen, keys = hashes[:n], np.arange(n), np.full(n, run, np.uint64)
        for k in range(run):
            part = hashes[k : k + n]
            later = part <= least
            least, chosen = np.where(later, part, least), np.where(later, np.arange(k, k + n), chosen)
            keys = mixed(keys + part) * _STEP
        for at, (pick, key) in enumerate(zip(chosen.tolist(), keys.tolist(), strict=True)):
            found.setdefault(pick, []).append((key, lines[at][0], lines[at + run - 1][0]))
    for at, (k, s) in enumerate(lines):
        if len(s) >= 2 * long - 1 and len(s.split()) >= long:
            found.setdefault(at, []).append((int(hashes[at]), k, k))
    return [(int(hashes[at]), own) for at, own in found.items()]


_MARKS = "doc_id long, th long, fp long, windows array<struct<key: long, first: long, last: long>>"


def _marks(run: int, long: int):
    def each(batches):
        for batch in take_batches(batches):
            found = [selected(t, run, long) for t in batch.column("text").to_pylist()]
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            prints = np.array([fp for f in found for fp, _ in f], np.uint64).view(np.int64)
            sizes = np.array([len(own) for f in found for _, own in f], np.int64)
            flat = np.array([w for f in found for _, own in f for w in own], np.uint64).reshape(-1, 3).view(np.int64)
            inner = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["key", "first", "last"])
            own = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), inner)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("th").take(rows), pa.array(prints), own], ["doc_id", "th", "fp", "windows"])

    return each


def repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, th, gone: [(first, last)]) of the documents of docs (doc_id, text) with later runs.

    th is the text's hash, see doc_key.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("text")).alias("th"), "text")
    marks = save(rows.mapInArrow(_marks(run, long), _MARKS), "lines")
    # the counts and origins are tables of their own, so that Spark can split a line with many places in the joins
    shared = save(marks.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "line-prints")
    matched = save(marks.join(shared, "fp").select("doc_id", "th", "fp", F.inline("windows")), "line-matches")
    origins = save(matched.groupBy("fp", "key").agg(F.min(F.struct("doc_id", "th", "first")).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n"), "line-origins")
    later = matched.join(origins, ["fp", "key"]).where(F.struct("doc_id", "th", "first") > F.col("origin"))
    return later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("gone"))


def _strip(batches):
    for batch in take_batches(batches, column="_text"):
        texts, counts, gone = batch.column("_text").to_pylist(), [], batch.column("_gone").to_pylist()
        for k, spans in enumerate(gone):
            drop = {n for s in spans or () for n in range(s["first"], s["last"] + 1)}
            lines = (texts[k] or "").split("\n")
            if drop:  # blank lines between those of a window go with it
                texts[k] = "\n".join(x for n, x in enumerate(lines) if n not in drop)
            counts.append((sum(bool(x.strip(_ENDS)) for x in lines), sum(bool(lines[n].strip(_ENDS)) for n in drop)))
        rest = [c for c in batch.schema.names if c not in ("_text", "_gone")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array([c[0] for c in counts], pa.int64()), pa.array([c[1] for c in counts], pa.int64())], [*rest, "_text", "_lines", "_removed"])


def _deduped(docs: DataFrame, run: int, long: int) -> DataFrame:
    """docs as _0, _1, ... and _text without later runs, _lines and _removed."""
    kept = docs.select(*(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns) if c != "text"), F.col("text").alias("_text"), F.col("doc_id").cast("long").alias("_id"), doc_key(F.col("text")).alias("_th"))
    gone = repeated_lines(docs, run, long).select(F.col("doc_id").alias("_gid"), F.col("th").alias("_gth"), F.col("gone").alias("_gone"))
    joined = kept.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_th") == F.col("_gth")), "left").drop("_id", "_th", "_gid", "_gth")
    base = [f"{f.name} {f.dataType.simpleString()}" for f in joined.schema if f.name not in ("_text", "_gone")]
    return joined.mapInArrow(_strip, ", ".join([*base, "_text string, _lines long, _removed long"]))


def dedup_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """docs with all later repeated runs removed from text; no row goes."""
    found = _deduped(docs, run, long)
    return found.select(*(F.col("_text" if c == "text" else f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of documents: its lines, those removed, and the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _deduped(docs, RUN, LONG).select(F.col("_0").alias("doc_id"), F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.col("_text").alias("text"))


#: The same rows by plain string comparison; the tables have no doc_id twice.
OP2_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
), lines AS (
  SELECT doc_id, k, line, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS s FROM raw
), solid AS (
  SELECT doc_id, k, s, lead(k) OVER w AS k2, lead(s) OVER w AS s2 FROM lines WHERE s <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), marks AS (
  SELECT doc_id, k AS a, k2 AS b, [s, s2] AS key FROM solid WHERE k2 IS NOT NULL
  UNION ALL
  SELECT doc_id, k, k, [s] FROM solid WHERE len(regexp_extract_all(s, '\S+')) >= 8
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, a) AS r FROM marks) WHERE r > 1
), gone AS (
  SELECT DISTINCT l.doc_id, l.k FROM lines l JOIN later USING (doc_id) WHERE l.k BETWEEN a AND b
)
SELECT d.doc_id, count(l.k) FILTER (WHERE l.s <> '') AS n_lines, count(l.k) FILTER (WHERE l.s <> '' AND g.k IS NOT NULL) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.k) FILTER (WHERE g.k IS NULL), CASE WHEN d.text IS NOT NULL THEN '' END) AS text
FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.k = l.k
GROUP BY d.doc_id, d.text
"""
