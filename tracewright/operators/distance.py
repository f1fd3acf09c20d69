"""How far apart two logs are, as bags of terms, compressed texts or lines."""

from __future__ import annotations

import bz2
import difflib
from array import array
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MESSAGE, ROW
from ..scratch import save
from .detect.items import tokens
from .windows import running_sum


#: Bytes of a text that bz2 compresses as one block at most, and the size of no bytes compressed.
PIECE, NOTHING = 900_000 - 19, 14


def _compressed(batches):
    """(log, piece, size) of each piece, given by its parts in order."""
    key, held, size = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([size + len(held.flush())], pa.int64())], ["log", "piece", "size"])

    for batch in batches:
        for log, piece, part in zip(batch.column("log").to_pylist(), batch.column("piece").to_pylist(), batch.column("part"), strict=True):
            if (log, piece) != key:
                if key is not None:
                    yield row()
                key, held, size = (log, piece), bz2.BZ2Compressor(), 0
            size += len(held.compress(part.as_buffer().to_pybytes()))
    if key is not None:
        yield row()


#: Lines of a log times lines of the other, and both together, up to which a part is one ndiff; how often a fixed line may stand.
MOST_DIFFED, MOST_TOGETHER, MOST_OFTEN = 4_000_000, 20_000, 64


def _parts(lines: DataFrame, fixed: DataFrame | None) -> DataFrame:
    """(log, i, h, part): 2k between the kth fixed pair and the next, 2k - 1 for the pair itself."""
    lines = lines.select("log", "i", "h")
    if fixed is None:
        return lines.withColumn("part", F.lit(0).cast("long"))
    made = []
    for log in "ab":
        marks = fixed.select(F.col(f"i{log}").alias("i"), F.lit(1).alias("_mark"))
        marked = save(lines.where(F.col("log") == log).join(marks, "i", "left").withColumn("_mark", F.coalesce("_mark", F.lit(0))), "diff-marked")
        made.append(running_sum(marked, F.col("_mark"), [F.col("i")], "_k").select("log", "i", "h", (2 * F.col("_k") - F.col("_mark")).alias("part")))
    return save(made[0].union(made[1]), "diff-in-parts")


def _fixed(parts: DataFrame) -> DataFrame:
    """(ia, ib): pairs of equal lines of a part, in the order of both logs."""
    own = parts.groupBy("part", "h").agg(F.count_if(F.col("log") == "a").alias("na"), F.count_if(F.col("log") == "b").alias("nb"))
    own = own.where((F.col("na") == F.col("nb")) & (F.col("na") <= MOST_OFTEN)).select("part", "h")
    nth = F.row_number().over(Window.partitionBy("part", "h", "log").orderBy("i"))
    rows = parts.join(own, ["part", "h"]).withColumn("nth", nth)
    pairs = rows.groupBy("part", "h", "nth").agg(F.min(F.when(F.col("log") == "a", F.col("i"))).alias("ia"), F.min(F.when(F.col("log") == "b", F.col("i"))).alias("ib"))
    return pairs.select("part", "ia", "ib").repartition("part").sortWithinPartitions("part", "ia").mapInArrow(_increasing, "ia long, ib long")


def _increasing(batches):
    """Of the pairs of each part, in the order of ia, the longest run whose ib grow."""

    def run(a, b):
        tops, at, before = array("q"), array("q"), array("q")  # tops: the least last ib of a run of each length
        for k, y in enumerate(b):
            n = bisect_left(tops, y)
            if n == len(tops):
                tops.append(y)
                at.append(k)
            else:
                tops[n], at[n] = y, k
            before.append(at[n - 1] if n else -1)
        chosen, k = array("q"), at[-1]
        while k >= 0:
            chosen.append(k)
            k = before[k]
        chosen.reverse()
        return pa.RecordBatch.from_arrays([pa.array([x[k] for k in chosen], pa.int64()) for x in (a, b)], ["ia", "ib"])

    part, a, b = None, array("q"), array("q")
    for batch in batches:
        for this, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "ia", "ib")), strict=True):
            if this != part:
                if a:
                    yield run(a, b)
                part, a, b = this, array("q"), array("q")
            a.append(x)
            b.append(y)
    if a:
        yield run(a, b)


def _ndiffs(batches):
    """(part, k, op, line) of the ndiff of each part."""

    def diff():
        rows = list(difflib.ndiff(held["a"], held["b"]))
        return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[2:] for r in rows])], ["part", "k", "op", "line"])

    part, held = None, None
    for batch in batches:
        for this, log, line in zip(*(batch.column(c).to_pylist() for c in ("part", "log", "line")), strict=True):
            if this != part:
                if held:
                    yield diff()
                part, held = this, {"a": [], "b": []}
            held[log].append(line)
    if held:
        yield diff()


class LogDistance:
    """Distances between field of df_train and of df_analyze; lists are joined by spaces first.

    vectorizer "count" weighs a term by its count, "tfidf" also by its smoothed inverse
    frequency in the two logs; jaccard and containment don't depend on it.
    """

    def __init__(self, df_train: DataFrame, df_analyze: DataFrame, field: str = MESSAGE, vectorizer: str = "count"):
        if vectorizer not in ("count", "tfidf"):
            raise ValueError(f"No vectorizer {vectorizer}")
        self.sides, self.vectorizer = [], vectorizer
        for df in (df_train, df_analyze):
            text = F.array_join(field, " ") if isinstance(df.schema[field].dataType, T.ArrayType) else F.col(field)
            self.sides.append(df.select(*([ROW] if ROW in df.columns else []), text.alias("text")))

    def shared_terms(self) -> DataFrame:
        """(term, a, b): how often each term is in either log."""
        a, b = (s.select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias(n)) for s, n in zip(self.sides, "ab", strict=True))
        return a.join(b, "term", "full_outer").na.fill(0, ["a", "b"])

    def measures(self) -> DataFrame:
        """One row: cosine, jaccard, containment; null where neither log has a term."""
        logs = (F.col("a") > 0).cast("int") + (F.col("b") > 0).cast("int")
        weight = F.ln(3 / (1 + logs)) + 1 if self.vectorizer == "tfidf" else F.lit(1.0)
        a, b = F.col("a") * weight, F.col("b") * weight
        both, one, other = F.count_if((a > 0) & (b > 0)), F.count_if(a > 0), F.count_if(b > 0)
        sums = self.shared_terms().agg(F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), both.alias("both"), one.alias("one"), other.alias("other"), F.count("*").alias("all"))
        least = F.least("one", "other")
        cosine = 1 - F.when(F.col("aa") * F.col("bb") > 0, F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(0.0)
        contained = 1 - F.when(least > 0, F.col("both") / least).otherwise(0.0)
        known = F.col("all") > 0
        return sums.select(F.when(known, cosine).alias("cosine"), F.when(known, 1 - F.col("both") / F.col("all")).alias("jaccard"), F.when(known, contained).alias("containment"))

    def cosine(self) -> DataFrame:
        return self.measures().select("cosine")

    def jaccard(self) -> DataFrame:
        return self.measures().select("jaccard")

    def containment(self) -> DataFrame:
        return self.measures().select("containment")

    def compression(self) -> DataFrame:
        """One row: the normalised compression distance of the two whole texts by bz2.

        bz2 looks at no more than a block at once. Texts are cut at every PIECE bytes and the
        pieces compressed apart, as pbzip2 does, so a task holds one; what fits a piece is
        compressed as one. The pieces of the first text are also the first of both together.
        """
        data = F.concat("text", F.when(~F.col("_last"), " ").otherwise("")).cast("binary")
        parts, whole = [], []
        for side, name in zip(self.sides, "ab", strict=True):
            rows = side.where("text IS NOT NULL").withColumn("_n", F.octet_length("text").cast("long") + 1)
            total = rows.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
            ended = running_sum(rows, F.col("_n"), [F.col(ROW), F.col("text")], "_end").withColumn("_last", F.col("_end") == total)
            parts.append(ended.select(F.lit(name).alias("log"), (F.col("_end") - F.col("_n")).alias("start"), data.alias("data")))
            whole.append(max(total - 1, 0))
        full = whole[0] // PIECE
        both = parts[0].union(parts[1].withColumn("start", F.col("start") + whole[0])).withColumn("log", F.lit("ab"))
        first, last = F.floor(F.col("start") / PIECE), F.floor((F.col("start") + F.octet_length("data") - 1) / PIECE)
        cut = parts[0].union(parts[1]).union(both).where("octet_length(data) > 0").select("log", "start", "data", F.explode(F.sequence(first, last)).alias("piece"))
        cut = cut.where(~((F.col("log") == "ab") & (F.col("piece") < full)))
        at = F.greatest(F.col("piece") * PIECE, "start")
        size = F.least((F.col("piece") + 1) * PIECE, F.col("start") + F.octet_length("data")) - at
        cut = cut.select("log", "piece", at.alias("at"), F.substr("data", (at - F.col("start") + 1).cast("int"), size.cast("int")).alias("part"))
        sizes = cut.repartition("log", "piece").sortWithinPartitions("log", "piece", "at").mapInArrow(_compressed, "log string, piece long, size long")
        of = lambda which: F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(NOTHING))
        shared = (F.col("log") == "ab") | ((F.col("log") == "a") & (F.col("piece") < full))
        made = sizes.agg(of(F.col("log") == "a").alias("x"), of(F.col("log") == "b").alias("y"), of(shared).alias("xy"))
        return made.select(((F.col("xy") - F.least("x", "y")) / F.greatest("x", "y")).alias("compression"))

    def diff_lines(self) -> DataFrame:
        """(pos, op, line): the line difference of the two logs, by parts.

        Lines that both logs have equally often, at most MOST_OFTEN times, are paired first with
        first, second with second; the longest run of pairs in the order of both logs is fixed.
        That is done again inside what lies between, as long as it finds something and a part
        is over MOST_DIFFED. Parts within it get difflib's ndiff, so small logs get it as a whole;
        in others the first log's lines go out and the second's come in. The choice of a run
        takes one task, with some numbers for each pair; texts never meet in one.
        """
        lines = save(self._lines(), "diff-lines")
        fixed = None
        while True:
            parts = _parts(lines, fixed)
            counts = parts.groupBy("part").agg(F.count_if(F.col("log") == "a").alias("na"), F.count_if(F.col("log") == "b").alias("nb"))
            whole = save(counts.withColumn("small", (F.col("na") > 0) & (F.col("nb") > 0) & (F.col("na") * F.col("nb") <= MOST_DIFFED) & (F.col("na") + F.col("nb") <= MOST_TOGETHER)), "diff-parts")
            open_ = parts.join(whole.where("NOT small AND na > 0 AND nb > 0").select("part"), "part")
            found = save(_fixed(open_), "diff-fixed")
            if found.isEmpty():
                break
            fixed = found if fixed is None else save(fixed.union(found), "diff-fixed")
        sized = parts.join(whole, "part")
        text = lines.select("log", "i", "line")
        small = sized.where("small").select("log", "i", "part").join(text, ["log", "i"])
        diffed = small.repartition("part").sortWithinPartitions("part", "log", "i").mapInArrow(_ndiffs, "part long, k long, op string, line string")
        first = parts.groupBy("part", "log").agg(F.min("i").alias("_first"))
        k = F.col("i") - F.col("_first") + F.when(F.col("log") == "b", F.col("na")).otherwise(F.lit(0))
        plain = sized.where("NOT small").join(first, ["part", "log"]).select("part", k.alias("k"), "log", "i").join(text, ["log", "i"])
        rows = save(diffed.union(plain.select("part", "k", F.when(F.col("log") == "a", "-").otherwise("+").alias("op"), "line")), "diff")
        sizes = save(rows.groupBy("part").agg(F.count("*").alias("n")), "diff-sizes")
        ends = running_sum(sizes, F.col("n"), [F.col("part")], "_end").select("part", (F.col("_end") - F.col("n")).alias("_before"))
        return rows.join(ends, "part").select((F.col("_before") + F.col("k")).alias("pos"), "op", "line")

    def _lines(self) -> DataFrame:
        """(log, i, h, line) of the numbered lines of both logs, h their hash; a log without rows has one empty line."""
        made = []
        for side, name in zip(self.sides, "ab", strict=True):
            rows = side.where("text IS NOT NULL").withColumn("_split", F.split("text", "\n"))
            ended = running_sum(rows, F.size("_split").cast("long"), [F.col(ROW), F.col("text")], "_end")
            line = ended.select((F.col("_end") - F.size("_split")).alias("_start"), F.posexplode("_split").alias("_p", "line"))
            made.append(line.select(F.lit(name).alias("log"), (F.col("_start") + F.col("_p")).alias("i"), F.xxhash64("line").alias("h"), "line"))
            if rows.isEmpty():
                made[-1] = side.sparkSession.createDataFrame([(name, 0, "")], "log string, i long, line string").select("log", "i", F.xxhash64("line").alias("h"), "line")
        return made[0].union(made[1])

    def diff_counts(self) -> DataFrame:
        """(line, a, b) of lines that one log has more often than the other, whatever their order; at any size."""
        a, b = (s.groupBy(F.col("text").alias("line")).agg(F.count("*").alias(n)) for s, n in zip(self.sides, "ab", strict=True))
        return a.join(b, "line", "full_outer").na.fill(0, ["a", "b"]).where("a <> b")

    def measure_all_distances(self) -> DataFrame:
        """One row: the four distances and the rows of either log."""
        rows = [s.agg(F.count("*").alias(n)) for s, n in zip(self.sides, ("rows_train", "rows_analyze"), strict=True)]
        out = self.measures().crossJoin(self.compression()).crossJoin(rows[0]).crossJoin(rows[1])
        known = F.col("cosine").isNotNull()
        return out.withColumn("compression", F.when(known, F.col("compression")))
