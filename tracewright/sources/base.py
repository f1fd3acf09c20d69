"""What loaders share: reading lines with a stable row_id, and the load pipeline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MESSAGE, ROW, TIME, audit, check_mandatory, with_anomaly

#: Up to so many file names are broadcast, about 20 MB.
MOST_NAMES = 100_000


#: Bits of row_id for the place in a file (files of up to 1 TB) and, above them, for the file's rank.
PLACE_BITS, RANK_BITS = 40, 23


def read_lines(spark: SparkSession, path: str, pattern: str | None = None, min_file_size: int | None = None, events: Column | None = None) -> DataFrame:
    """(row_id, value, file_path, file_size, file_time) of every line of a file or tree, blank ones too.

    With events, a list made of value that has at most as many members as the line has
    bytes, there is a row for each member, in ``event``; a null or empty list has one row
    with null.

    row_id grows with the file's path and the place in it: 2^PLACE_BITS times the file's
    rank, plus the start of the block, plus the row's number in the task. A row has a
    byte at least, so blocks of a file never share numbers. Files not larger than
    min_file_size are left out; larger ones than row_id can number are an error.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text(path)
    files = sorted(lines.inputFiles())
    if not files:
        raise ValueError(f"No files match {pattern or '*'} under {path}")
    if len(files) >= 1 << RANK_BITS:
        raise ValueError(f"More files than {1 << RANK_BITS} under {path}")
    meta = F.col("_metadata")
    number = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = lines.select("value", meta["file_path"].alias("file_path"), meta["file_size"].alias("file_size"), meta["file_modification_time"].alias("file_time"), meta["file_block_start"].alias("_start"))
    if events is not None:
        rows = rows.select("*", F.explode_outer(events).alias("event"))
    rows = rows.withColumn("_place", F.col("_start") + number)
    plain = lambda p: re.sub("^file:/+", "file:/", p)  # noqa: E731  Spark writes local paths in two ways
    ranks = spark.createDataFrame([(k, plain(f)) for k, f in enumerate(files)], "_rank long, _path string")
    joined = rows.join(F.broadcast(ranks) if len(files) <= MOST_NAMES else ranks, F.regexp_replace("file_path", "^file:/+", "file:/") == F.col("_path"), "left")
    fits = F.when(F.col("file_size") < 1 << PLACE_BITS, F.shiftleft(F.coalesce("_rank", F.lit(0)), PLACE_BITS) + F.col("_place"))
    out = joined.withColumn(ROW, F.coalesce(fits, F.raise_error(F.lit("A file is too large for row_id")).cast("long"))).drop("_start", "_place", "_rank", "_path")
    return out if min_file_size is None else out.where(F.col("file_size") > min_file_size)


def base_name(path) -> Column:
    return F.substring_index(path, "/", -1)


def folder_name(path, up: int = 1) -> Column:
    """The name of the folder that many levels above the file."""
    return F.substring_index(F.substring_index(path, "/", -1 - up), "/", 1)


def first_only(text, pattern: str, to: str = "") -> Column:
    """text with the first match of a pattern without groups replaced."""
    return F.regexp_replace(text, rf"(?s)\A(.*?)(?:{pattern})", "$1" + to)


class BaseLoader:
    """load() reads, preprocess() shapes; execute() does both, checks columns and adds the labels.

    Frames given at construction are taken instead of reading.
    """

    mandatory: tuple[str, ...] = (MESSAGE, TIME)

    def __init__(self, spark: SparkSession, filename: str | None = None, df: DataFrame | None = None, df_seq: DataFrame | None = None):
        self.spark, self.filename, self.df, self.df_seq = spark, filename, df, df_seq

    def load(self) -> None:
        raise NotImplementedError

    def preprocess(self) -> None:
        raise NotImplementedError

    def execute(self) -> DataFrame:
        if self.df is None:
            self.load()
            self.preprocess()
        check_mandatory(self.df, self.mandatory)
        self.df = with_anomaly(self.df)
        if self.df_seq is not None:
            self.df_seq = with_anomaly(self.df_seq)
        return self.df

    def audit(self) -> DataFrame:
        """Nulls and broken characters by column; an action of its own."""
        return audit(self.df)
