"""Logs of any format, one event per line."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..model import MESSAGE, ROW, TIME
from ..operators.windows import fill_last_seen, fill_next, merge_lines
from .base import BaseLoader, read_lines

ACTIONS = ("drop", "keep", "fill-lastseen", "fill-next", "merge")


class RawLoader(BaseLoader):
    """Lines of a file or, with filename_pattern, of a tree.

    timestamp_pattern (one group) and timestamp_format (Spark's) go together; the first
    match is cut from the message. Lines without a time are kept, dropped, given the last
    or next time of their file, or merged into the event before them. date_from_files
    takes the date from the file's modification time, the day before for times after 23:00
    that are later than the file's.
    """

    mandatory = (MESSAGE,)

    def __init__(self, spark, filename=None, filename_pattern=None, min_file_size=0, strip_full_data_path=None, timestamp_pattern=None, timestamp_format=None, missing_timestamp_action="keep", date_from_files=False, df=None, df_seq=None):
        if missing_timestamp_action not in ACTIONS:
            raise ValueError(f"missing_timestamp_action must be one of {', '.join(ACTIONS)}")
        if (timestamp_pattern is None) != (timestamp_format is None):
            raise ValueError("timestamp_pattern and timestamp_format are needed together")
        super().__init__(spark, filename, df, df_seq)
        self.pattern, self.least, self.strip = filename_pattern, min_file_size, strip_full_data_path
        self.time_pattern, self.time_format, self.action, self.dates = timestamp_pattern, timestamp_format, missing_timestamp_action, date_from_files

    def load(self):
        lines = read_lines(self.spark, self.filename, self.pattern, self.least if self.pattern else None)
        plain = F.regexp_replace("file_path", "^file:/+", "/")
        self.df = lines.select(ROW, F.col("value").alias(MESSAGE), plain.alias("file_name"), "file_time")

    def preprocess(self):
        if self.strip:
            cut = F.when(F.col("file_name").startswith(self.strip), F.substr("file_name", F.lit(len(self.strip) + 1))).otherwise(F.col("file_name"))
            self.df = self.df.withColumn("orig_file_name", F.col("file_name")).withColumn("file_name", cut)
        if self.time_pattern:
            found = F.regexp_extract(MESSAGE, self.time_pattern, 1)
            place = F.regexp_instr(MESSAGE, F.lit(self.time_pattern))
            width = F.char_length(F.regexp_extract(MESSAGE, self.time_pattern, 0))
            rest = F.when(place > 0, F.concat(F.substr(MESSAGE, F.lit(1), place - 1), F.substr(MESSAGE, place + width))).otherwise(F.col(MESSAGE))
            time = F.when(found != "", F.to_timestamp(found, self.time_format))
            self.df = self.df.withColumns({TIME: time, MESSAGE: rest})
            if self.dates:
                self._date_from_files()
            self._missing_times()
        self.df = self.df.drop("file_time")

    def _date_from_files(self):
        clock = lambda c: F.date_format(c, "HH:mm:ss.SSSSSS")
        late = (clock(TIME) > clock("file_time")) & (clock(TIME) > "23:00:00.000000")
        day = F.when(late, F.date_sub(F.to_date("file_time"), 1)).otherwise(F.to_date("file_time"))
        self.df = self.df.withColumn(TIME, F.to_timestamp(F.concat_ws(" ", day.cast("string"), clock(TIME)), "yyyy-MM-dd HH:mm:ss.SSSSSS"))

    def _missing_times(self):
        if self.action == "drop":
            self.df = self.df.where(F.col(TIME).isNotNull())
        elif self.action == "fill-lastseen":
            self.df = fill_last_seen(self.df)
        elif self.action == "fill-next":
            self.df = fill_next(self.df)
        elif self.action == "merge":
            keep = tuple(c for c in (TIME, "orig_file_name") if c in self.df.columns)
            self.df = merge_lines(self.df, F.col(TIME).isNotNull(), trace=True, keep=keep)
