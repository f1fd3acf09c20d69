"""Enrichment of sequences: all requested aggregates share one pass over the events."""

from __future__ import annotations

import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import MESSAGE, ROW, SEQUENCE, TIME, micros, require


def in_row_order(value: Column, order: str = ROW) -> Column:
    """The values of a group as a list in the order of the row ids; nulls stay."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def median_time(column: str) -> Column:
    return F.timestamp_micros(F.median(micros(column)).cast("long"))


def _strings(separator: str, token: str):
    """(sequence, its lines joined, the sum of their sizes) of rows sorted by sequence and order; nulls add nothing."""

    def run(batches):
        def row():
            text = pa.py_buffer(held.getvalue())
            ends = pa.array([0, text.size], pa.int32()).buffers()[1]
            return pa.RecordBatch.from_arrays([key, pa.Array.from_buffers(pa.string(), 1, [None, ends, text]), pa.array([size], pa.int64())], [SEQUENCE, token, f"{token}_len"])

        key, held, any_, size = None, None, False, None
        for batch in batches:
            lines, sizes = batch.column(2), batch.column(3).to_pylist()
            for k in range(batch.num_rows):
                if key is None or batch.column(0)[k] != key[0]:
                    if key is not None:
                        done, held = row(), None  # not a second string at once
                        yield done
                        del done
                    key, held, any_, size = batch.column(0).slice(k, 1), io.BytesIO(), False, None
                if sizes[k] is not None:
                    size = (size or 0) + sizes[k]
                if lines[k].is_valid:
                    held.write(separator.encode() * any_)
                    held.write(lines[k].as_buffer())
                    any_ = True
        if key is not None:
            yield row()

    return run


class SequenceEnhancer:
    """Adds aggregates of events to a sequence table.

    Methods only note what is wanted; reading df_seq plans one groupBy and one inner join
    for all of it, so sequences without events vanish. A repeat replaces the columns.
    """

    def __init__(self, df: DataFrame, df_seq: DataFrame | None = None):
        self.df = df
        self._own = df_seq is None
        self._base = df_seq if df_seq is not None else df.select(SEQUENCE).distinct()
        self._wanted: dict[str, Column] = {}
        self._after: dict[str, Column] = {}
        self._joined: list[DataFrame] = []

    def _want(self, needs: tuple[str, ...], columns: dict[str, Column], after: dict[str, Column] | None = None) -> SequenceEnhancer:
        require(self.df, SEQUENCE, *needs)
        self._wanted |= columns
        self._after |= after or {}
        return self

    def start_time(self):
        return self._want((TIME,), {"start_time": F.min(TIME)})

    def end_time(self):
        return self._want((TIME,), {"end_time": F.max(TIME)})

    def time_stamp(self):
        return self._want((TIME,), {"time_stamp": median_time(TIME).cast(self.df.schema[TIME].dataType)})

    def seq_len(self):
        return self._want((), {"seq_len": F.count("*")}, {"e_event_id_len": F.col("seq_len")})

    def events(self, event_col: str = "e_event_drain_id"):
        return self._want((event_col, ROW), {event_col: in_row_order(F.col(event_col))})

    def tokens(self, token: str = "e_words", separator: str | None = None):
        """The tokens of all events as a list; with separator, joined to one string.

        The string is put together row by row outside the JVM, one sequence at a time: a task
        holds the longest string a few times, and never its tokens.
        """
        columns = {token: F.flatten(F.filter(in_row_order(F.col(token)), lambda x: x.isNotNull()))}
        if separator is not None:
            require(self.df, SEQUENCE, token, ROW)
            line = F.when(F.exists(token, lambda x: x.isNotNull()), F.array_join(token, separator))  # a row without tokens adds no separator
            size = F.col(f"{token}_len") if f"{token}_len" in self.df.columns else F.lit(None)
            dealt = self.df.select(SEQUENCE, ROW, line.alias("_line"), size.cast("long").alias("_size")).repartitionByRange(SEQUENCE).sortWithinPartitions(SEQUENCE, ROW, "_line")
            kind = self.df.schema[SEQUENCE].dataType.simpleString()
            made = dealt.mapInArrow(_strings(separator, token), f"`{SEQUENCE}` {kind}, `{token}` string, `{token}_len` long")
            self._joined.append(made if f"{token}_len" in self.df.columns else made.drop(f"{token}_len"))
            return self
        if f"{token}_len" in self.df.columns:
            columns[f"{token}_len"] = F.sum(f"{token}_len").cast("long")
        return self._want((token, ROW), columns)

    def duration(self):
        first, last = F.min(TIME), F.max(TIME)
        return self._want((TIME,), {"duration": last - first, "duration_sec": F.timestamp_diff("SECOND", first, last)})

    def eve_len(self):
        c = "e_chars_len"
        return self._want((c,), {"eve_len_max": F.max(c), "eve_len_min": F.min(c), "eve_len_avg": F.avg(c), "eve_len_med": F.median(c), "eve_len_over1": F.count_if(F.col(c) > 1)})

    def anomaly_ratio(self):
        return self._want(("anomaly",), {"anomaly_ratio": F.avg(F.col("anomaly").cast("int"))})

    def messages(self, column: str = MESSAGE):
        """All messages of a sequence, one per line, whether any is normal, and its times."""
        return self._want((column, ROW), {column: F.array_join(in_row_order(F.col(column)), "\n")})

    def embeddings(self, embedding_column: str = "e_bert_emb"):
        """The mean vector: averages by position, so a long sequence never meets in one task."""
        require(self.df, SEQUENCE, embedding_column)
        means = self.df.select(SEQUENCE, F.posexplode(embedding_column).alias("p", "x")).groupBy(SEQUENCE, "p").agg(F.avg("x").alias("x"))
        self._joined.append(means.groupBy(SEQUENCE).agg(in_row_order(F.col("x"), "p").alias(embedding_column)))
        return self

    def next_event_prediction(self, event_col: str = "e_event_drain_id", ngrams: int = 5):
        """Predictions of each next event and their statistics, see operators.nextevent."""
        from .nextevent import NextEventPredictionNgram

        require(self.df, SEQUENCE, event_col, ROW)
        events = self.df.select(SEQUENCE, ROW, F.col(event_col).alias("event"))
        self._joined.append(NextEventPredictionNgram(ngrams).fit(events).per_sequence(events))
        return self

    @property
    def df_seq(self) -> DataFrame:
        out = self._base
        if self._wanted:
            made = self.df.groupBy(SEQUENCE).agg(*(c.alias(k) for k, c in self._wanted.items())).withColumns(self._after)
            out = out.drop(*(c for c in made.columns if c != SEQUENCE)).join(made, SEQUENCE)
        joined = self._joined
        if self._own and not self._wanted and joined:  # it has the same sequences, and its long values need no shuffle
            out, joined = joined[0].select(SEQUENCE, *(c for c in joined[0].columns if c != SEQUENCE)).where(F.col(SEQUENCE).isNotNull()), joined[1:]
        for made in joined:
            out = out.drop(*(c for c in made.columns if c != SEQUENCE)).join(made, SEQUENCE)
        return out
