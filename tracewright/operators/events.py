"""Enrichment of events. Each method adds its columns once; a repeat changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import MESSAGE, require


class EventLogEnhancer:
    """Adds derived columns to an event table; df is the current plan, nothing runs before an action."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _add(self, source: str, columns: dict, always: bool = False) -> DataFrame:
        require(self.df, source)
        fresh = {k: v for k, v in columns.items() if always or k not in self.df.columns}
        if fresh:
            self.df = self.df.withColumns(fresh)
        return self.df

    def _add_list(self, source: str, name: str, value) -> DataFrame:
        require(self.df, source)
        if name not in self.df.columns:
            self.df = self.df.withColumn(name, value).withColumn(f"{name}_len", F.size(name))
        return self.df

    def words(self, column: str = MESSAGE) -> DataFrame:
        return self._add_list(column, "e_words", text.words(F.col(column)))

    def alphanumerics(self, column: str = MESSAGE) -> DataFrame:
        return self._add_list(column, "e_alphanumerics", text.alphanumerics(F.col(column)))

    def trigrams(self, column: str = MESSAGE) -> DataFrame:
        return self._add_list(column, "e_trigrams", text.trigram_bag(F.col(column)))

    def char_ngrams(self, column: str = MESSAGE, n: int = 3) -> DataFrame:
        return self._add_list(column, "e_cngrams", text.char_ngrams(F.col(column), n))

    def length(self, column: str = MESSAGE) -> DataFrame:
        return self._add(column, {"e_chars_len": F.char_length(column), "e_lines_len": text.line_count(F.col(column)), "e_event_id_len": F.lit(1)})

    def normalize(self, column: str = MESSAGE, regexs=text.MASKS, to_lower: bool = False, twice: bool = True) -> DataFrame:
        return self._add(column, {"e_message_normalized": text.mask(F.col(column), regexs, to_lower, twice)}, always=True)

    def embed(self, encoder: Callable[[DataFrame, str, str], DataFrame], column: str = "e_message_normalized") -> DataFrame:
        """e_bert_emb by encoder(df, column, name), see operators.embedding."""
        require(self.df, column)
        if "e_bert_emb" not in self.df.columns:
            self.df = encoder(self.df, column, "e_bert_emb")
        return self.df

    def parse(self, parser: Callable[..., DataFrame], column: str = "e_message_normalized", reparse: bool = False, **options) -> DataFrame:
        """Add the event ids of a template parser, see operators.templates."""
        require(self.df, column)
        name = parser.id_column
        if name in self.df.columns:
            if not reparse:
                return self.df
            self.df = self.df.drop(name, *getattr(parser, "more_columns", ()))
        self.df = parser(self.df, column, **options)
        return self.df
