"""The log data model: column names, guards, labels, audits and reduction.

Events have one row each, sequences one row per ``seq_id``. Rows have no order of their
own: ``row_id`` is the order wherever one matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE, TIME, SEQUENCE, ROW = "m_message", "m_timestamp", "seq_id", "row_id"
REPLACEMENT = "�"


def require(df: DataFrame, *columns: str) -> None:
    """Raise ValueError unless df has the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"This step needs columns that are not there: {', '.join(missing)}")


def check_mandatory(df: DataFrame, columns: tuple[str, ...] = (MESSAGE, TIME)) -> None:
    """Raise ValueError for a missing mandatory column or a time that is no timestamp."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"Missing mandatory columns: {', '.join(missing)}")
    if TIME in columns and not isinstance(df.schema[TIME].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"{TIME} must be a timestamp")


def with_anomaly(df: DataFrame) -> DataFrame:
    """normal and anomaly, each the negation of the other; normal leads if both are there."""
    if "normal" in df.columns:
        return df.withColumn("anomaly", ~F.col("normal"))
    if "anomaly" in df.columns:
        return df.withColumn("normal", ~F.col("anomaly"))
    return df


def audit(df: DataFrame) -> DataFrame:
    """(column, nulls, non_utf8) of every column with either, from one aggregation."""
    plain = [f.name for f in df.schema]
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    counts = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(plain)]
    broken = [(F.count_if(F.contains(F.col(f"`{c}`"), F.lit(REPLACEMENT))) if c in text else F.lit(0).cast("long")).alias(f"u{k}") for k, c in enumerate(plain)]
    one = df.agg(*counts, *broken)
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("nulls"), F.col(f"u{k}").alias("non_utf8")) for k, c in enumerate(plain)))
    return one.select(F.inline(rows)).where("nulls > 0 OR non_utf8 > 0")


def split_fields(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Split column at single spaces into the named fields; the last keeps the rest, missing ones are null."""
    parts = F.split(column, " ", len(names))
    return df.withColumns({name: F.get(parts, F.lit(k)) for k, name in enumerate(names)})


def partition_by_pattern(df: DataFrame, pattern: str, column: str = MESSAGE) -> tuple[DataFrame, DataFrame]:
    """(rows that do not match, rows that do); null matches neither."""
    hit = F.col(column).rlike(pattern)
    return df.where(~hit), df.where(hit)


def of_sequences(df: DataFrame, sequences: DataFrame, key: str = SEQUENCE) -> DataFrame:
    """The events of df whose sequence is in sequences."""
    return df.join(sequences.select(key), key, "left_semi")


def reduce_rows(df: DataFrame, df_seq: DataFrame | None = None, frac: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """A sample without replacement of exactly int(frac * n) sequences (one at least) or events.

    The rows with the least hashes of their key are taken. The cut is found on counts of
    2^16 hash ranges and then inside one range, so rows are never sorted as a whole.
    """
    keyed, key = (df_seq, SEQUENCE) if df_seq is not None else (df, ROW)
    hashed = keyed.select(F.col(key).alias("_key"), F.xxhash64(F.lit(seed), F.col(key)).alias("_h"))
    ranges = hashed.groupBy(F.shiftright("_h", 48).alias("range")).count().collect()  # 2^16 rows at most
    wanted = int(frac * sum(r["count"] for r in ranges))
    wanted = max(1, wanted) if df_seq is not None else wanted
    for r in sorted(ranges, key=lambda r: r["range"]):
        if r["count"] >= wanted:
            inside = hashed.where(F.shiftright("_h", 48) == r["range"]).orderBy("_h", "_key").limit(wanted)
            kept = hashed.where(F.shiftright("_h", 48) < r["range"]).select("_key").union(inside.select("_key"))
            break
        wanted -= r["count"]
    else:
        kept = hashed.select("_key")
    rows = keyed.join(kept, keyed[key] == kept["_key"], "left_semi")
    if df_seq is None:
        return rows, None
    return of_sequences(df, rows), rows


def micros(time: str | Column) -> Column:
    """A time, with or without a zone, as microseconds since 1970."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))
