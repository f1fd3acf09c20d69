"""Order-dependent operators: running counts, fills and multi-line events.

Running sums over a whole table don't use a window without a partition. The order is cut
at approximate quantiles into ranges; each range gets its own running sum and the total
of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MESSAGE, ROW, TIME, micros
from ..scratch import save

RANGES, CHUNK = 64, 20


def running_sums(df: DataFrame, values: dict[str, Column], order: list[Column], ranges: int = RANGES) -> DataFrame:
    """df with the sum of each value up to each row; order[0] must cast to double and cut the rows well.

    Null orders come first. Rows that agree in order[0] stay in one range. df is read three
    times, so give a saved table if it is costly.
    """
    keyed = df.withColumn("_at", order[0].cast("double"))
    wanted = [k / ranges for k in range(1, ranges)]
    bounds = sorted(set(keyed.approxQuantile("_at", wanted, 0.002))) if wanted else []
    upto = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if len(bounds) < 2:
        return keyed.drop("_at").withColumns({k: F.sum(v).over(upto(Window)) for k, v in values.items()})
    cut = F.coalesce(F.size(F.filter(F.lit(bounds), lambda b: b < F.col("_at"))), F.lit(0))
    keyed = keyed.withColumns({"_range": cut} | {f"_value_{k}": v for k, v in values.items()}).drop("_at")
    totals = keyed.groupBy("_range").agg(*(F.sum(f"_value_{k}").alias(f"_total_{k}") for k in values))  # RANGES rows at most
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select("_range", *(F.coalesce(F.sum(f"_total_{k}").over(before), F.lit(0)).alias(f"_shift_{k}") for k in values))
    inside = keyed.withColumns({f"_inside_{k}": F.sum(f"_value_{k}").over(upto(Window.partitionBy("_range"))) for k in values})
    joined = inside.join(F.broadcast(shift), "_range")
    return joined.withColumns({k: F.col(f"_shift_{k}") + F.col(f"_inside_{k}") for k in values}).drop("_range", *(f"_{part}_{k}" for k in values for part in ("value", "inside", "shift")))


def running_sum(df: DataFrame, value: Column, order: list[Column], out: str, ranges: int = RANGES) -> DataFrame:
    """One running sum, see running_sums()."""
    return running_sums(df, {out: value}, order, ranges)


def numbered(df: DataFrame, order: str, out: str, most: int = 100_000) -> DataFrame:
    """df with its 1-based number by a numeric column without ties; over ``most`` rows by ranges of it."""
    df = save(df, "numbered")
    if df.count() <= most:
        return df.withColumn(out, F.row_number().over(Window.orderBy(order)).cast("long"))
    return running_sum(df, F.lit(1), [F.col(order)], out)


def _ordered(direction: int) -> list[Column]:
    time = micros(TIME)
    if direction == 1:
        return [time, F.col(ROW)]
    if direction == -1:
        return [-time, F.col(ROW)]
    return [F.col(ROW)]


def mark_first(df: DataFrame, column: str, direction: int = 1, out: str = "_first") -> DataFrame:
    """df with out: whether a row is the first with its value; null is a value.

    The first place of each value comes from partial aggregation and is joined back, so a
    value that many rows have never meets in one task.
    """
    place = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(_ordered(direction))))
    least = df.groupBy(F.col(column).alias("_value")).agg(F.min(place).alias("_least"))
    return df.join(least, F.col(column).eqNullSafe(F.col("_value")), "left").withColumn(out, place.eqNullSafe(F.col("_least"))).drop("_value", "_least")


def item_cumsum(df: DataFrame, column: str = "e_message_normalized", chronological_order: int | bool = 1, ano_only: bool = True, unique_only: bool = True, out_column: str | None = None, ranges: int = RANGES) -> DataFrame:
    """A running count of items in time order (1), reverse (-1) or row order (0).

    An item counts if it is the first of its value (unique_only) and an anomaly (ano_only).
    """
    direction = int(chronological_order)
    flag = F.lit(True)
    if unique_only:
        df = mark_first(df, column, direction)
        flag = flag & F.col("_first")
    if ano_only:
        flag = flag & F.coalesce(F.col("anomaly"), F.lit(False))
    name = out_column or "cumu_items_" + "un" * unique_only + "an" * ano_only
    order = _ordered(direction)
    rows = save(df.withColumn("_counts", flag.cast("long")), "cumulative") if unique_only else df.withColumn("_counts", flag.cast("long"))
    return running_sum(rows, F.col("_counts"), order, name, ranges).drop("_first", "_counts")


def _with_carry(df: DataFrame, by: tuple[str, ...], what: Column, over: Column, back: bool = False) -> DataFrame:
    """df with _chunk and _carry: over the values of ``what`` of the chunks of its file before it; with back, after it, last first.

    A chunk is 2^CHUNK row ids, so no task holds more of a file than that at once; what is
    carried is one value for each chunk.
    """
    chunked = df.withColumn("_chunk", F.shiftright(ROW, CHUNK))
    window = Window.partitionBy(*(f"_by{k}" for k in range(len(by)))).orderBy(F.desc("_key") if back else "_key").rowsBetween(Window.unboundedPreceding, -1)
    one = chunked.groupBy(*(F.col(c).alias(f"_by{k}") for k, c in enumerate(by)), F.col("_chunk").alias("_key")).agg(what.alias("_value"))
    carried = one.withColumn("_carry", over.over(window)).drop("_value")
    on = F.col("_chunk") == F.col("_key")
    for k, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return chunked.join(carried, on).drop("_key", *(f"_by{k}" for k in range(len(by))))


def fill_last_seen(df: DataFrame, column: str = TIME, by: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """Nulls get the last value seen in their file."""
    value = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(ROW)))
    carried = _with_carry(df, by, value, F.last("_value", True))
    w = Window.partitionBy(*by, "_chunk").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(column, F.coalesce(F.last(column, True).over(w), F.col("_carry"))).select(*df.columns)


def fill_next(df: DataFrame, column: str = TIME, by: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """Nulls get the next value of their file.

    The rows run backwards: a frame up to the end would be gone through again for each row.
    """
    value = F.min_by(column, F.when(F.col(column).isNotNull(), F.col(ROW)))
    carried = _with_carry(df, by, value, F.last("_value", True), back=True)
    w = Window.partitionBy(*by, "_chunk").orderBy(F.desc(ROW)).rowsBetween(Window.unboundedPreceding, 0)
    return carried.withColumn(column, F.coalesce(F.last(column, True).over(w), F.col("_carry"))).select(*df.columns)


def merge_lines(df: DataFrame, starts: Column, by: tuple[str, ...] = ("file_name",), column: str = MESSAGE, trace: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per event of one or more lines; an event begins where starts holds.

    Lines before the first event of a file are an event of their own. With trace the
    following lines go to a column trace (null if there are none), else to the message.
    keep: columns whose value at the event's first line stays.
    """
    flagged = _with_carry(df.withColumn("_start", F.coalesce(starts, F.lit(False))), by, F.count_if("_start"), F.sum("_value"))
    inside = F.sum(F.col("_start").cast("long")).over(Window.partitionBy(*by, "_chunk").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0))
    flagged = flagged.withColumn("_group", F.coalesce("_carry", F.lit(0)) + inside)
    join = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["m"]), "\n")
    line = F.struct(F.col(ROW).alias("r"), F.col(column).alias("m"))
    head = lambda c: F.min_by(c, ROW).alias(c)
    if trace:
        rest = join(F.when(~F.col("_start"), line))
        text = [head(column), F.when(F.count_if(~F.col("_start")) > 0, rest).alias("trace")]
    else:
        text = [join(line).alias(column)]
    out = flagged.groupBy(*by, "_group").agg(F.min(ROW).alias(ROW), *text, *(head(c) for c in keep))
    return out.drop("_group")
