"""IPLoM: messages split by length, by the position with fewest words, and by how two positions map.

Step 1 groups by token count. Step 2 splits a group at the position with the fewest
different words, if that has two or more. In step 3 a part whose share of constant
positions is at most CT is split by two positions, those whose number of different words
is the most frequent one besides 1: a pair of words that map one to one goes by the first
word; one to many goes by the many side if that has few words for its rows (below
lower_bound), else by the one side; many to many stays together. Parts below the support
thresholds are outliers. A template shows the words that are the same all over a part.

Each step is a few groupings of the distinct messages' words in long form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...model import ROW, require
from ...scratch import save
from .bins import WILD, short_id


def step1(texts: DataFrame) -> DataFrame:
    """texts (tokens, n) with size, the token count."""
    return texts.withColumn("size", F.size("tokens"))


def _counts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, words): how many different words each position of a part has."""
    words = parts.select(*keys, F.posexplode("tokens").alias("pos", "word"))
    return words.groupBy(*keys, "pos").agg(F.count_distinct("word").alias("words"))


def step2(parts: DataFrame) -> DataFrame:
    """parts with key2: the word at the position with the fewest words of its group, null if that has one."""
    fewest = _counts(parts, ["size"]).groupBy("size").agg(F.min(F.struct("words", "pos")).alias("f"))
    at = fewest.where("f.words > 1").select("size", F.col("f.pos").alias("at"))
    return parts.join(at, "size", "left").withColumn("key2", F.when(F.col("at").isNotNull(), F.get("tokens", F.col("at")))).drop("at")


def step3(parts: DataFrame, ct: float, lower_bound: float) -> DataFrame:
    """parts with key3: (side, word) of the split, null where there is none."""
    counts = _counts(parts, ["size", "key2"])
    like = Window.partitionBy("size", "key2", "words")
    pick = Window.partitionBy("size", "key2").orderBy(F.col("words") == 1, F.desc("same"), "words", "pos")  # at most as many rows as positions
    ranked = counts.withColumn("same", F.count("*").over(like)).withColumn("r", F.row_number().over(pick))
    good = ranked.groupBy("size", "key2").agg((F.count_if(F.col("words") == 1) / F.count("*")).alias("good"), *(F.max(F.when((F.col("r") == k) & (F.col("words") > 1), F.col("pos"))).alias(f"p{k}") for k in (1, 2)))
    good = good.where((F.col("good") <= ct) & F.col("p1").isNotNull() & F.col("p2").isNotNull())
    good = good.select(F.col("size").alias("_s"), F.col("key2").alias("_k"), F.least("p1", "p2").alias("p1"), F.greatest("p1", "p2").alias("p2"))
    joined = parts.join(good, (F.col("size") == F.col("_s")) & F.col("key2").eqNullSafe(F.col("_k")), "left").drop("_s", "_k")
    joined = joined.withColumns({"v1": F.get("tokens", F.col("p1")), "v2": F.get("tokens", F.col("p2"))})
    pairs = joined.where("p1 IS NOT NULL").groupBy("size", "key2", "v1", "v2").agg(F.sum("n").alias("n"))
    side = lambda a, b, k: pairs.groupBy("size", "key2", a).agg(F.count(b).alias(f"m{k}"), F.sum("n").alias(f"n{k}")).withColumnsRenamed({"size": f"_s{k}", "key2": f"_k{k}", a: f"_{a}"})
    one, other = side("v1", "v2", 1), side("v2", "v1", 2)
    on = lambda k, v: (F.col("size") == F.col(f"_s{k}")) & F.col("key2").eqNullSafe(F.col(f"_k{k}")) & (F.col(v) == F.col(f"_{v}"))
    out = joined.join(one, on(1, "v1"), "left").join(other, on(2, "v2"), "left")
    m1, m2 = F.col("m1"), F.col("m2")  # words of the other side for v1, for v2
    first, second = F.concat(F.lit("1:"), "v1"), F.concat(F.lit("2:"), "v2")
    few1, few2 = m1 / F.col("n1") < lower_bound, m2 / F.col("n2") < lower_bound
    key3 = F.when((m1 > 1) & (m2 > 1), None).when(m1 > 1, F.when(few1, second).otherwise(first)).when(m2 > 1, F.when(few2, first).otherwise(second)).when(m1 == 1, first)
    return out.withColumn("key3", key3).select(*parts.columns, "key3")


def _join_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where null equals null."""
    renamed = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        on = same if on is None else on & same
    return a.join(renamed, on).drop(*(f"_b_{k}" for k in keys))


def _leaves(df: DataFrame, column: str, tokens: Column, ct: float, lower_bound: float, fst: float, pst: float) -> DataFrame:
    """(text, first, template, size, key2, key3, outlier) of every distinct message."""
    texts = save(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("text")).agg(F.min(ROW).alias("first"), F.count("*").alias("n")), "texts").withColumn("tokens", tokens)
    parts = save(step3(step2(step1(texts)), ct, lower_bound), "iplom")
    path = ["size", "key2", "key3"]
    words = parts.select(*path, F.posexplode("tokens").alias("pos", "word"))
    at = words.groupBy(*path, "pos").agg(F.min("word").alias("low"), F.max("word").alias("high"))
    shown = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(WILD)
    templates = at.groupBy(*path).agg(F.array_sort(F.collect_list(F.struct("pos", shown.alias("w")))).alias("ws")).withColumn("template", F.array_join(F.transform("ws", lambda x: x["w"]), " ")).drop("ws")
    out = _join_safe(parts, templates, path).select("text", "first", "n", *path, "template")
    if fst > 0 or pst > 0:
        total = out.agg(F.sum("n").alias("total"))
        weights = [out.groupBy(*path[: k + 1]).agg(F.sum("n").alias(f"w{k}")) for k in range(3)]
        for k, w in enumerate(weights):
            out = _join_safe(out, w, path[: k + 1])
        out = out.crossJoin(F.broadcast(total))
        small = [F.col(f"w{k}") / F.col("total") < fst for k in range(3)] + [F.col(f"w{k}") / F.col(f"w{k - 1}") < pst for k in (1, 2)]
        low = small[0]
        for s in small[1:]:
            low = low | s
        return out.withColumn("outlier", low)
    return out.withColumn("outlier", F.lit(False))


def _attach(df: DataFrame, column: str, named: DataFrame) -> DataFrame:
    return df.join(named, df[column] == named["text"], "left").drop("text")


def parse_iplom(df: DataFrame, column: str = "e_message_normalized", CT: float = 0.35, PST: float = 0, lower_bound: float = 0.1) -> DataFrame:
    """df with e_event_iplom_id (of the template) and e_template_iplom; tokens end at white space, =, : and commas.

    A message without tokens has the id e_null, and so does a null one.
    """
    tokens = F.filter(F.split("text", r"[\s=:,]"), lambda t: t != "")
    leaves = _leaves(df.where(F.size(F.filter(F.split(column, r"[\s=:,]"), lambda t: t != "")) > 0), column, tokens, CT, lower_bound, 0, PST)
    named = leaves.select("text", F.when(F.col("outlier"), "Outlier").otherwise(F.col("template")).alias("e_template_iplom"))
    named = named.withColumn("e_event_iplom_id", F.when(F.col("e_template_iplom") == "Outlier", "Outlier").otherwise(short_id(F.col("e_template_iplom"))))
    return _attach(df, column, named).withColumn("e_event_iplom_id", F.coalesce("e_event_iplom_id", F.lit("e_null")))


def parse_pliplom(df: DataFrame, column: str = "e_message_normalized", CT: float = 0.35, FST: float = 0, PST: float = 0, lower_bound: float = 0.1) -> DataFrame:
    """df with e_event_pliplom_id and e_template_pliplom; tokens end at single spaces.

    An id has a part e<k> for each step that split, k counting the parts of its parent in
    the order of their words.
    """
    require(df, ROW, column)
    leaves = _leaves(df, column, F.split("text", " "), CT, lower_bound, FST, PST)
    tree = leaves.select("size", "key2", "key3").distinct()  # a row for each leaf
    number = lambda by, key: F.dense_rank().over(Window.partitionBy(*by).orderBy(key))
    part = lambda by, key: F.when(F.col(key).isNotNull(), F.concat(F.lit("e"), number(by, key))).otherwise("")
    sizes = tree.select("size").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("size")))  # as many as lengths
    ids = tree.join(sizes, "size").select("size", "key2", "key3", F.concat(F.lit("e"), "_nth", part(["size"], "key2"), part(["size", "key2"], "key3")).alias("id"))
    joined = _join_safe(leaves, ids, ["size", "key2", "key3"])
    shown = joined.select("text", F.when(F.col("outlier"), "outlier_e").otherwise(F.col("id")).alias("e_event_pliplom_id"), F.when(F.col("outlier"), "outlier").otherwise(F.col("template")).alias("e_template_pliplom"))
    return _attach(df, column, shown)


parse_iplom.id_column, parse_iplom.more_columns = "e_event_iplom_id", ("e_template_iplom",)
parse_pliplom.id_column, parse_pliplom.more_columns = "e_event_pliplom_id", ("e_template_pliplom",)
