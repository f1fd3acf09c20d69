"""Drain over a stream or over batches, with its clusters as state.

A key (token count and first token) has its own state: the templates of its clusters as
JSON. An id is the key's hash and the cluster's number in it, so it never changes once
given, whatever arrives elsewhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text
from ..operators.templates.online import Drain, drain_key, drain_tokens

OUT = "row_id long, message string, e_event_drain_id string, e_event_drain_template string"
STATE = "templates string"


def _learn(key: str, drain: Drain, frames: Iterator[pd.DataFrame], tag: str) -> pd.DataFrame:
    rows = pd.concat(list(frames)).sort_values("row_id")
    ids, templates = [], []
    for tokens in rows["tokens"]:
        k = drain.add(list(tokens))
        ids.append(f"{tag}-{k}")
        templates.append(drain.template(k))
    return pd.DataFrame({"row_id": rows["row_id"].to_numpy(), "message": rows["message"].to_numpy(), "e_event_drain_id": ids, "e_event_drain_template": templates})


def _keyed(df: DataFrame, column: str) -> DataFrame:
    tokens = drain_tokens(column)
    return df.where(F.col(column).isNotNull()).select("row_id", F.col(column).alias("message"), tokens.alias("tokens"), drain_key(tokens).alias("key"), F.lower(F.hex(F.xxhash64(drain_key(tokens)))).alias("tag"))


def parse_stream(df: DataFrame, column: str = "e_message_normalized", sim_th: float = 0.4) -> DataFrame:
    """(row_id, message, e_event_drain_id, e_event_drain_template) of a streaming df (row_id, column)."""

    def step(key, frames, state: GroupState):
        drain = Drain(sim_th)
        if state.exists:
            drain.found = json.loads(state.get[0])
        frames = list(frames)
        out = _learn(key[0], drain, iter(frames), key[1])
        state.update((json.dumps(drain.found),))
        yield out

    return _keyed(df, column).groupBy("key", "tag").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def enhance_stream(df: DataFrame, column: str = "m_message") -> DataFrame:
    """The stateless columns of a streaming log: mask, words and length."""
    return df.withColumns({"e_message_normalized": text.mask(F.col(column)), "e_words": text.words(F.col(column)), "e_chars_len": F.char_length(column)})


class DrainState:
    """Clusters kept in a Parquet table between batches of lines.

    parse() returns the lines of a batch with ids and writes the state for the next; a
    batch that fails leaves the last state as it was.
    """

    def __init__(self, spark: SparkSession, path: str, sim_th: float = 0.4):
        self.spark, self.path, self.sim_th = spark, path.rstrip("/"), sim_th

    def _version(self) -> int:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return 0
        names = [f.getPath() for f in fs.listStatus(root)]
        return max([int(p.getName().removeprefix("v")) for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))], default=0)

    def parse(self, df: DataFrame, column: str = "e_message_normalized") -> DataFrame:
        version, sim_th = self._version(), self.sim_th
        fields = "key string, tag string, row_id long, message string, tokens array<string>, templates string"
        lines = _keyed(df, column).select("key", "tag", "row_id", "message", "tokens", F.lit(None).cast("string").alias("templates"))
        if version:
            old = self.spark.read.parquet(f"{self.path}/v{version}/state")
            lines = lines.union(old.select("key", "tag", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), "templates"))
        else:
            lines = self.spark.createDataFrame([], fields).union(lines)

        def step(rows: pd.DataFrame) -> pd.DataFrame:
            kept = rows[rows["templates"].notna()]
            drain = Drain(sim_th)
            if len(kept):
                drain.found = json.loads(kept["templates"].iloc[0])
            fresh = rows[rows["templates"].isna()]
            key, tag = rows["key"].iloc[0], rows["tag"].iloc[0]
            out = _learn(key, drain, iter([fresh]), tag)
            out = out.assign(key=key, tag=tag, templates=None)
            last = pd.DataFrame([{"row_id": None, "message": None, "e_event_drain_id": None, "e_event_drain_template": None, "key": key, "tag": tag, "templates": json.dumps(drain.found)}])
            return pd.concat([out, last]).astype({"row_id": "Int64"})

        done = lines.groupBy("key", "tag").applyInPandas(step, OUT + ", key string, tag string, templates string")
        target = f"{self.path}/v{version + 1}"
        done.withColumn("part", F.when(F.col("templates").isNull(), "lines").otherwise("state")).write.mode("overwrite").partitionBy("part").parquet(f"{target}/all")
        whole = self.spark.read.parquet(f"{target}/all")
        whole.where("part = 'state'").select("key", "tag", "templates").write.mode("overwrite").parquet(f"{target}/state")
        marker = self.spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")
        marker.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).create(marker, True).close()
        return whole.where("part = 'lines'").select("row_id", "message", "e_event_drain_id", "e_event_drain_template")
