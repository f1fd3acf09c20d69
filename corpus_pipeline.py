"""From documents to packed training sequences.

Stages: language ID drops what has no language or is unsure of it; line dedup cuts later
repeated lines; SimHash keeps the first document of each group of near copies; benchmark
passages are cut out; packing turns the rest into sequences. Each stage's rows are written
as Parquet and read again by the next one.

Rows with a null text have no language and go in the first stage. Repeated rows are one
group of copies in the third stage. Further columns pass through all but the last stage.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, language, lines, packing, simhash
from tracewright.scratch import drop, save, temporary

#: Documents whose language is less likely than this go.
LEAST_SCORE = 0.5


def identify_language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a language of LEAST_SCORE or more, by a model of those with a known one."""
    found = language.predict(docs, language.train(docs))
    kept = found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE))
    return kept.select(*(F.col("_text" if c == "text" else f"_{k}").alias(c) for k, c in enumerate(docs.columns)))


def dedup_lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without later repeated runs of lines."""
    return lines.dedup_lines(docs)


def dedup_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id, then text hash, of each group of near copies."""
    return simhash.dedup_documents(docs)


def cut_benchmarks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without passages of benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of docs with its sequence and place there."""
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("benchmark decontamination", cut_benchmarks),
    ("packing", pack),
]

#: Hashes and token ids are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps for itself goes when its rows are written."""
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = docs
        with temporary() as own:
            docs = save(stage(spark, before, sf_dir), name.split()[0].lower())
            own.remove(docs)
        if before is not source:
            drop(before)
    return docs
