"""Where results go."""

from __future__ import annotations

import pickle
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated, with a header and quotes around everything."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quoteAll=True)


def write_lines(df: DataFrame, path: str) -> None:
    """The columns of each row joined by spaces, as plain text."""
    df.select(F.concat_ws(" ", *(F.col(f"`{c}`").cast("string") for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_files(df: DataFrame, path: str, file: str = "file", order: str = "row_id", value: str = "value") -> None:
    """A text file of the values of each ``file`` (a path below path), in order.

    Each file is one task's; the driver gives the files their names, one by one.
    """
    spark = df.sparkSession
    rows = df.select(F.col(file).alias("_file"), F.col(order).alias("_order"), F.col(value).alias("value"))
    sorted_ = rows.repartition("_file").sortWithinPartitions("_file", "_order")
    sorted_.select("_file", "value").write.mode("overwrite").partitionBy("_file").text(f"{path}/_parts")
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    root = to_path(f"{path}/_parts")
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in files.listStatus(root):
        name = unquote(folder.getPath().getName())
        if name.startswith("_file="):
            for part in files.globStatus(to_path(folder.getPath(), "part-*")):
                target = to_path(f"{path}/{name.removeprefix('_file=')}")
                files.mkdirs(target.getParent())
                files.rename(part.getPath(), target)
    files.delete(root, True)


def latex_table(df: DataFrame) -> str:
    """A small table as LaTeX."""
    rows = [" & ".join(df.columns), *(" & ".join("" if v is None else str(v) for v in r) for r in df.collect())]
    body = " \\\\\n".join(rows).replace("_", "\\_").replace("%", "\\%")
    return "\\begin{tabular}{" + "l" * len(df.columns) + "}\n" + body + " \\\\\n\\end{tabular}\n"


def save_model(model, path: str, spark: SparkSession | None = None) -> None:
    """A fitted Spark model or pipeline, or any fitted detector or vectorizer of this library.

    Of the latter, tables become Parquet, Spark models are saved as such, and the rest is
    pickled.
    """
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
        return
    spark = spark or SparkSession.active()
    plain, kinds = {}, {}
    for name, value in vars(model).items():
        if isinstance(value, DataFrame):
            value.write.mode("overwrite").parquet(f"{path}/{name}")
            kinds[name] = "table"
        elif hasattr(value, "write"):
            value.write().overwrite().save(f"{path}/{name}")
            kinds[name] = "model"
        else:
            plain[name] = value
    row = [(bytearray(cloudpickle.dumps((type(model), plain, kinds))),)]
    spark.createDataFrame(row, "state binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/state")


def load_model(spark: SparkSession, path: str):
    """What save_model() wrote; only from where you would run code from."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")):
        return DefaultParamsReader.loadParamsInstance(path, spark)
    kind, plain, kinds = pickle.loads(bytes(spark.read.parquet(f"{path}/state").first()["state"]))
    model = kind.__new__(kind)
    vars(model).update(plain)
    for name, what in kinds.items():
        vars(model)[name] = spark.read.parquet(f"{path}/{name}") if what == "table" else DefaultParamsReader.loadParamsInstance(f"{path}/{name}", spark)
    return model
