"""Loaders of public log data sets, by the layout of their files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import MESSAGE, ROW, SEQUENCE, TIME, split_fields
from ..operators.joins import graded_label_ratio, label_range_join
from ..operators.sequences import in_row_order
from ..operators.windows import merge_lines
from .base import BaseLoader, base_name, first_only, folder_name, read_lines


def _fields(lines: DataFrame, names: list[str], *more: str) -> DataFrame:
    return split_fields(lines, "value", names).select(ROW, *names, *more)


class HDFSLoader(BaseLoader):
    """Block-store log with a label file (BlockId,Label); unlabelled blocks are no sequences."""

    def __init__(self, spark, filename=None, df=None, df_seq=None, labels_file_name=None):
        super().__init__(spark, filename, df, df_seq)
        self.labels_file_name = labels_file_name

    def load(self):
        self.df = read_lines(self.spark, self.filename)

    def preprocess(self):
        df = _fields(self.df, ["date", "time", "id", "level", "component", MESSAGE])
        block = F.regexp_extract(MESSAGE, r"(blk_[-?0-9]+)", 1)
        self.df = df.withColumns({SEQUENCE: F.when(block != "", block), TIME: F.try_to_timestamp(F.concat("date", "time"), F.lit("yyMMddHHmmss"))})
        if self.labels_file_name:
            labels = self.spark.read.csv(self.labels_file_name, header=True)
            normal = F.col("Label").startswith("Normal").alias("normal")
            self.df_seq = self.df.select(SEQUENCE).distinct().join(labels, F.col(SEQUENCE) == F.col("BlockId")).select(SEQUENCE, "Label", normal)


class BGLLoader(BaseLoader):
    """Supercomputer log; a label that starts with - is normal."""

    # The layout's fields, in order.
    names = ["label", "timestamp", "date", "node", "time", "noderepeat", "type", "component", "level", MESSAGE]

    def load(self):
        self.df = read_lines(self.spark, self.filename)

    def preprocess(self):
        self.df = self._labelled(_fields(self.df, self.names))

    @staticmethod
    def _labelled(df: DataFrame) -> DataFrame:
        return df.withColumns({TIME: F.timestamp_seconds(F.expr("try_cast(timestamp AS bigint)")), "normal": F.col("label").startswith("-")})


class ThuSpiLibLoader(BGLLoader):
    """Three supercomputers' logs; two of them have a component with an optional [pid]."""

    def __init__(self, spark, filename=None, df=None, df_seq=None, split_component=True):
        super().__init__(spark, filename, df, df_seq)
        self.split_component = split_component
        self.names = ["label", "timestamp", "date", "userid", "month", "day", "time", "location", *(["component_pid"] if split_component else []), MESSAGE]

    def preprocess(self):
        super().preprocess()
        if self.split_component:
            parts = F.split("component_pid", r"\[", 2)
            trim = lambda k, what: F.regexp_replace(F.get(parts, F.lit(k)), f"[{what}]+$", "")
            self.df = self.df.withColumns({"component": trim(0, ":"), "pid": trim(1, r"\]:")}).drop("component_pid")


class HadoopLoader(BaseLoader):
    """Application folders of container logs, with a text file of labels."""

    event_pattern = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2},[0-9]{3}"

    def __init__(self, spark, filename=None, df=None, df_seq=None, filename_pattern="*.log", labels_file_name=None):
        super().__init__(spark, filename, df, df_seq)
        self.filename_pattern, self.labels_file_name = filename_pattern, labels_file_name

    def load(self):
        lines = read_lines(self.spark, self.filename, self.filename_pattern)
        self.df = lines.select(ROW, "value", folder_name(F.col("file_path")).alias(SEQUENCE), base_name(F.col("file_path")).alias("seq_id_sub"))

    def preprocess(self):
        df = merge_lines(self.df, F.col("value").rlike(self.event_pattern), (SEQUENCE, "seq_id_sub"), "value")
        process = F.regexp_extract("value", r"\[(.*?)\]", 1)
        plain = F.regexp_replace(first_only(F.col("value"), r"\s*\[[^\n]*?\]\s*", " "), r"\s+", " ")
        df = df.withColumns({"process": F.when(F.col("value").rlike(r"\[(.*?)\]"), process), "value": plain})
        df = _fields(df, ["date", "time", "level", "component", MESSAGE], SEQUENCE, "seq_id_sub", "process")
        time = F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("yyyy-MM-dd HH:mm:ss,SSS"))
        self.df = df.withColumns({TIME: time, MESSAGE: F.coalesce(MESSAGE, F.lit("<EMPTY LOG MESSAGE>"))})
        if self.labels_file_name:
            labels = self.spark.createDataFrame(parse_labels(r["value"] for r in self.spark.read.text(self.labels_file_name).collect()), "app_id string, app_name string, Label string")
            joined = self.df.select(SEQUENCE).distinct().join(labels, F.col(SEQUENCE) == F.col("app_id"))
            self.df_seq = joined.select(SEQUENCE, "app_name", "Label", F.col("Label").startswith("Normal").alias("normal"))


def parse_labels(lines) -> list[tuple[str, str | None, str | None]]:
    """(application id, name, label) from lines ``### name``, ``label:`` and ``+ id``."""
    name = label = None
    out = []
    for line in map(str.strip, lines):
        if line.startswith("###"):
            name = line[3:].strip()
        elif line.startswith("+"):
            out.append((line[1:].strip(), name, label))
        elif line.endswith(":"):
            label = line[:-1]
    return out


class ProLoader(BaseLoader):
    """Device logs; the names of normal ones start with success."""

    def load(self):
        lines = read_lines(self.spark, self.filename)
        self.df = lines.select(ROW, F.regexp_replace("value", r"\s+", " ").alias("value"), base_name(F.col("file_path")).alias(SEQUENCE))

    def preprocess(self):
        df = _fields(self.df, ["count", "date", "time", "system", "nr1", "nr2", "log_level", MESSAGE], SEQUENCE)
        self.df = df.withColumn(TIME, F.try_to_timestamp(F.concat_ws(" ", "date", "time"), F.lit("dd.MM.yyyy HH:mm:ss.SSS")))
        self.df_seq = self.df.select(SEQUENCE).distinct().withColumn("normal", F.col(SEQUENCE).startswith("success"))


class ADFALoader(BaseLoader):
    """System call ids in text files, an event per id; attack files lie in a folder named after the attack."""

    mandatory = (MESSAGE,)
    # The folder of attacks, and a file that has no calls.
    attacks, skipped = "Attack_Data_Master", "ADFA-LD+Syscall+List.txt"

    def load(self):
        calls = F.split(F.regexp_replace("value", "^ +| +$", ""), " ")
        lines = read_lines(self.spark, self.filename, "*.txt", events=calls).where(base_name(F.col("file_path")) != self.skipped)
        attack = F.regexp_replace(folder_name(F.col("file_path")), "_[^_]*$", "")
        label = F.when(F.contains("file_path", F.lit(f"/{self.attacks}/")), attack).otherwise("Normal")
        seq = F.regexp_replace(base_name(F.col("file_path")), r"\.txt$", "")
        self.df = lines.select(ROW, seq.alias(SEQUENCE), label.alias("label"), F.col("event").alias(MESSAGE))

    def preprocess(self):
        self.df = self.df.withColumn("normal", F.col("label") == "Normal")
        messages = in_row_order(F.col(MESSAGE)).alias(MESSAGE)
        self.df_seq = self.df.groupBy(SEQUENCE).agg(messages, F.first("label").alias("label"), F.bool_and("normal").alias("normal"))


class AWSCTDLoader(BaseLoader):
    """CSV lines of system calls with a label at the end; a line is a sequence."""

    mandatory = (MESSAGE,)

    def load(self):
        # an event knows its line by its number in it: the line's own is that of its first event
        parts = F.split("value", ",")
        calls = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, k: F.struct(k.alias("pos"), x.alias("call")))
        lines = read_lines(self.spark, self.filename, "*.csv", events=calls).where("value <> ''")
        first = F.col(ROW) - F.coalesce("event.pos", F.lit(0))
        name = F.concat_ws("/", folder_name(F.col("file_path")), F.regexp_replace(base_name(F.col("file_path")), r"\.csv$", ""), first.cast("string"))
        last = F.element_at(parts, -1)
        label = F.when(last == "Clean", "Normal").otherwise(last)
        self.df = lines.select(ROW, name.alias(SEQUENCE), label.alias("label"), F.col("event.call").alias(MESSAGE), first.alias("_line"))

    def preprocess(self):
        self.df = self.df.withColumn("normal", F.col("label") == "Normal")
        calls = F.filter(in_row_order(F.col(MESSAGE)), lambda x: x.isNotNull())
        seq = self.df.groupBy(SEQUENCE, F.col("_line").alias(ROW), "label", "normal").agg(calls.alias(MESSAGE))
        self.df_seq = seq.select(ROW, SEQUENCE, F.when(F.size(MESSAGE) > 0, F.col(MESSAGE)).alias(MESSAGE), "label", "normal")
        self.df = self.df.drop("_line")


class GELFLoader(BaseLoader):
    """JSON lines with message and @timestamp."""

    def load(self):
        lines = read_lines(self.spark, self.filename).where("trim(value) <> ''")
        schema = self.spark.read.json(self.filename).schema
        self.df = lines.select(ROW, F.from_json("value", schema).alias("x")).select(ROW, "x.*")

    def preprocess(self):
        df = self.df.withColumnsRenamed({"message": MESSAGE})
        self.df = df.withColumn(TIME, F.expr("try_to_timestamp(`@timestamp`)")) if "@timestamp" in df.columns else df.withColumn(TIME, F.lit(None).cast("timestamp"))


class LO2Loader(BaseLoader):
    """Runs of test cases with a log per service; the case ``correct`` is normal.

    Of each of the first n_runs runs, the correct case and errors_per_run error cases are
    taken, by the hash of their names and seed; dup_errors=False takes an error case in
    one run only, single_error_type a named one or ("random") one for all runs.
    """

    services = ("client", "code", "key", "refresh-token", "service", "token", "user", "")

    def __init__(self, spark, filename=None, df=None, df_seq=None, n_runs=53, errors_per_run=1, dup_errors=True, single_error_type=None, single_service="", seed=42):
        if single_service not in self.services:
            raise ValueError(f"Unknown service {single_service}")
        super().__init__(spark, filename, df, df_seq)
        self.n_runs, self.errors_per_run, self.dup_errors, self.single, self.service, self.seed = n_runs, errors_per_run, dup_errors, single_error_type, single_service, seed

    def load(self):
        lines = read_lines(self.spark, self.filename, "*.log")
        path = F.col("file_path")
        lines = lines.select(ROW, F.trim("value").alias(MESSAGE), folder_name(path, 2).alias("run"), folder_name(path).alias("test_case"), F.regexp_replace(base_name(path), r"\.log$", "").alias("service")).where(f"{MESSAGE} <> ''")
        if self.service:
            lines = lines.where(F.contains("service", F.lit(self.service)))
        # (run, case) pairs are folders: a short list
        pairs = sorted((r["run"], r["test_case"]) for r in lines.select("run", "test_case").distinct().collect())
        chosen = self.spark.createDataFrame(self.choose(pairs), "run string, test_case string")
        self.df = lines.join(F.broadcast(chosen), ["run", "test_case"], "left_semi")

    def choose(self, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """The pairs of run and case to take."""
        import random

        rng, used, out, named = random.Random(self.seed), set(), [], self.single
        for run in sorted({r for r, _ in pairs})[: self.n_runs]:
            errors = [c for r, c in pairs if r == run and c != "correct"]
            if named == "random":
                if not errors:
                    continue
                named = rng.choice(errors)
            if named:
                if named not in errors:
                    continue
                taken = [named]
            else:
                free = errors if self.dup_errors else [e for e in errors if e not in used]
                taken = rng.sample(free, min(self.errors_per_run, len(free)))
                used.update(taken)
            out += [(run, c) for c in ["correct", *taken]]
        return out

    def preprocess(self):
        seq = F.concat_ws("__", "run", "test_case", "service")
        clock = F.regexp_extract(MESSAGE, r"^([0-9]{2}:[0-9]{2}:[0-9]{2}.[0-9]{3})", 1)
        time = F.coalesce(*(F.try_to_timestamp(F.concat(F.lit("1900-01-01 "), clock), F.lit(f"yyyy-MM-dd HH:mm:ss{s}SSS")) for s in (".", ",", ":")))
        df = self.df.withColumns({SEQUENCE: seq, "normal": F.col("test_case") == "correct", TIME: time})
        self.df = df.where(F.col(TIME).isNotNull())
        joined = F.array_join(in_row_order(F.col(MESSAGE)), "\n").alias(MESSAGE)
        self.df_seq = self.df.groupBy(SEQUENCE).agg(joined, F.bool_or("normal").alias("normal"), F.min(TIME).alias("start_time"), F.max(TIME).alias("end_time"))

    def load_metrics(self) -> DataFrame:
        """(run, test_case, metric_name, timestamp, value) of the node metrics."""
        schema = "metric struct<`__name__`: string, job: string>, `values` array<array<string>>"
        raw = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").schema(schema).json(self.filename, multiLine=True)
        path = F.col("_metadata.file_path")
        one = raw.select(folder_name(path, 3).alias("run"), folder_name(path, 2).alias("test_case"), F.col("metric.__name__").alias("metric_name"), F.col("metric.job").alias("job"), F.explode("values").alias("v")).where("job = 'node'")
        return one.select("run", "test_case", "metric_name", F.timestamp_seconds(F.get("v", F.lit(0)).cast("double")).alias("timestamp"), F.get("v", F.lit(1)).cast("double").alias("value"))


# The numeric metric columns, and the dates of either system's folders.
NEZHA_METRICS = (
    "CpuUsage(m)", "CpuUsageRate(%)", "MemoryUsage(Mi)", "MemoryUsageRate(%)", "SyscallRead", "SyscallWrite", "NetworkReceiveBytes",
    "NetworkTransmitBytes", "PodClientLatencyP90(s)", "PodServerLatencyP90(s)", "PodClientLatencyP95(s)", "PodServerLatencyP95(s)",
    "PodClientLatencyP99(s)", "PodServerLatencyP99(s)", "PodWorkload(Ops)", "PodSuccessRate(%)", "NodeCpuUsageRate(%)",
    "NodeMemoryUsageRate(%)", "NodeNetworkReceiveBytes",
)
NEZHA_DATES = {"WebShop": ("2022-08-22", "2022-08-23"), "TrainTicket": ("2023-01-29", "2023-01-30")}


class NezhaLoader(BaseLoader):
    """Logs, traces, metrics and fault labels of a microservice system.

    Folders rca_data are anomalous runs, construct_data normal ones; their date folders
    tell the system. After execute(): df, df_seq, df_trace, df_trace_seq, df_metric_default,
    df_label and df_rca.
    """

    def __init__(self, spark, filename=None, system="TrainTicket", df=None, df_seq=None):
        if system not in NEZHA_DATES:
            raise ValueError(f"Invalid system name: {system}. Valid options are: {', '.join(NEZHA_DATES)}")
        super().__init__(spark, filename, df, df_seq)
        self.system = system

    def _read(self, kind: str) -> DataFrame:
        """CSV files of one folder kind under every date; columns by name over all files."""
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(self.filename)
        fs = hadoop.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{self.filename}/*/*/{kind}"))
        folders = [f.getPath().toString() for f in found or []]
        other = {d for s, days in NEZHA_DATES.items() if s != self.system for d in days}
        folders = [f for f in folders if re.search("rca_data|construct_data", f) and not any(f"/{d}/" in f for d in other)]
        if kind == "metric":  # those of anomalous runs aren't read
            folders = [f for f in folders if "construct_data" in f]
        if not folders:
            raise ValueError(f"No {kind} folders under {self.filename}")
        out = None
        for folder in sorted(folders):
            raw = self.spark.read.csv(f"{folder}/*.csv", header=True, escape='"')
            path = F.col("_metadata.file_path")
            part = raw.select("*", F.lit(folder.split("/")[-2]).alias("date_folder"), base_name(path).alias("file_name"), F.lit("rca_data" in folder).alias("anomaly_folder"))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out.withColumn(ROW, F.monotonically_increasing_id())

    def load(self):
        self.df, self.df_trace, self.df_metric_default = self._read("log"), self._read("trace"), self._read("metric")
        self.df_label, self.df_rca = self._labels(), self._rca()

    def _json(self, pattern: str) -> list[tuple[str, str]]:
        files = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("wholetext", True).text(self.filename)
        return [(r["p"], r["value"]) for r in files.select(F.col("_metadata.file_path").alias("p"), "value").collect()]  # a few small files

    def _labels(self) -> DataFrame:
        import json

        rows = []
        for path, text in self._json("*fault_list.json"):
            name = path.rsplit("/", 1)[-1]
            for records in json.loads(text).values():
                rows += [(r.get("inject_time"), str(r.get("inject_timestamp")), r.get("inject_pod"), r.get("inject_type"), name[:10], name, "rca_data" in path) for r in records or ()]
        df = self.spark.createDataFrame(rows, "inject_time string, inject_timestamp string, inject_pod string, inject_type string, date_folder string, label_file_name string, anomaly_folder boolean")
        return df.withColumn(TIME, F.try_to_timestamp("inject_time", F.lit("yyyy-MM-dd HH:mm:ss")))

    def _rca(self) -> DataFrame:
        import json

        rows = [(path.rsplit("/", 1)[-1], service, {k: json.dumps(v) if not isinstance(v, str) else v for k, v in causes.items()}) for path, text in self._json("root_cause*.json") for service, causes in json.loads(text).items()]
        return self.spark.createDataFrame(rows, "file_name string, service string, causes map<string, string>")

    def preprocess(self):
        raw = "Log" if "Log" in self.df.columns else "raw_m_message"
        leak = "Inject cpu successfully"  # fixed value: what fault injection left in the logs
        df = self.df.withColumn("raw_m_message", first_only(first_only(F.col(raw), leak), leak))
        if self.system == "WebShop":
            inner = F.from_json(F.from_json("raw_m_message", T.StructType().add("log", "string"))["log"], T.StructType().add("message", "string").add("severity", "string"))
            sound = F.contains("raw_m_message", F.lit("message")) & F.contains("raw_m_message", F.lit("severity"))
            text, severity = F.when(sound, inner["message"]).otherwise(F.col("raw_m_message")), F.when(sound, inner["severity"])
        else:
            broken = "}ulate distance]"
            cut = F.substring_index("raw_m_message", broken, 1)
            fixed = F.when(F.contains("raw_m_message", F.lit(broken)), F.concat(cut, F.lit("}"))).otherwise(F.col("raw_m_message"))
            text = F.coalesce(F.from_json(fixed, T.StructType().add("log", "string"))["log"], F.col("raw_m_message"))
            severity = F.get(F.split(text, " "), F.lit(1))
        df = df.withColumns({"_text": text, "severity": severity})
        at = F.expr("locate(SpanID, _text)")
        after = F.when(at > 0, F.substr("_text", at + F.char_length("SpanID")))
        message = F.regexp_replace(F.regexp_replace(F.substring_index(after, '",', 1), r"^\s+", ""), r"[\n\\]+$", "")
        stamp = "Timestamp"
        time = F.coalesce(F.try_to_timestamp(F.regexp_replace(stamp, r"(\.[0-9]{6})[0-9]*Z$", "$1"), F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")))
        df = df.withColumns({MESSAGE: message, TIME: time}).drop("_text")
        trace = self.df_trace.withColumns({TIME: epoch_nanos("StartTimeUnixNano"), "m_timestamp_end": epoch_nanos("EndTimeUnixNano")})
        metric = self.df_metric_default.withColumn(TIME, F.try_to_timestamp(F.regexp_replace("Time", r"(\.[0-9]{1,6})[0-9]* \+0000.*$| \+0000.*$", "$1"), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]")))
        metric = metric.withColumns({c: F.expr(f"try_cast(`{c}` AS double)") for c in NEZHA_METRICS if c in metric.columns})
        labels = self.df_label.select("inject_pod", F.col(TIME).alias("label_time"), "inject_type")
        name = F.concat_ws(" ", "date_folder", "file_name", "PodName")
        label = lambda d: label_range_join(d, labels, "PodName", TIME, "inject_pod", "label_time").drop("inject_pod", "label_time").withColumn(SEQUENCE, name)
        self.df, self.df_trace = label(df), label(trace)
        self.df_metric_default = graded_label_ratio(metric, labels, "PodName", TIME, "inject_pod", "label_time")
        share = lambda d: d.groupBy(SEQUENCE).agg(F.avg(F.col("anomaly").cast("int")).alias("ano_count")).withColumn("anomaly", F.col("ano_count") > 0)
        self.df_seq, self.df_trace_seq = share(self.df), share(self.df_trace)


def epoch_nanos(text: str) -> Column:
    """The time of nanoseconds as text; those that begin with -6 for 16 are one digit too long."""
    broken = F.col(text).startswith("-6")
    whole = F.when(broken, F.concat(F.lit("16"), F.substr(text, F.lit(3), F.char_length(text) - 3))).otherwise(F.col(text))
    return F.timestamp_micros((whole.cast("decimal(20,0)") / 1000).cast("long"))


def epoch_seconds(text: str) -> Column:
    """The time of seconds as text; those that begin with 18 are meant to begin with 16."""
    return F.timestamp_seconds(F.regexp_replace(text, "^18", "16").cast("long"))


LOADERS = {c.__name__: c for c in (HDFSLoader, BGLLoader, ThuSpiLibLoader, HadoopLoader, ProLoader, NezhaLoader, ADFALoader, AWSCTDLoader, GELFLoader, LO2Loader)}


def load(spark: SparkSession, name: str, filename: str, **options) -> DataFrame:
    """The events of a data set, by its loader's name."""
    return LOADERS[name](spark, filename, **options).execute()
