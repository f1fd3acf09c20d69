"""Queries of loaders and sinks: the driver's tables written as files of each layout, and loaded.

The files lie in the folder of scratch tables and go with it. The SQL has what a loader
makes of them straight from the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import micros
from ..scratch import scratch_path
from ..sources import sinks
from ..sources import structured as s
from ..sources.raw import RawLoader
from ..sources.tables import log_documents, log_events, table
from .enrichment import EVENTS

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _stamp(pattern: str):
    return F.date_format("m_timestamp", pattern)


def _text(*parts):
    """Columns and literal strings, one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _files(spark, sf, file, value, log: DataFrame | None = None) -> str:
    """Lines of events in files, both given as columns; the folder."""
    path = scratch_path(spark, "files")
    log = log_events(spark, sf).withColumn("user_id", F.col("seq_id").cast("long")) if log is None else log
    sinks.write_files(log.select("row_id", file.alias("file"), value.alias("value")), path)
    return path


def _time(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


SECOND = "date_trunc('second', m_timestamp)"
BY_TYPE = f"WITH {EVENTS}, e AS (SELECT *, CAST(seq_id AS BIGINT) AS user_id, '/' || event_type || '/day.log' AS file_name, {SECOND} AS sec FROM events_log)"
GAPS = BY_TYPE + """, g AS (SELECT *, CASE WHEN row_id % 3 = 0 THEN sec END AS t, CASE WHEN row_id % 3 = 0 THEN ' ' ELSE '' END || m_message AS m FROM e)
"""


def _raw(spark, sf, gaps: bool, action: str = "keep") -> DataFrame:
    line = _text(_stamp("yyyy-MM-dd HH:mm:ss"), " ", F.col("m_message"))
    line = F.when(F.col("row_id") % 3 == 0, line).otherwise(F.col("m_message")) if gaps else line
    path = _files(spark, sf, _text(F.col("event_type"), "/day.log"), line)
    loader = RawLoader(spark, path, "*.log", strip_full_data_path=re.sub("^file:/+", "/", path), timestamp_pattern="^([0-9-]{10} [0-9:]{8})", timestamp_format="yyyy-MM-dd HH:mm:ss", missing_timestamp_action=action)
    return _time(loader.execute(), "m_timestamp")


@query(r"SELECT line AS m_message, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS line FROM documents) GROUP BY 1")
def raw_lines(spark, sf):
    path = scratch_path(spark, "lines")
    sinks.write_lines(log_documents(spark, sf).select("m_message"), path)
    return RawLoader(spark, path).execute().groupBy("m_message").agg(F.count("*").alias("n"))


@query(BY_TYPE + " SELECT file_name, sec AS m_timestamp, ' ' || m_message AS m_message FROM e")
def raw_tree(spark, sf):
    return _raw(spark, sf, False).select("file_name", "m_timestamp", "m_message")


@query(BY_TYPE + " SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY row_id) AS place, ' ' || m_message AS m_message FROM e")
def raw_row_order(spark, sf):
    """row_id is the order of lines in their file."""
    log = _raw(spark, sf, False)
    return log.select("file_name", F.row_number().over(Window.partitionBy("file_name").orderBy("row_id")).cast("long").alias("place"), "m_message")


@query(GAPS + "SELECT file_name, t AS m_timestamp, m AS m_message FROM g")
def raw_times_keep(spark, sf):
    return _raw(spark, sf, True).select("file_name", "m_timestamp", "m_message")


@query(GAPS + "SELECT file_name, t AS m_timestamp, m AS m_message FROM g WHERE t IS NOT NULL")
def raw_times_drop(spark, sf):
    return _raw(spark, sf, True, "drop").select("file_name", "m_timestamp", "m_message")


@query(GAPS + "SELECT file_name, last_value(t IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS m_timestamp, m AS m_message FROM g")
def raw_times_last(spark, sf):
    return _raw(spark, sf, True, "fill-lastseen").select("file_name", "m_timestamp", "m_message")


@query(GAPS + "SELECT file_name, first_value(t IGNORE NULLS) OVER (PARTITION BY file_name ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m_timestamp, m AS m_message FROM g")
def raw_times_next(spark, sf):
    return _raw(spark, sf, True, "fill-next").select("file_name", "m_timestamp", "m_message")


@query(GAPS + """, k AS (SELECT *, count(t) OVER (PARTITION BY file_name ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT file_name, min(t) AS m_timestamp, arg_min(m, row_id) AS m_message, string_agg(m, chr(10) ORDER BY row_id) FILTER (WHERE t IS NULL) AS trace FROM k GROUP BY file_name, k""")
def raw_times_merge(spark, sf):
    return _raw(spark, sf, True, "merge").select("file_name", "m_timestamp", "m_message", "trace")


FILE_DAY = 1_709_640_000  # the time that raw_file_dates gives its files: 2024-03-05 12:00 UTC


@query(BY_TYPE + """ SELECT (CASE WHEN strftime(m_timestamp, '%H:%M:%S') > '23:00:00' THEN DATE '2024-03-04' ELSE DATE '2024-03-05' END) + CAST(sec AS TIME) AS m_timestamp, ' ' || m_message AS m_message FROM e""")
def raw_file_dates(spark, sf):
    path = _files(spark, sf, _text(F.col("event_type"), ".log"), _text(_stamp("HH:mm:ss"), " ", F.col("m_message")))
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    files = to_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for f in files.listStatus(to_path(path)):
        files.setTimes(f.getPath(), FILE_DAY * 1000, -1)
    loader = RawLoader(spark, path, timestamp_pattern="^([0-9:]{8})", timestamp_format="HH:mm:ss", date_from_files=True)
    return _time(loader.execute(), "m_timestamp").select("m_timestamp", "m_message")


@query(f"WITH {EVENTS} SELECT row_id, m_message, anomaly, NOT anomaly AS normal FROM events_log")
def loader_given_frames(spark, sf):
    return RawLoader(spark, df=log_events(spark, sf)).execute().select("row_id", "m_message", "anomaly", "normal")


@query("SELECT event_id, event_type, value FROM events")
def sink_parquet(spark, sf):
    path = scratch_path(spark, "sink")
    sinks.write_parquet(table(spark, sf, "events").select("event_id", "event_type", "value"), path, ("event_type",))
    return spark.read.parquet(path).select("event_id", "event_type", "value")


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source FROM documents")
def sink_tsv(spark, sf):
    path = scratch_path(spark, "sink")
    sinks.write_tsv(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"), path)
    return spark.read.csv(path, sep="\t", header=True, multiLine=True).select("doc_id", "text", "lang", "source")


@query("SELECT c_custkey || ' ' || c_name || ' ' || c_mktsegment AS line FROM customer")
def sink_lines(spark, sf):
    path = scratch_path(spark, "sink")
    sinks.write_lines(table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(r"""SELECT '\begin{tabular}{ll}' || chr(10) || 'r\_regionkey & r\_name \\' || chr(10) || string_agg(r_regionkey || ' & ' || replace(r_name, '_', '\_'), ' \\' || chr(10) ORDER BY r_regionkey) || ' \\' || chr(10) || '\end{tabular}' || chr(10) AS latex FROM region""")
def sink_latex(spark, sf):
    small = table(spark, sf, "region").select("r_regionkey", "r_name").orderBy("r_regionkey")
    return spark.createDataFrame([(sinks.latex_table(small),)], "latex string")


def _hdfs(spark, sf):
    line = _text(_stamp("yyMMdd"), " ", _stamp("HHmmss"), " ", F.col("row_id").cast("string"), " INFO dfs.", F.col("event_type"), ": got blk_-", F.col("seq_id"), " ", F.col("m_message"))
    path = _files(spark, sf, F.lit("hdfs.log"), line)
    labels = log_events(spark, sf).groupBy("seq_id").agg(F.max("anomaly").alias("bad")).select(_text("blk_-", F.col("seq_id")).alias("BlockId"), F.when(F.col("bad"), "Anomaly").otherwise("Normal").alias("Label"))
    target = scratch_path(spark, "labels")
    labels.write.csv(target, header=True)
    loader = s.HDFSLoader(spark, path, labels_file_name=target)
    loader.execute()
    return loader


@query(BY_TYPE + " SELECT CAST(row_id AS VARCHAR) AS id, strftime(sec, '%y%m%d') AS date, 'dfs.' || event_type || ':' AS component, 'blk_-' || seq_id AS seq_id, sec AS m_timestamp, 'got blk_-' || seq_id || ' ' || m_message AS m_message FROM e")
def hdfs_events(spark, sf):
    return _time(_hdfs(spark, sf).df, "m_timestamp").select("id", "date", "component", "seq_id", "m_timestamp", "m_message")


@query(f"WITH {EVENTS} SELECT 'blk_-' || seq_id AS seq_id, CASE WHEN bool_or(anomaly) THEN 'Anomaly' ELSE 'Normal' END AS \"Label\", NOT bool_or(anomaly) AS normal, bool_or(anomaly) AS anomaly FROM events_log GROUP BY ALL")
def hdfs_sequences(spark, sf):
    """Labels joined with the sequences that the log has."""
    return _hdfs(spark, sf).df_seq.select("seq_id", "Label", "normal", "anomaly")


def _label():
    return F.when(F.col("anomaly"), "ERR").otherwise("-")


def _epoch():
    return F.floor(micros("m_timestamp") / 1_000_000).cast("string")


@query(BY_TYPE + " SELECT CASE WHEN anomaly THEN 'ERR' ELSE '-' END AS label, 'n' || seq_id AS node, event_type AS component, sec AS m_timestamp, NOT anomaly AS normal, anomaly, m_message FROM e")
def bgl_events(spark, sf):
    line = _text(_label(), " ", _epoch(), " ", _stamp("yyyy.MM.dd"), " n", F.col("seq_id"), " ", _stamp("HH:mm:ss"), " n", F.col("seq_id"), " RAS ", F.col("event_type"), " INFO ", F.col("m_message"))
    return _time(s.BGLLoader(spark, _files(spark, sf, F.lit("bgl.log"), line)).execute(), "m_timestamp").select("label", "node", "component", "m_timestamp", "normal", "anomaly", "m_message")


@query(BY_TYPE + " SELECT CASE WHEN anomaly THEN 'ERR' ELSE '-' END AS label, event_type AS component, CASE WHEN row_id % 2 = 0 THEN CAST(row_id AS VARCHAR) END AS pid, sec AS m_timestamp, anomaly, m_message FROM e")
def thunderbird_events(spark, sf):
    daemon = F.when(F.col("row_id") % 2 == 0, _text(F.col("event_type"), "[", F.col("row_id").cast("string"), "]:")).otherwise(_text(F.col("event_type"), ":"))
    line = _text(_label(), " ", _epoch(), " ", _stamp("yyyy.MM.dd"), " u", F.col("seq_id"), " Jan ", _stamp("d HH:mm:ss"), " u/u ", daemon, " ", F.col("m_message"))
    return _time(s.ThuSpiLibLoader(spark, _files(spark, sf, F.lit("t.log"), line)).execute(), "m_timestamp").select("label", "component", "pid", "m_timestamp", "anomaly", "m_message")


def _hadoop(spark, sf):
    line = _text(_stamp("yyyy-MM-dd HH:mm:ss,SSS"), " INFO [main ", F.col("seq_id"), "] org.", F.col("event_type"), ": ", F.col("m_message"), F.when(F.col("row_id") % 4 == 0, "\n\tat  trace").otherwise(""))
    path = _files(spark, sf, _text("logs/app_", F.col("event_type"), "/c.log"), line)
    kinds = log_events(spark, sf).select("event_type").distinct()
    labels = _text(F.when(F.col("event_type") == "error", "Machine down:").otherwise("Normal:"), "\n+ app_", F.col("event_type"))
    sinks.write_files(kinds.select(F.lit("labels.txt").alias("file"), F.col("event_type").alias("row_id"), _text("### App\n", labels).alias("value")), f"{path}/names")
    loader = s.HadoopLoader(spark, f"{path}/logs", labels_file_name=f"{path}/names/labels.txt")
    loader.execute()
    return loader


@query(BY_TYPE + " SELECT 'app_' || event_type AS seq_id, 'main ' || seq_id AS process, 'org.' || event_type || ':' AS component, date_trunc('millisecond', m_timestamp) AS m_timestamp, m_message || CASE WHEN row_id % 4 = 0 THEN ' at trace' ELSE '' END AS m_message FROM e")
def hadoop_events(spark, sf):
    return _time(_hadoop(spark, sf).df, "m_timestamp").select("seq_id", "process", "component", "m_timestamp", "m_message")


@query("SELECT DISTINCT 'app_' || event_type AS seq_id, 'App' AS app_name, CASE WHEN event_type = 'error' THEN 'Machine down' ELSE 'Normal' END AS \"Label\", event_type <> 'error' AS normal FROM events")
def hadoop_sequences(spark, sf):
    return _hadoop(spark, sf).df_seq.select("seq_id", "app_name", "Label", "normal")


def _profilence(spark, sf):
    line = _text(F.col("row_id").cast("string"), "  ", _stamp("dd.MM.yyyy HH:mm:ss.SSS"), " sys 1 2 ", F.col("event_type"), "  ", F.col("m_message"))
    loader = s.ProLoader(spark, _files(spark, sf, _text(F.when(F.col("event_type") == "error", "fail_").otherwise("success_"), F.col("seq_id"), ".txt"), line))
    loader.execute()
    return loader


@query(BY_TYPE + " SELECT CASE WHEN anomaly THEN 'fail_' ELSE 'success_' END || seq_id || '.txt' AS seq_id, event_type AS log_level, date_trunc('millisecond', m_timestamp) AS m_timestamp, m_message FROM e")
def profilence_events(spark, sf):
    return _time(_profilence(spark, sf).df, "m_timestamp").select("seq_id", "log_level", "m_timestamp", "m_message")


@query(f"WITH {EVENTS} SELECT DISTINCT CASE WHEN anomaly THEN 'fail_' ELSE 'success_' END || seq_id || '.txt' AS seq_id, NOT anomaly AS normal FROM events_log")
def profilence_sequences(spark, sf):
    return _profilence(spark, sf).df_seq.select("seq_id", "normal")


CALLS = f"WITH {EVENTS}, c AS (SELECT *, CAST(seq_id AS BIGINT) % 4 = 0 AS attack FROM events_log)"


def _calls(spark, sf, separator: str):
    """A row for each user, with the types of the user's events in one line, or two."""
    events = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "event_type"))), lambda x: x["event_type"])
    return log_events(spark, sf).groupBy("seq_id").agg(F.array_join(events, separator).alias("calls")).withColumn("user_id", F.col("seq_id").cast("long")).withColumn("row_id", F.col("user_id"))


def _adfa(spark, sf):
    attack = F.col("user_id") % 4 == 0
    file = F.when(attack, _text("Attack_Data_Master/Web_Shell_", (F.col("user_id") % 10).cast("string"), "/UAD-", F.col("seq_id"), ".txt")).otherwise(_text("Training_Data_Master/UTD-", F.col("seq_id"), ".txt"))
    loader = s.ADFALoader(spark, _files(spark, sf, file, _text(F.col("calls"), " "), _calls(spark, sf, " ")))
    loader.execute()
    return loader


@query(CALLS + " SELECT CASE WHEN attack THEN 'UAD-' ELSE 'UTD-' END || seq_id AS seq_id, CASE WHEN attack THEN 'Web_Shell' ELSE 'Normal' END AS label, row_number() OVER (PARTITION BY seq_id ORDER BY row_id) AS place, event_type AS m_message, attack AS anomaly FROM c")
def adfa_events(spark, sf):
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("row_id")).cast("long")
    return _adfa(spark, sf).df.select("seq_id", "label", place.alias("place"), "m_message", "anomaly")


@query(CALLS + " SELECT CASE WHEN attack THEN 'UAD-' ELSE 'UTD-' END || seq_id AS seq_id, CASE WHEN attack THEN 'Web_Shell' ELSE 'Normal' END AS label, string_agg(event_type, ' ' ORDER BY row_id) AS calls, NOT attack AS normal FROM c GROUP BY ALL")
def adfa_sequences(spark, sf):
    return _adfa(spark, sf).df_seq.select("seq_id", "label", F.array_join("m_message", " ").alias("calls"), "normal")


def _awsctd(spark, sf):
    line = _text(F.col("calls"), F.when(F.col("user_id") % 4 == 0, ",Worm").otherwise(",Clean"))
    loader = s.AWSCTDLoader(spark, _files(spark, sf, _text("set/", (F.col("user_id") % 20).cast("string"), ".csv"), line, _calls(spark, sf, ",")))
    loader.execute()
    return loader


@query(CALLS + " SELECT CASE WHEN attack THEN 'Worm' ELSE 'Normal' END AS label, event_type AS m_message, attack AS anomaly, count(*) AS n FROM c GROUP BY ALL")
def awsctd_events(spark, sf):
    return _awsctd(spark, sf).df.groupBy("label", "m_message", "anomaly").agg(F.count("*").alias("n"))


@query(CALLS + " SELECT CASE WHEN attack THEN 'Worm' ELSE 'Normal' END AS label, string_agg(event_type, ' ' ORDER BY row_id) AS calls, NOT attack AS normal FROM c GROUP BY seq_id, attack")
def awsctd_sequences(spark, sf):
    return _awsctd(spark, sf).df_seq.select("label", F.array_join("m_message", " ").alias("calls"), "normal")


@query(f"WITH {EVENTS} SELECT row_id AS id, event_type AS level, m_message, date_trunc('millisecond', m_timestamp) AS m_timestamp FROM events_log")
def gelf_events(spark, sf):
    path = scratch_path(spark, "gelf")
    stamp = _stamp("yyyy-MM-dd'T'HH:mm:ss.SSS")
    log_events(spark, sf).select(F.col("row_id").alias("id"), F.col("event_type").alias("level"), F.col("m_message").alias("message"), stamp.alias("@timestamp")).write.json(path)
    return _time(s.GELFLoader(spark, path).execute(), "m_timestamp").select("id", "level", "m_message", "m_timestamp")


LO2 = BY_TYPE + """, l AS (SELECT 'run_' || (user_id % 3) AS run, CASE WHEN event_type = 'view' THEN 'correct' ELSE event_type END AS test_case, TIMESTAMP '1900-01-01 00:00:00' + (date_trunc('millisecond', m_timestamp) - date_trunc('day', m_timestamp)) AS m_timestamp,
 strftime(m_timestamp, '%H:%M:%S.%g') || ' ' || m_message AS m_message, row_id FROM e)
"""


def _lo2(spark, sf):
    case = F.when(F.col("event_type") == "view", "correct").otherwise(F.col("event_type"))
    file = _text("run_", (F.col("user_id") % 3).cast("string"), "/", case, "/token.log")
    line = _text(_stamp("HH:mm:ss.SSS"), " ", F.col("m_message"), F.when(F.col("row_id") % 5 == 0, "\n\nno time here").otherwise(""))
    loader = s.LO2Loader(spark, _files(spark, sf, file, line), errors_per_run=99)
    loader.execute()
    return loader


@query(LO2 + "SELECT run || '__' || test_case || '__token' AS seq_id, run, test_case, m_timestamp, test_case = 'correct' AS normal, m_message FROM l")
def lo2_events(spark, sf):
    return _time(_lo2(spark, sf).df, "m_timestamp").select("seq_id", "run", "test_case", "m_timestamp", "normal", "m_message")


@query(LO2 + "SELECT run || '__' || test_case || '__token' AS seq_id, string_agg(m_message, chr(10) ORDER BY row_id) AS m_message, bool_or(test_case = 'correct') AS normal, min(m_timestamp) AS start_time, max(m_timestamp) AS end_time FROM l GROUP BY 1")
def lo2_sequences(spark, sf):
    return _time(_lo2(spark, sf).df_seq, "start_time", "end_time").select("seq_id", "m_message", "normal", "start_time", "end_time")


@query("SELECT 'r' || (user_id % 3) AS run, event_type AS test_case, 'cpu' AS metric_name, event_id AS second, value FROM events")
def lo2_metrics(spark, sf):
    e = table(spark, sf, "events")
    values = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: F.concat(F.lit("["), x["event_id"].cast("string"), F.lit(', "'), x["value"].cast("string"), F.lit('"]'))), ", ")
    files = e.groupBy(_text("r", (F.col("user_id") % 3).cast("string"), "/", F.col("event_type"), "/metrics/m.json").alias("file")).agg(values.alias("v"))
    text = _text('[{"metric": {"__name__": "cpu", "job": "node"}, "values": [', F.col("v"), ']}, {"metric": {"__name__": "x", "job": "other"}, "values": [[1, "2"]]}]')
    path = scratch_path(spark, "metrics")
    sinks.write_files(files.select("file", F.lit(0).alias("row_id"), text.alias("value")), path)
    out = s.LO2Loader(spark, path).load_metrics()
    return out.select("run", "test_case", "metric_name", F.unix_seconds("timestamp").alias("second"), "value")


# A microservice log of two pods a type; faults are the errors of event ids that end in 00.
NEZHA = BY_TYPE + """, f AS (SELECT ts, 'pod-' || (user_id % 7) AS pod FROM events WHERE event_type = 'error' AND event_id % 100 < 20),
n AS (SELECT e.*, 'pod-' || (user_id % 7) AS pod, date_trunc('second', f.ts) AS fault FROM e LEFT JOIN (SELECT DISTINCT date_trunc('second', ts) AS ts, pod FROM f) f ON 'pod-' || (user_id % 7) = f.pod AND e.m_timestamp > f.ts AND e.m_timestamp <= f.ts + INTERVAL 3 MINUTE)
"""


def _csv(df: DataFrame, path: str) -> None:
    df.write.option("escape", '"').option("quoteAll", True).csv(path, header=True)


def _nezha(spark, sf, system: str):
    """Logs, traces and metrics as CSV files and faults as JSON, of one date folder."""
    day = s.NEZHA_DATES[system][0]
    root = scratch_path(spark, "nezha")
    base = f"{root}/rca_data/{day}"
    e = log_events(spark, sf).withColumn("pod", _text("pod-", (F.col("seq_id").cast("long") % 7).cast("string")))
    span = _text("s", F.col("row_id").cast("string"))
    if system == "TrainTicket":
        plain = _text("09:33 ", F.upper("event_type"), " TraceID: t SpanID: ", span, " ", F.col("m_message"), "\n")
        log = F.to_json(F.struct(plain.alias("log"), F.lit("stdout").alias("stream")))
        log = F.when(F.col("row_id") % 10 == 0, F.concat(log, F.lit("ulate distance] left over"))).otherwise(log)
    else:
        inner = F.to_json(F.struct(F.upper("event_type").alias("severity"), _text("TraceID: t SpanID: ", span, " ", F.col("m_message")).alias("message")))
        log = F.to_json(F.struct(inner.alias("log")))
    log = F.concat(F.when(F.col("row_id") % 9 == 0, "Inject cpu successfully").otherwise(""), log)
    _csv(e.select(_text(_stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "123Z").alias("Timestamp"), F.col("row_id").alias("TimeUnixNano"), F.col("pod").alias("PodName"), span.alias("SpanID"), log.alias("Log")), f"{base}/log")
    at = micros("m_timestamp")
    _csv(e.select((at * 1000).alias("StartTimeUnixNano"), (at * 1000 + F.col("row_id") * 1000).alias("EndTimeUnixNano"), F.col("pod").alias("PodName"), span.alias("SpanID")), f"{base}/trace")
    _csv(e.select(_text(_stamp("yyyy-MM-dd HH:mm:ss.SSSSSS"), "001 +0000 UTC").alias("Time"), F.col("pod").alias("PodName"), F.col("row_id").alias("CpuUsage(m)"), F.lit("n/a").alias("SyscallRead")), f"{root}/construct_data/{day}/metric")
    faults = e.where("anomaly AND row_id % 100 < 20").select(F.col("pod").alias("inject_pod"), _stamp("yyyy-MM-dd HH:mm:ss").alias("inject_time"), F.lit("cpu").alias("inject_type"), F.lit("1").alias("inject_timestamp")).distinct()
    listed = faults.agg(F.to_json(F.create_map(F.lit("1"), F.array_sort(F.collect_list(F.struct(*faults.columns))))).alias("value"))
    sinks.write_files(listed.select(F.lit(f"{day}-fault_list.json").alias("file"), F.lit(0).alias("row_id"), "value"), f"{base}/faults")
    loader = s.NezhaLoader(spark, root, system)
    loader.execute()
    return loader


@query(NEZHA + "SELECT 's' || row_id AS span, pod, upper(event_type) AS severity, m_message, m_timestamp, fault IS NOT NULL AS anomaly, CASE WHEN fault IS NOT NULL THEN 'cpu' END AS inject_type FROM n")
def nezha_logs(spark, sf):
    """JSON fields, broken JSON, the cut message, leaked words and labels of one system."""
    return _time(_nezha(spark, sf, "TrainTicket").df, "m_timestamp").select(F.col("SpanID").alias("span"), F.col("PodName").alias("pod"), "severity", "m_message", "m_timestamp", "anomaly", "inject_type")


@query(NEZHA + "SELECT 's' || row_id AS span, pod, upper(event_type) AS severity, m_message, fault IS NOT NULL AS anomaly FROM n")
def nezha_webshop_logs(spark, sf):
    """The other system's log: JSON inside JSON."""
    return _nezha(spark, sf, "WebShop").df.select(F.col("SpanID").alias("span"), F.col("PodName").alias("pod"), "severity", "m_message", "anomaly")


@query(NEZHA + "SELECT 's' || row_id AS span, m_timestamp, m_timestamp + to_microseconds(row_id) AS m_timestamp_end, fault IS NOT NULL AS anomaly FROM n")
def nezha_traces(spark, sf):
    return _time(_nezha(spark, sf, "TrainTicket").df_trace, "m_timestamp", "m_timestamp_end").select(F.col("SpanID").alias("span"), "m_timestamp", "m_timestamp_end", "anomaly")


@query(NEZHA + """, j AS (SELECT e.row_id, (epoch_us(e.m_timestamp) - epoch_us(f.ts)) / 60000000 AS m FROM e LEFT JOIN (SELECT DISTINCT date_trunc('second', ts) AS ts, pod FROM f) f ON 'pod-' || (user_id % 7) = f.pod AND e.m_timestamp > f.ts AND e.m_timestamp <= f.ts + INTERVAL 4 MINUTE)
SELECT CAST(row_id AS DOUBLE) AS cpu, CAST(NULL AS DOUBLE) AS syscalls, round(CASE WHEN m IS NULL THEN 0 WHEN m < 1 THEN m WHEN m <= 3 THEN 1 WHEN m < 4 THEN 4 - m ELSE 0 END, 6) AS ratio FROM j""")
def nezha_metrics(spark, sf):
    return _nezha(spark, sf, "TrainTicket").df_metric_default.select(F.col("CpuUsage(m)").alias("cpu"), F.col("SyscallRead").alias("syscalls"), F.round("ratio", 6).alias("ratio"))


@query(NEZHA + "SELECT pod, avg(CAST(fault IS NOT NULL AS INTEGER)) > 0 AS anomaly, round(avg(CAST(fault IS NOT NULL AS INTEGER)), 6) AS ano_count FROM n GROUP BY pod")
def nezha_sequences(spark, sf):
    seq = _nezha(spark, sf, "TrainTicket").df.withColumn("seq_id", F.col("PodName"))
    return seq.groupBy(F.col("seq_id").alias("pod")).agg((F.avg(F.col("anomaly").cast("int")) > 0).alias("anomaly"), F.round(F.avg(F.col("anomaly").cast("int")), 6).alias("ano_count"))
