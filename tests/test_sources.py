import datetime as dt
import os

import pytest
from tracewright.sources import structured as s
from tracewright.sources.raw import RawLoader


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("row_id").select(*columns).collect()]


def test_raw_lines_and_times(spark, tmp_path):
    write(f"{tmp_path}/a/x.log", "2020-01-01 10:00:00 one\n  at two\n\n2020-01-01 10:00:01 three\n")
    write(f"{tmp_path}/b/y.log", "lead\n2020-01-02 10:00:00 four\n")
    write(f"{tmp_path}/b/z.txt", "no\n")
    write(f"{tmp_path}/b/bad.log", b"\xff2020-01-03 10:00:00 broken\n")
    make = lambda **k: RawLoader(spark, str(tmp_path), "*.log", strip_full_data_path=str(tmp_path), timestamp_pattern=r"([0-9-]{10} [0-9:]{8})", timestamp_format="yyyy-MM-dd HH:mm:ss", **k).execute()
    kept = rows(make(), "file_name", "m_message")
    assert [k for k in kept if k[0] == "/a/x.log"] == [("/a/x.log", " one"), ("/a/x.log", "  at two"), ("/a/x.log", ""), ("/a/x.log", " three")]
    assert len(kept) == 7
    assert len(rows(make(missing_timestamp_action="drop"), "row_id")) == 4
    merged = rows(make(missing_timestamp_action="merge"), "file_name", "m_message", "trace", "m_timestamp")
    assert ("/a/x.log", " one", "  at two\n", dt.datetime(2020, 1, 1, 10)) in merged and ("/a/x.log", " three", None, dt.datetime(2020, 1, 1, 10, 0, 1)) in merged
    last = dict(((r[0], r[1]), r[2]) for r in rows(make(missing_timestamp_action="fill-lastseen"), "file_name", "m_message", "m_timestamp"))
    assert last["/a/x.log", ""] == dt.datetime(2020, 1, 1, 10) and last["/b/y.log", "lead"] is None
    nxt = dict(((r[0], r[1]), r[2]) for r in rows(make(missing_timestamp_action="fill-next"), "file_name", "m_message", "m_timestamp"))
    assert nxt["/b/y.log", "lead"] == dt.datetime(2020, 1, 2, 10) and nxt["/a/x.log", ""] == dt.datetime(2020, 1, 1, 10, 0, 1)
    with pytest.raises(ValueError):
        RawLoader(spark, str(tmp_path), missing_timestamp_action="other")
    with pytest.raises(ValueError):
        RawLoader(spark, str(tmp_path), "*.none").execute()


def test_raw_dates_from_files(spark, tmp_path):
    path = f"{tmp_path}/t.log"
    write(path, "23:30:00 late\n00:10:00 early\n")
    at = dt.datetime(2021, 5, 5, 1, 0, tzinfo=dt.timezone.utc).timestamp()
    os.utime(path, (at, at))
    df = RawLoader(spark, path, strip_full_data_path=str(tmp_path), timestamp_pattern="^([0-9:]{8})", timestamp_format="HH:mm:ss", date_from_files=True).execute()
    assert rows(df, "m_timestamp") == [(dt.datetime(2021, 5, 4, 23, 30),), (dt.datetime(2021, 5, 5, 0, 10),)]


def test_block_store(spark, tmp_path):
    write(f"{tmp_path}/h.log", "081109 203615 148 INFO dfs.X: Receiving block blk_-16 src: /10 a\n081109 203616 149 WARN dfs.Y: of blk_7\nshort\n")
    write(f"{tmp_path}/l.csv", "BlockId,Label\nblk_-16,Normal\nblk_7,Anomaly\n")
    loader = s.HDFSLoader(spark, f"{tmp_path}/h.log", labels_file_name=f"{tmp_path}/l.csv")
    assert rows(loader.execute(), "seq_id", "component", "m_message", "m_timestamp") == [
        ("blk_-16", "dfs.X:", "Receiving block blk_-16 src: /10 a", dt.datetime(2008, 11, 9, 20, 36, 15)),
        ("blk_7", "dfs.Y:", "of blk_7", dt.datetime(2008, 11, 9, 20, 36, 16)),
        (None, None, None, None),
    ]
    assert sorted((r.seq_id, r.normal, r.anomaly) for r in loader.df_seq.collect()) == [("blk_-16", True, False), ("blk_7", False, True)]


def test_supercomputers(spark, tmp_path):
    write(f"{tmp_path}/b.log", "- 1117838570 2005.06.03 R02 2005-06-03-15 R02 RAS KERNEL INFO a b c\nAPPREAD 1117838571 2005.06.03 R02 2005-06-03-15 R02 RAS KERNEL FATAL x\n")
    assert rows(s.BGLLoader(spark, f"{tmp_path}/b.log").execute(), "m_message", "normal", "anomaly", "m_timestamp") == [("a b c", True, False, dt.datetime(2005, 6, 3, 22, 42, 50)), ("x", False, True, dt.datetime(2005, 6, 3, 22, 42, 51))]
    write(f"{tmp_path}/t.log", "- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(pam_unix)[2915]: session closed\nX 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 kernel: oops now\n")
    assert rows(s.ThuSpiLibLoader(spark, f"{tmp_path}/t.log").execute(), "component", "pid", "m_message") == [("crond(pam_unix)", "2915", "session closed"), ("kernel", None, "oops now")]
    assert rows(s.ThuSpiLibLoader(spark, f"{tmp_path}/t.log", split_component=False).execute(), "m_message")[1] == ("kernel: oops now",)


def test_hadoop(spark, tmp_path):
    write(f"{tmp_path}/logs/app_1/c1.log", "orphan\n2015-10-17 15:37:56,547 INFO [main] org.X: Created  app\n\tat trace [x]\n2015-10-17 15:37:57,547 WARN [t 2] org.Y:\n")
    write(f"{tmp_path}/logs/app_2/c1.log", "2015-10-17 15:37:56,000 INFO [main] org.X: other\n")
    write(f"{tmp_path}/labels.txt", "### WordCount\nNormal:\n+ app_1\nMachine down:\n+ app_2\n+ app_9\n")
    loader = s.HadoopLoader(spark, f"{tmp_path}/logs", labels_file_name=f"{tmp_path}/labels.txt")
    got = rows(loader.execute(), "seq_id", "process", "component", "m_message", "m_timestamp")
    assert got[1:] == [("app_1", "main", "org.X:", "Created app at trace [x]", dt.datetime(2015, 10, 17, 15, 37, 56, 547000)), ("app_1", "t 2", "org.Y:", "<EMPTY LOG MESSAGE>", dt.datetime(2015, 10, 17, 15, 37, 57, 547000)), ("app_2", "main", "org.X:", "other", dt.datetime(2015, 10, 17, 15, 37, 56))]
    assert got[0][0] == "app_1" and got[0][4] is None
    assert sorted((r.seq_id, r.app_name, r.Label, r.normal) for r in loader.df_seq.collect()) == [("app_1", "WordCount", "Normal", True), ("app_2", "WordCount", "Machine down", False)]


def test_devices_and_calls(spark, tmp_path):
    write(f"{tmp_path}/p/success_1.txt", "1  01.02.2020  10:00:00.123 sys 1 2 W the   message\n")
    write(f"{tmp_path}/p/fail_1.txt", "2 01.02.2020 10:00:01.000 sys 1 2 E bad\n")
    loader = s.ProLoader(spark, f"{tmp_path}/p/*.txt")
    assert sorted(rows(loader.execute(), "seq_id", "log_level", "m_message", "m_timestamp")) == [("fail_1.txt", "E", "bad", dt.datetime(2020, 2, 1, 10, 0, 1)), ("success_1.txt", "W", "the message", dt.datetime(2020, 2, 1, 10, 0, 0, 123000))]
    assert {r.seq_id: r.anomaly for r in loader.df_seq.collect()} == {"fail_1.txt": True, "success_1.txt": False}
    write(f"{tmp_path}/adfa/Training_Data_Master/UTD-1.txt", "6 6 63 \n")
    write(f"{tmp_path}/adfa/Attack_Data_Master/Adduser_1/UAD-1.txt", "265 168")
    loader = s.ADFALoader(spark, f"{tmp_path}/adfa")
    assert rows(loader.execute(), "seq_id", "label", "m_message", "anomaly") == [("UAD-1", "Adduser", "265", True), ("UAD-1", "Adduser", "168", True), *[("UTD-1", "Normal", m, False) for m in ("6", "6", "63")]]
    assert {r.seq_id: (r.m_message, r.anomaly) for r in loader.df_seq.collect()} == {"UAD-1": (["265", "168"], True), "UTD-1": (["6", "6", "63"], False)}
    write(f"{tmp_path}/aws/x/f.csv", "NtOpen,NtClose,Clean\nNtOpen,Worm\n")
    loader = s.AWSCTDLoader(spark, f"{tmp_path}/aws")
    assert rows(loader.execute(), "label", "m_message", "anomaly") == [("Normal", "NtOpen", False), ("Normal", "NtClose", False), ("Worm", "NtOpen", True)]
    assert loader.df_seq.select("seq_id").distinct().count() == 2


def test_events_of_many_files_have_their_own_rows(spark, tmp_path):
    for k in range(40):
        write(f"{tmp_path}/adfa/Training_Data_Master/UTD-{k:02}.txt", f"{k} 1 2\n3 4\n")
        write(f"{tmp_path}/aws/x/f{k:02}.csv", f"a{k},b,c,Clean\n\nd,Worm\nOnly\n")
    adfa = s.ADFALoader(spark, f"{tmp_path}/adfa")
    got = rows(adfa.execute(), "row_id", "seq_id", "m_message")
    assert len({r[0] for r in got}) == len(got) == 200 and got[0][0] >= 0
    assert [r[1:] for r in got] == [(f"UTD-{k:02}", m) for k in range(40) for m in (str(k), "1", "2", "3", "4")]
    assert {r.seq_id: r.m_message for r in adfa.df_seq.collect()} == {f"UTD-{k:02}": [str(k), "1", "2", "3", "4"] for k in range(40)}
    aws = s.AWSCTDLoader(spark, f"{tmp_path}/aws")
    got = rows(aws.execute(), "row_id", "label", "m_message")
    assert len({r[0] for r in got}) == len(got) == 200 and got[0][0] >= 0
    assert [r[1:] for r in got] == [x for k in range(40) for x in (*(("Normal", m) for m in (f"a{k}", "b", "c")), ("Worm", "d"), ("Only", None))]
    assert sorted((r.label, r.m_message or []) for r in aws.df_seq.collect()) == sorted([("Normal", [f"a{k}", "b", "c"]) for k in range(40)] + [("Worm", ["d"])] * 40 + [("Only", [])] * 40)


def test_json_lines(spark, tmp_path):
    write(f"{tmp_path}/g.json", '{"message": "a b", "@timestamp": "2020-01-01T10:00:00Z", "level": 3}\n{"message": "c", "@timestamp": "bad"}\n')
    got = rows(s.GELFLoader(spark, f"{tmp_path}/g.json").execute(), "m_message", "level", "m_timestamp")
    assert got == [("a b", 3, dt.datetime(2020, 1, 1, 10)), ("c", None, None)]


def test_service_runs(spark, tmp_path):
    for run in ("r1", "r2"):
        for case in ("correct", "err_a", "err_b"):
            write(f"{tmp_path}/{run}/{case}/token.log", f"10:00:00.123 {case}\n\nno time\n10:00:01,500 more\n")
            write(f"{tmp_path}/{run}/{case}/metrics/m.json", '[{"metric": {"__name__": "cpu", "job": "node"}, "values": [[1, "0.5"], [2, "1"]]}, {"metric": {"__name__": "x", "job": "other"}, "values": [[1, "9"]]}]')
    loader = s.LO2Loader(spark, str(tmp_path), dup_errors=False)
    df = loader.execute()
    assert {tuple(r) for r in df.select("run", "test_case").distinct().collect()} > {("r1", "correct"), ("r2", "correct")}
    errors = [r.test_case for r in df.where("anomaly").select("run", "test_case").distinct().collect()]
    assert sorted(errors) == ["err_a", "err_b"] and df.count() == 8
    assert {r.seq_id.split("__")[1]: r.anomaly for r in loader.df_seq.collect()} == {"correct": False, "err_a": True, "err_b": True}
    assert loader.load_metrics().where("run = 'r1' and test_case = 'correct'").select("metric_name", "value").collect() == [("cpu", 0.5), ("cpu", 1.0)]
    assert s.LO2Loader(spark, str(tmp_path), single_error_type="err_b", n_runs=1).execute().select("run", "test_case").distinct().count() == 2
    with pytest.raises(ValueError):
        s.LO2Loader(spark, str(tmp_path), single_service="none")


def test_microservices(spark, tmp_path):
    base = f"{tmp_path}/rca_data/2023-01-29"
    log = 'Timestamp,TimeUnixNano,PodName,SpanID,Log\n2023-01-29T09:33:09.036923751Z,1,pod-1,abc,"{""log"":""09:33 INFO TraceID: x SpanID: abc done it\\n"",""stream"":""s"",""time"":""t""}"\n2023-01-29T09:40:00.716,1,pod-1,abc,"{""log"":""09:40 WARN SpanID: abc later""}"\n'
    write(f"{base}/log/a_log.csv", log)
    write(f"{base}/trace/a_trace.csv", "StartTimeUnixNano,EndTimeUnixNano,PodName\n1674984790000000000,1674984791000000000,pod-1\n")
    write(f"{tmp_path}/construct_data/2023-01-29/metric/m.csv", "Time,TimeStamp,PodName,CpuUsage(m)\n2023-01-29 09:33:30.000000001 +0000 UTC,1,pod-1,7.5\n2023-01-29 09:35:00 +0000 UTC,1,pod-1,8\n")
    write(f"{base}/2023-01-29-fault_list.json", '{"9": [{"inject_time": "2023-01-29 09:33:00", "inject_timestamp": "1", "inject_pod": "pod-1", "inject_type": "cpu"}]}')
    write(f"{tmp_path}/rca_data/2022-08-22/log/b.csv", log)
    loader = s.NezhaLoader(spark, str(tmp_path), "TrainTicket")
    got = rows(loader.execute(), "m_message", "severity", "anomaly", "seq_id")
    assert got == [("done it", "INFO", True, "2023-01-29 a_log.csv pod-1"), ("later", "WARN", False, "2023-01-29 a_log.csv pod-1")]
    assert loader.df_trace.select("anomaly").collect() == [(True,)]
    assert sorted((r["CpuUsage(m)"], r.ratio) for r in loader.df_metric_default.collect()) == [(7.5, 0.5), (8.0, 1.0)]
    assert loader.df_seq.select("ano_count").collect() == [(0.5,)]
    with pytest.raises(ValueError):
        s.NezhaLoader(spark, "x", "Other")
