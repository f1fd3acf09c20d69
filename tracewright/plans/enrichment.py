"""Queries of the data model, events, sequences and windows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .. import model
from ..functions import text
from ..operators import windows
from ..operators.events import EventLogEnhancer
from ..operators.nextevent import NextEventPredictionNgram
from ..operators.sequences import SequenceEnhancer
from ..sources.tables import labelled, log_documents, log_events, log_turns, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with the SQL of its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


EVENTS = """events_log AS (SELECT event_id AS row_id, 'user ' || user_id || ' ' || event_type || ' id ' || event_id || ' ' || props AS m_message,
 ts AS m_timestamp, CAST(user_id AS VARCHAR) AS seq_id, event_type = 'error' AS anomaly, event_type FROM events)"""
DOCUMENTS = """documents_log AS (SELECT d.doc_id AS row_id, d.text AS m_message, d.source AS seq_id, l.toxic = 1 AS anomaly, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

def _sql_masks():
    """The library's masks in the SQL engine's syntax: groups by number, and the text's end as $."""
    for replacement, pattern in text.MASKS:
        names = re.findall(r"\(\?<([a-z]+)>", pattern)
        numbers = {}
        for k, opened in enumerate(re.finditer(r"(?<!\\)\((?:\?<([a-z]+)>)?", pattern)):
            if opened[1]:
                numbers[opened[1]] = k + 1
        for name in names:
            replacement = replacement.replace(f"${{{name}}}", f"\\{numbers[name]}")
        yield replacement, re.sub(r"\?<[a-z]+>", "", pattern).replace(r"\z", "$")


def sql_mask(column: str) -> str:
    out = f"split_part({column}, chr(10), 1)"
    for to, pattern in _sql_masks():
        for _ in range(2):
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
    return out


@query(f"WITH {EVENTS} SELECT row_id, {sql_mask('m_message')} AS e_message_normalized FROM events_log")
def normalize_events(spark, sf):
    return EventLogEnhancer(log_events(spark, sf)).normalize().select("row_id", "e_message_normalized")


@query(f"SELECT doc_id AS row_id, {sql_mask('text')} AS e_message_normalized FROM documents")
def normalize_documents(spark, sf):
    return EventLogEnhancer(log_documents(spark, sf)).normalize().select("row_id", "e_message_normalized")


@query("SELECT page_id, regexp_replace(lower(url), '[0-9]', '0', 'g') AS masked FROM (SELECT page_id, split_part(url, chr(10), 1) AS url FROM pages)")
def normalize_urls(spark, sf):
    masked = text.mask(F.col("url"), [("0", "[0-9]")], lower=True, twice=False)
    return table(spark, sf, "pages").select("page_id", masked.alias("masked"))


@query("SELECT row_id, CAST(len(w) AS INTEGER) AS e_words_len, array_to_string(w, '|') AS e_words FROM (SELECT doc_id AS row_id, string_split(text, ' ') AS w FROM documents)")
def words(spark, sf):
    return EventLogEnhancer(log_documents(spark, sf)).words().select("row_id", "e_words_len", F.array_join("e_words", "|").alias("e_words"))


@query(r"SELECT row_id, CAST(len(w) AS INTEGER) AS e_alphanumerics_len, array_to_string(w, '|') AS e_alphanumerics FROM (SELECT doc_id AS row_id, regexp_extract_all(text, '[a-zA-Z\p{Nd}]+') AS w FROM documents)")
def alphanumerics(spark, sf):
    return EventLogEnhancer(log_documents(spark, sf)).alphanumerics().select("row_id", "e_alphanumerics_len", F.array_join("e_alphanumerics", "|").alias("e_alphanumerics"))


@query(r"""WITH t AS (SELECT doc_id AS row_id, list_concat(list_concat(regexp_extract_all(text, '[^\n]{3}'), regexp_extract_all(text[2:], '[^\n]{3}')), regexp_extract_all(text[3:], '[^\n]{3}')) AS g FROM documents)
SELECT row_id, md5(array_to_string(list_sort(g), '|')) AS bag FROM t""")
def trigram_contents(spark, sf):
    bags = EventLogEnhancer(log_documents(spark, sf)).trigrams()
    return bags.select("row_id", F.md5(F.array_join(F.array_sort("e_trigrams"), "|")).alias("bag"))


@query(r"SELECT doc_id AS row_id, CAST(len(regexp_extract_all(text, '[^\n]{3}')) + len(regexp_extract_all(text[2:], '[^\n]{3}')) + len(regexp_extract_all(text[3:], '[^\n]{3}')) AS INTEGER) AS e_trigrams_len FROM documents")
def trigram_bag(spark, sf):
    return EventLogEnhancer(log_documents(spark, sf)).trigrams().select("row_id", "e_trigrams_len")


@query(f"""WITH {EVENTS}, g AS (SELECT substr(m_message, CAST(i AS BIGINT), 3) AS gram FROM events_log, unnest(range(1, greatest(length(m_message) - 1, 1))) AS r(i))
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def char_ngram_counts(spark, sf):
    grams = EventLogEnhancer(log_events(spark, sf)).char_ngrams().select(F.explode("e_cngrams").alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id AS row_id, CAST(length(text) AS INTEGER) AS e_chars_len, CAST(len(regexp_extract_all(text, '[\n\r]')) AS INTEGER) AS e_lines_len, 1 AS e_event_id_len FROM documents")
def message_lengths(spark, sf):
    return EventLogEnhancer(log_documents(spark, sf)).length().select("row_id", "e_chars_len", "e_lines_len", "e_event_id_len")


@query(f"WITH {DOCUMENTS} SELECT 'anomaly' AS \"column\", count(*) FILTER (WHERE anomaly IS NULL) AS nulls, CAST(0 AS BIGINT) AS non_utf8 FROM documents_log HAVING count(*) FILTER (WHERE anomaly IS NULL) > 0")
def null_audit(spark, sf):
    return model.audit(labelled(log_documents(spark, sf), spark, sf))


@query(f"WITH {EVENTS} SELECT regexp_matches(m_message, '^user 1') AS matches, count(*) AS n FROM events_log GROUP BY 1")
def pattern_partition(spark, sf):
    rest, hit = model.partition_by_pattern(log_events(spark, sf), "^user 1")
    count = lambda d, flag: d.agg(F.lit(flag).alias("matches"), F.count("*").alias("n"))
    return count(hit, True).union(count(rest, False)).where("n > 0")


@query(f"""WITH {EVENTS}, s AS (SELECT row_id, string_split(m_message, ' ') AS w FROM events_log)
SELECT row_id, w[1] AS a, w[2] AS b, w[3] AS c, array_to_string(w[4:], ' ') AS rest FROM s""")
def split_columns(spark, sf):
    return model.split_fields(log_events(spark, sf), "m_message", ["a", "b", "c", "rest"]).select("row_id", "a", "b", "c", "rest")


@query(f"WITH {DOCUMENTS} SELECT row_id, anomaly, NOT anomaly AS normal FROM documents_log")
def anomaly_inversion(spark, sf):
    return model.with_anomaly(labelled(log_documents(spark, sf).select("row_id"), spark, sf)).select("row_id", "anomaly", "normal")


@query("SELECT CAST(floor(0.3 * count(*)) AS BIGINT) AS n, CAST(floor(0.3 * count(*)) AS BIGINT) AS of_the_log FROM events")
def reduced_events(spark, sf):
    """How many events a seeded sample has and how many different ones of the log; which depends on Spark's hash."""
    log = log_events(spark, sf)
    df, _ = model.reduce_rows(log, None, 0.3)
    return df.select("row_id").join(log.select("row_id"), "row_id", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("of_the_log"))


@query(f"""WITH {EVENTS} SELECT seq_id, min(m_timestamp) AS start_time, max(m_timestamp) AS end_time, count(*) AS seq_len, count(*) AS e_event_id_len,
 date_diff('microsecond', min(m_timestamp), max(m_timestamp)) // 1000000 AS duration_sec,
 CAST(max(length(m_message)) AS INTEGER) AS eve_len_max, CAST(min(length(m_message)) AS INTEGER) AS eve_len_min, round(avg(length(m_message)), 6) AS eve_len_avg, median(length(m_message)) AS eve_len_med,
 count(*) FILTER (WHERE length(m_message) > 1) AS eve_len_over1, round(avg(CAST(anomaly AS INTEGER)), 6) AS anomaly_ratio FROM events_log GROUP BY seq_id""")
def seq_summary(spark, sf):
    """All scalar aggregates of a sequence, from one pass."""
    e = EventLogEnhancer(log_events(spark, sf))
    e.length()
    s = SequenceEnhancer(e.df)
    for add in (s.start_time, s.end_time, s.seq_len, s.duration, s.eve_len, s.anomaly_ratio):
        add()
    rounded = {c: F.round(c, 6) for c in ("eve_len_avg", "anomaly_ratio")}
    return s.df_seq.drop("duration").withColumns(rounded)


@query(f"WITH {EVENTS} SELECT seq_id, make_timestamp(CAST(trunc(median(epoch_us(m_timestamp))) AS BIGINT)) AS time_stamp FROM events_log GROUP BY seq_id")
def seq_median_ts(spark, sf):
    return SequenceEnhancer(log_events(spark, sf)).time_stamp().df_seq


@query(f"WITH {EVENTS} SELECT seq_id, string_agg(event_type, ',' ORDER BY row_id) AS events FROM events_log GROUP BY seq_id")
def seq_event_list(spark, sf):
    s = SequenceEnhancer(log_events(spark, sf)).events("event_type").df_seq
    return s.select("seq_id", F.array_join("event_type", ",").alias("events"))


@query("SELECT source AS seq_id, string_agg(text, ' ' ORDER BY doc_id) AS words, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS e_words_len FROM documents GROUP BY source")
def seq_tokens(spark, sf):
    e = EventLogEnhancer(log_documents(spark, sf))
    e.words()
    return SequenceEnhancer(e.df).tokens(separator=" ").df_seq.select("seq_id", F.col("e_words").alias("words"), "e_words_len")


@query("SELECT CAST(conv_id AS VARCHAR) AS seq_id, string_agg(text, chr(10) ORDER BY turn) AS m_message FROM conversations GROUP BY conv_id")
def seq_messages(spark, sf):
    return SequenceEnhancer(log_turns(spark, sf)).messages().df_seq


@query("""WITH x AS (SELECT CAST(label AS VARCHAR) AS seq_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
m AS (SELECT seq_id, p, avg(v) AS v FROM x GROUP BY seq_id, p)
SELECT seq_id, string_agg(CAST(CAST(round(v * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY p) AS mean FROM m GROUP BY seq_id""")
def seq_mean_embedding(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("seq_id"), "embedding")
    s = SequenceEnhancer(e).embeddings("embedding").df_seq
    return s.select("seq_id", F.array_join(F.transform("embedding", lambda v: F.round(v * 100000).cast("long").cast("string")), ",").alias("mean"))


CUMSUM = f"""WITH {EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY {{by}} ORDER BY {{order}}, row_id) = 1 AS first FROM events_log)
SELECT row_id, CAST(sum(CAST({{flag}} AS INTEGER)) OVER (ORDER BY {{order}}, row_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS {{out}} FROM f"""


@query(CUMSUM.format(by="m_message", order="m_timestamp", flag="first AND anomaly", out="cumu_items_unan"))
def item_cumsum_unique_anomaly(spark, sf):
    return windows.item_cumsum(log_events(spark, sf), "m_message").select("row_id", "cumu_items_unan")


@query(CUMSUM.format(by="seq_id", order="m_timestamp", flag="first", out="cumu_items_un"))
def item_cumsum_unique(spark, sf):
    return windows.item_cumsum(log_events(spark, sf), "seq_id", ano_only=False).select("row_id", "cumu_items_un")


@query(CUMSUM.format(by="seq_id", order="-epoch_us(m_timestamp)", flag="anomaly", out="m_message_cumsum"))
def item_cumsum_desc(spark, sf):
    return windows.item_cumsum(log_events(spark, sf), "m_message", -1, unique_only=False, out_column="m_message_cumsum").select("row_id", "m_message_cumsum")


@query(f"""WITH {EVENTS}, f AS (SELECT *, row_number() OVER (PARTITION BY seq_id, event_type ORDER BY row_id) AS r FROM events_log)
SELECT row_id, seq_id, event_type FROM f WHERE r = 1""")
def first_distinct(spark, sf):
    df = log_events(spark, sf).withColumn("pair", F.struct("seq_id", "event_type"))
    return windows.mark_first(df, "pair", 0).where("_first").select("row_id", "seq_id", "event_type")


GAPS = f"WITH {EVENTS}, g AS (SELECT row_id, seq_id, CASE WHEN row_id % 3 = 0 THEN m_timestamp END AS t FROM events_log)"


def _gaps(spark, sf):
    return log_events(spark, sf).select("row_id", "seq_id", F.when(F.col("row_id") % 3 == 0, F.col("m_timestamp")).alias("t"))


@query(GAPS + " SELECT row_id, last_value(t IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS t FROM g")
def fill_lastseen(spark, sf):
    return windows.fill_last_seen(_gaps(spark, sf), "t", ("seq_id",)).select("row_id", "t")


@query(GAPS + " SELECT row_id, first_value(t IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t FROM g")
def fill_next(spark, sf):
    return windows.fill_next(_gaps(spark, sf), "t", ("seq_id",)).select("row_id", "t")


@query(f"""WITH {EVENTS}, g AS (SELECT *, sum(CAST(event_type = 'view' AS INTEGER)) OVER (PARTITION BY seq_id ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS k FROM events_log)
SELECT seq_id, min(row_id) AS row_id, string_agg(m_message, chr(10) ORDER BY row_id) AS m_message FROM g GROUP BY seq_id, k""")
def merge_multiline(spark, sf):
    return windows.merge_lines(log_events(spark, sf), F.col("event_type") == "view", ("seq_id",)).select("seq_id", "row_id", "m_message")


NEP = f"""WITH {EVENTS}, p AS (SELECT seq_id, 0 AS e, row_id, event_type AS event FROM events_log UNION ALL SELECT DISTINCT seq_id, 1, NULL, 'EoS' FROM events_log),
s AS (SELECT seq_id, event, row_number() OVER w - 1 AS pos, coalesce(lag(event, 4) OVER w, 'SoS') || ' ' || coalesce(lag(event, 3) OVER w, 'SoS') || ' ' || coalesce(lag(event, 2) OVER w, 'SoS') || ' ' || coalesce(lag(event, 1) OVER w, 'SoS') AS context
 FROM p WINDOW w AS (PARTITION BY seq_id ORDER BY e, row_id)),
pairs AS (SELECT context, event, count(*) AS n, min(seq_id || chr(1) || printf('%010d', pos)) AS first FROM s GROUP BY context, event),
best AS (SELECT context, event AS predicted, n AS best_n FROM pairs QUALIFY row_number() OVER (PARTITION BY context ORDER BY n DESC, first) = 1),
totals AS (SELECT context, CAST(sum(n) AS BIGINT) AS context_n FROM pairs GROUP BY context),
scored AS (SELECT seq_id, pos, event, predicted AS nep_predict, CAST(predicted = event AS INTEGER) AS nep_corr, n AS nep_abs, n / context_n AS nep_prob_nsum, n / best_n AS nep_prob_nmax
 FROM s JOIN pairs USING (context, event) JOIN best USING (context) JOIN totals USING (context))
"""


def _nep(spark, sf):
    events = log_events(spark, sf).select("seq_id", "row_id", F.col("event_type").alias("event"))
    return NextEventPredictionNgram(5).fit(events), events


@query(NEP + "SELECT context, event, n FROM pairs")
def nep_model(spark, sf):
    return _nep(spark, sf)[0].pairs.select(F.array_join("context", " ").alias("context"), "event", "n")


@query(NEP + "SELECT context, predicted, best_n, context_n FROM best JOIN totals USING (context)")
def nep_winners(spark, sf):
    return _nep(spark, sf)[0].contexts.select(F.array_join("context", " ").alias("context"), "predicted", "best_n", "context_n")


@query(NEP + "SELECT seq_id, pos, event, nep_predict, nep_corr, nep_abs, round(nep_prob_nsum, 6) AS nep_prob_nsum, round(nep_prob_nmax, 6) AS nep_prob_nmax FROM scored")
def nep_scores(spark, sf):
    m, events = _nep(spark, sf)
    return m.score(events).withColumns({c: F.round(c, 6) for c in ("nep_prob_nsum", "nep_prob_nmax")}).withColumn("pos", F.col("pos").cast("long"))


@query(NEP + """SELECT seq_id, string_agg(nep_predict, ',' ORDER BY pos) AS nep_predict, round(avg(nep_abs), 6) AS nep_abs_avg, max(nep_abs) AS nep_abs_max, min(nep_abs) AS nep_abs_min,
 round(avg(nep_prob_nmax), 6) AS nep_prob_nmax_avg, round(exp(-avg(ln(nep_prob_nmax))), 6) AS nep_prob_nmax_perp FROM scored GROUP BY seq_id""")
def nep_sequences(spark, sf):
    out = SequenceEnhancer(log_events(spark, sf)).next_event_prediction("event_type").df_seq
    rounded = [F.round(c, 6).alias(c) for c in ("nep_abs_avg", "nep_prob_nmax_avg", "nep_prob_nmax_perp")]
    return out.select("seq_id", F.array_join("nep_predict", ",").alias("nep_predict"), "nep_abs_max", "nep_abs_min", *rounded)
