"""Queries of detectors, metrics, distances and joins."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import text
from ..model import of_sequences, reduce_rows
from ..operators import joins
from ..operators.detect import metrics
from ..operators.detect.items import OOV_detector, RarityModel, term_counts, tfidf, vocabulary
from ..operators.distance import LogDistance
from ..scratch import save
from ..sources.tables import labelled, log_documents, log_events, table
from .enrichment import DOCUMENTS, EVENTS, sql_mask

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


TERMS = f"""WITH {EVENTS}, bag AS (SELECT row_id, seq_id, anomaly, m_timestamp, unnest(string_split({sql_mask('m_message')}, ' ')) AS term FROM events_log),
counts AS (SELECT row_id, term, count(*) AS n FROM bag GROUP BY row_id, term)"""
RARITY = TERMS + """, vocab AS (SELECT term, count(*) AS n FROM bag WHERE NOT anomaly GROUP BY term),
rare AS (SELECT term, CASE WHEN n / t > 0.01 THEN 0 ELSE -ln(n / t) * ln(n / t) * ln(n / t) END AS rarity FROM vocab, (SELECT CAST(sum(n) AS BIGINT) AS t FROM vocab)),
known AS (SELECT row_id, sum(n * rarity) / count(*) AS score FROM counts JOIN rare USING (term) GROUP BY row_id),
scored AS (SELECT e.row_id, e.seq_id, e.anomaly, e.m_timestamp, coalesce(k.score, 0) AS score FROM events_log e LEFT JOIN known k USING (row_id))
"""


def _bagged(spark, sf):
    """Events with their masked words, saved because the masks are costly and models read them twice."""
    df = log_events(spark, sf).withColumn("e_words", text.words(text.mask(F.col("m_message"))))
    return save(df.select("row_id", "seq_id", "anomaly", "m_timestamp", "e_words"), "bagged")


def _rarity(spark, sf):
    df = _bagged(spark, sf)
    scored = RarityModel(threshold=250).fit(df.where("NOT anomaly"), "e_words").predict(df, "e_words")
    return df.select("row_id", "seq_id", "anomaly", "m_timestamp").join(scored, "row_id")


@query(TERMS + " SELECT term, count(*) AS n FROM bag GROUP BY term")
def vocab_counts(spark, sf):
    return vocabulary(_bagged(spark, sf), "e_words")


@query(r"SELECT doc_id AS row_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2")
def document_terms(spark, sf):
    return term_counts(log_documents(spark, sf), "m_message")


@query(RARITY + "SELECT row_id, round(score, 6) AS score, CAST(score > 250 AS INTEGER) AS pred_ano FROM scored")
def rarity_scores(spark, sf):
    return _rarity(spark, sf).select("row_id", F.round("score", 6).alias("score"), "pred_ano")


@query(RARITY + """SELECT seq_id, count(*) AS seq_len, date_diff('microsecond', min(m_timestamp), max(m_timestamp)) // 1000000 AS duration_sec, round(avg(score), 6) AS rarity_avg, round(max(score), 6) AS rarity_max FROM scored GROUP BY seq_id""")
def seq_rarity(spark, sf):
    """The flagship: mask, split, model and score events, then sum up their sequences."""
    first, last = F.min("m_timestamp"), F.max("m_timestamp")
    return _rarity(spark, sf).groupBy("seq_id").agg(F.count("*").alias("seq_len"), F.timestamp_diff("SECOND", first, last).alias("duration_sec"), F.round(F.avg("score"), 6).alias("rarity_avg"), F.round(F.max("score"), 6).alias("rarity_max"))


OOV = f"""WITH {DOCUMENTS}, bag AS (SELECT row_id, lang, unnest(regexp_extract_all(lower(m_message), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents_log),
vocab AS (SELECT DISTINCT term FROM bag WHERE lang = 'en'),
scored AS (SELECT d.row_id, d.anomaly, count(b.term) - count(v.term) AS score FROM documents_log d LEFT JOIN bag b USING (row_id) LEFT JOIN vocab v USING (term) GROUP BY d.row_id, d.anomaly)
"""


def _oov(spark, sf):
    df = log_documents(spark, sf)
    scored = OOV_detector(threshold=1).fit(df.where("lang = 'en'"), "m_message").predict(df, "m_message")
    return labelled(scored, spark, sf)


@query(OOV + "SELECT row_id, score, CAST(score > 1 AS INTEGER) AS pred_ano FROM scored")
def oov_scores(spark, sf):
    return _oov(spark, sf).select("row_id", "score", "pred_ano")


@query(TERMS + """, f AS (SELECT term, ln((1 + (SELECT count(*) FROM events_log)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term),
w AS (SELECT row_id, term, n * idf AS w FROM counts JOIN f USING (term))
SELECT row_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w""")
def tfidf_weights(spark, sf):
    return tfidf(_bagged(spark, sf), "e_words").withColumn("weight", F.round("weight", 6))


LABELLED = OOV + ", y AS (SELECT anomaly AS y, score > 1 AS p, score FROM scored WHERE anomaly IS NOT NULL), m AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM y)\n"


@query(LABELLED + "SELECT * FROM m")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(_oov(spark, sf))


@query(LABELLED + "SELECT round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM m")
def f1_accuracy(spark, sf):
    return metrics.f1_accuracy(_oov(spark, sf)).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query(LABELLED + """, r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM y)
SELECT round((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)), 6) AS auc FROM r""")
def auc_roc(spark, sf):
    return metrics.auc_roc(_oov(spark, sf)).select(F.round("auc", 6).alias("auc"))


BY_SCORE = LABELLED + """, s AS (SELECT score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM y GROUP BY score),
c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM s)
"""


@query(BY_SCORE + "SELECT CAST(score AS DOUBLE) AS threshold, round(2 * tp / (tp + fp + p), 6) AS f1 FROM c ORDER BY 2 * tp / (tp + fp + p) DESC, score DESC LIMIT 1")
def best_f1(spark, sf):
    return metrics.best_f1(_oov(spark, sf)).withColumn("f1", F.round("f1", 6))


@query(BY_SCORE + "SELECT CAST(score AS DOUBLE) AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM c")
def roc_points(spark, sf):
    return metrics.roc_points(_oov(spark, sf)).withColumns({c: F.round(c, 6) for c in ("fpr", "tpr")})


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)
SELECT CAST(least(floor((c_acctbal - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, count(*) AS n FROM customer, e GROUP BY 1""")
def score_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "customer"), "c_acctbal", 20).select(F.col("bin").cast("long").alias("bin"), "n")


@query("""WITH g AS (SELECT l_shipmode_ AS model, l_returnflag AS signature, avg(l_discount) AS s FROM (SELECT l_linestatus AS l_shipmode_, l_returnflag, l_discount FROM lineitem) GROUP BY 1, 2),
m AS (SELECT model, coalesce(max(s) FILTER (WHERE signature = 'A'), 0) AS A, coalesce(max(s) FILTER (WHERE signature = 'N'), 0) AS N, coalesce(max(s) FILTER (WHERE signature = 'R'), 0) AS R FROM g GROUP BY model),
t AS (SELECT model, A, N, R, (A + N + R) / 3 AS avg_ FROM m UNION ALL SELECT 'Column Average', avg(A), avg(N), avg(R), avg((A + N + R) / 3) FROM m)
SELECT model, printf('%.3f', A) AS "A", printf('%.3f', N) AS "N", printf('%.3f', R) AS "R", printf('%.3f', avg_) AS "Row Average" FROM t""")
def score_pivot(spark, sf):
    results = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("model"), F.col("l_returnflag").alias("signature"), F.col("l_discount").alias("accuracy"))
    return metrics.average_scores(results)


DISTANCE = r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE lang IN ('en', 'fr')),
c AS (SELECT term, CAST(count(*) FILTER (WHERE lang = 'en') AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE lang = 'fr') AS DOUBLE) AS b FROM t GROUP BY term)
SELECT round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine, round(1 - count(*) FILTER (WHERE a > 0 AND b > 0) / count(*), 6) AS jaccard,
 round(1 - count(*) FILTER (WHERE a > 0 AND b > 0) / least(count(*) FILTER (WHERE a > 0), count(*) FILTER (WHERE b > 0)), 6) AS containment FROM c"""


def _languages(spark, sf):
    d = log_documents(spark, sf)
    return LogDistance(d.where("lang = 'en'"), d.where("lang = 'fr'"))


@query(DISTANCE)
def language_distances(spark, sf):
    return _languages(spark, sf).measures().select(*(F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "containment")))


@query(DISTANCE.replace(" FROM c", ", true AS compression_in_range, (SELECT count(*) FROM documents WHERE lang = 'en') AS rows_train, (SELECT count(*) FROM documents WHERE lang = 'fr') AS rows_analyze FROM c"))
def all_distances(spark, sf):
    """All measures of two logs; the compressed one, which SQL can't have, only by its range."""
    rounded = [F.round(c, 6).alias(c) for c in ("cosine", "jaccard", "containment")]
    return _languages(spark, sf).measure_all_distances().select(*rounded, F.col("compression").between(0.3, 1.05).alias("compression_in_range"), "rows_train", "rows_analyze")


@query("""SELECT text AS line, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang <> 'en') AS b FROM documents GROUP BY text
HAVING count(*) FILTER (WHERE lang = 'en') <> count(*) FILTER (WHERE lang <> 'en')""")
def line_diff_counts(spark, sf):
    d = log_documents(spark, sf)
    return LogDistance(d.where("lang = 'en'"), d.where("lang <> 'en'")).diff_counts()


def _put_together(batches):
    """(log, digest, n): MD5 of the lines of each log, in the order given, and how many there are."""
    log, md5, n = None, None, 0

    def row():
        return pa.RecordBatch.from_arrays([pa.array([log]), pa.array([md5.hexdigest()]), pa.array([n], pa.int64())], ["log", "digest", "n"])

    for batch in batches:
        for this, line in zip(batch.column("log").to_pylist(), batch.column("line").to_pylist(), strict=True):
            if this != log:
                if log is not None:
                    yield row()
                log, md5, n = this, hashlib.md5(), 0
            md5.update(("\n" * (n > 0) + line).encode())
            n += 1
    if log is not None:
        yield row()


@query("""SELECT md5(string_agg(text, chr(10) ORDER BY doc_id) FILTER (WHERE lang = 'es')) AS one, md5(string_agg(text, chr(10) ORDER BY doc_id) FILTER (WHERE lang = 'de')) AS other,
 CAST(sum(len(string_split(text, chr(10)))) FILTER (WHERE lang = 'es') AS BIGINT) AS one_lines, CAST(sum(len(string_split(text, chr(10)))) FILTER (WHERE lang = 'de') AS BIGINT) AS other_lines FROM documents WHERE text IS NOT NULL""")
def line_diff(spark, sf):
    """Both logs as they are put together again from their line difference."""
    d = log_documents(spark, sf)
    diff = LogDistance(d.where("lang = 'es'"), d.where("lang = 'de'")).diff_lines()
    sides = [diff.where(F.col("op").isin(" ", op)).select(F.lit(name).alias("log"), "pos", "line") for name, op in (("one", "-"), ("other", "+"))]
    dealt = sides[0].union(sides[1]).repartition("log").sortWithinPartitions("log", "pos")
    done = dealt.mapInArrow(_put_together, "log string, digest string, n long")
    of = lambda name, c: F.max(F.when(F.col("log") == name, F.col(c)))
    return done.agg(of("one", "digest").alias("one"), of("other", "digest").alias("other"), of("one", "n").alias("one_lines"), of("other", "n").alias("other_lines"))


@query("""WITH l AS (SELECT user_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, l.ts IS NOT NULL AS anomaly, l.ts AS label_ts FROM events e LEFT JOIN l ON e.user_id = l.user_id AND e.ts > l.ts AND e.ts <= l.ts + INTERVAL 30 MINUTE""")
def label_range_join(spark, sf):
    e = table(spark, sf, "events")
    labels = e.where("event_type = 'error'").select(F.col("user_id").alias("pod"), F.col("ts").alias("label_ts"))
    return joins.label_range_join(e, labels, "user_id", "ts", "pod", "label_ts", 30).select("event_id", "anomaly", "label_ts")


@query("""WITH l AS (SELECT user_id, ts FROM events WHERE event_type = 'error'),
j AS (SELECT e.event_id, (epoch_us(e.ts) - epoch_us(l.ts)) / 60000000 AS m FROM events e LEFT JOIN l ON e.user_id = l.user_id AND e.ts > l.ts AND e.ts <= l.ts + INTERVAL 4 MINUTE),
r AS (SELECT event_id, CASE WHEN m IS NULL THEN 0 WHEN m < 1 THEN m WHEN m <= 3 THEN 1 WHEN m < 4 THEN 4 - m ELSE 0 END AS ratio FROM j)
SELECT event_id, round(ratio, 6) AS ratio, ratio > 0 AS anomaly FROM r""")
def graded_label_ratio(spark, sf):
    e = table(spark, sf, "events")
    labels = e.where("event_type = 'error'").select(F.col("user_id").alias("pod"), F.col("ts").alias("label_ts"))
    out = joins.graded_label_ratio(e, labels, "user_id", "ts", "pod", "label_ts")
    return out.select("event_id", F.round("ratio", 6).alias("ratio"), "anomaly")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def semi_reduce(spark, sf):
    e = table(spark, sf, "events")
    return of_sequences(e, e.where("event_type = 'purchase'"), "user_id").select("event_id", "user_id")


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
s AS (SELECT a.vec_id, b.vec_id AS nearest, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS similarity FROM u a, u b WHERE a.label = 0 AND b.label <> 0)
SELECT vec_id, arg_min(nearest, (-similarity, nearest)) AS nearest, round(max(similarity), 6) AS similarity FROM s GROUP BY vec_id""")
def nearest_normal(spark, sf):
    e = table(spark, sf, "embeddings")
    return joins.nearest(e.where("label = 0"), e.where("label <> 0"), "vec_id", "embedding").select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {EVENTS} SELECT e.seq_id, e.row_id, t.trace_row_id FROM events_log e JOIN (SELECT seq_id, row_id AS trace_row_id FROM events_log WHERE anomaly) t USING (seq_id)")
def logs_and_traces(spark, sf):
    logs = log_events(spark, sf).select("seq_id", "row_id")
    traces = log_events(spark, sf).where("anomaly").select(F.concat("seq_id", F.lit("_trace")).alias("seq_id"), "row_id")
    return joins.merge_logs_and_traces(logs, traces, "_trace")


@query(f"WITH {EVENTS}, n AS (SELECT CAST(floor(0.25 * count(DISTINCT seq_id)) AS BIGINT) AS n FROM events_log) SELECT n AS sequences, n AS of_the_log, CAST(0 AS BIGINT) AS cut_short FROM n")
def reduced_sequences(spark, sf):
    """How many sequences a seeded sample has, how many of them are the log's, and how many have lost events."""
    log = log_events(spark, sf)
    kept, sequences = reduce_rows(log, log.select("seq_id").distinct(), 0.25)
    whole = log.groupBy("seq_id").agg(F.count("*").alias("n"))
    both = sequences.distinct().join(whole, "seq_id", "left").join(kept.groupBy("seq_id").agg(F.count("*").alias("k")), "seq_id", "left")
    return both.agg(F.count("*").alias("sequences"), F.count("n").alias("of_the_log"), F.count_if(~F.col("n").eqNullSafe(F.col("k"))).alias("cut_short"))
