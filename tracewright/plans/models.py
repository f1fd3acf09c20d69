"""Queries of splits, features, detectors, explanations, streams and repaired times."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions import text
from ..model import micros
from ..operators import templates as t
from ..operators.detect.detector import SUPERVISED, UNSUPERVISED, AnomalyDetector
from ..operators.detect.features import Vectorizer, test_train_split
from ..operators.detect.models import LocalOutlierFactor
from ..operators.distance import LogDistance
from ..operators.embedding import hashing_encoder, with_encoder
from ..operators.events import EventLogEnhancer
from ..operators.explain import NNExplainer, ShapExplainer
from ..scratch import scratch_path
from ..sources import sinks
from ..sources.structured import epoch_nanos, epoch_seconds
from ..sources.tables import as_log, log_events, table
from ..streaming.drain import DrainState, enhance_stream, parse_stream
from .enrichment import EVENTS, sql_mask

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# A user is an anomaly with over 16 errors.
USERS = f"""WITH {EVENTS}, users AS (SELECT CAST(seq_id AS BIGINT) AS row_id, count(*) AS n, count(*) FILTER (WHERE anomaly) AS errors, count(DISTINCT event_type || right(m_message, 4)) AS kinds, min(m_timestamp) AS start_time,
 count(*) FILTER (WHERE anomaly) > 16 AS anomaly FROM events_log GROUP BY seq_id),
parts AS (SELECT *, row_number() OVER (ORDER BY start_time, row_id) > count(*) OVER () - count(*) OVER () // 2 AS test FROM users)
"""


def _users(spark, sf):
    kind = F.concat("event_type", F.right("m_message", F.lit(4)))
    items = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "event_type"))), lambda x: x["event_type"])
    log = log_events(spark, sf)
    users = log.groupBy("seq_id").agg(F.count("*").alias("n"), F.count_if("anomaly").alias("errors"), F.count_distinct(kind).alias("kinds"), F.min("m_timestamp").alias("start_time"), items.alias("items"))
    return users.select(F.col("seq_id").cast("long").alias("row_id"), "n", "errors", "kinds", "start_time", "items", (F.col("errors") > 16).alias("anomaly"))


@query(USERS + "SELECT row_id, test FROM parts")
def split_in_time(spark, sf):
    train, test = test_train_split(_users(spark, sf), 0.5)
    in_time, later = test_train_split(_users(spark, sf), 0.5, shuffle=False)
    assert train.count() == in_time.count() and test.count() == later.count()
    return in_time.select("row_id", F.lit(False).alias("test")).union(later.select("row_id", F.lit(True).alias("test")))


@query("SELECT vec_id, list_transform(list_append(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), CAST(label AS DOUBLE)), lambda x: CAST(round(x * 100000) AS BIGINT))::VARCHAR AS features FROM embeddings")
def feature_vectors(spark, sf):
    """An embedding and a number side by side."""
    e = table(spark, sf, "embeddings")
    out = Vectorizer(None, ["label"], "embedding").fit(e).transform(e)
    numbers = F.transform(vector_to_array("features"), lambda x: F.round(x * 100000).cast("long").cast("string"))
    return out.select("vec_id", F.concat(F.lit("["), F.array_join(numbers, ", "), F.lit("]")).alias("features"))


@query(USERS + ", c AS (SELECT row_id, i.event_type, count(*) AS n FROM users JOIN events i ON i.user_id = row_id GROUP BY ALL), f AS (SELECT event_type, ln((1 + (SELECT count(*) FROM users)) / (1 + count(*))) + 1 AS idf FROM c GROUP BY 1), w AS (SELECT row_id, event_type, n * idf AS w FROM c JOIN f USING (event_type)) SELECT row_id, event_type, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM w")
def tfidf_features(spark, sf):
    """A detector's vectors by the TF-IDF vectorizer."""
    users = _users(spark, sf)
    v = Vectorizer("items", vectorizer="tfidf").fit(users)
    names = spark.createDataFrame(list(enumerate(v.names(len(v.bag.vocabulary)))), "k int, event_type string")
    long = v.transform(users).select("row_id", F.posexplode(vector_to_array("features")).alias("k", "w")).where("w > 0")
    return long.join(F.broadcast(names), "k").select("row_id", "event_type", F.round("w", 6).alias("weight"))


@query(USERS + f"SELECT model, count(*) FILTER (WHERE anomaly) AS anomalies, count(*) FILTER (WHERE NOT anomaly) AS others FROM parts, (SELECT unnest({[*SUPERVISED, *UNSUPERVISED]}) AS model) WHERE test GROUP BY model")
def detector_rows(spark, sf):
    """Every detector trained on the earlier half and evaluated on each row of the later one."""
    ad = AnomalyDetector("items", ["n", "errors"])
    ad.test_train_split(_users(spark, sf), 0.5, shuffle=False)
    small = {"RF": {"n_estimators": 10}, "XGB": {"n_estimators": 10}}
    out = ad.evaluate_with_params({name: small.get(name, {}) for name in SUPERVISED + UNSUPERVISED})
    return out.select("model", (F.col("tp") + F.col("fn")).alias("anomalies"), (F.col("fp") + F.col("tn")).alias("others"))


@query(USERS + "SELECT model, row_id, CAST(anomaly AS INTEGER) AS pred_ano FROM users, (SELECT unnest(['DT', 'XGB', 'kept']) AS model)")
def detector_learns(spark, sf):
    """Trees find the rule that made the labels, and so does a tree that was written and read."""
    users = _users(spark, sf)
    ad = AnomalyDetector(numeric_cols=["errors"])
    ad.set_data(users, users)
    tag = lambda name: ad.predict().select(F.lit(name).alias("model"), "row_id", "pred_ano")
    out = ad.train("XGB", n_estimators=5) and tag("XGB")
    out = out.union(ad.train("DT") and tag("DT"))
    path = scratch_path(spark, "model")
    sinks.save_model(ad.model, path)
    ad.model = sinks.load_model(spark, path)
    return out.union(tag("kept"))


LOF = USERS + """, tr AS (SELECT * FROM users WHERE row_id % 2 = 0), te AS (SELECT * FROM users WHERE row_id % 2 = 1),
q AS (SELECT a.row_id AS key, b.row_id AS other, sqrt(power(a.n - b.n, 2) + power(a.errors - b.errors, 2) + power(a.kinds - b.kinds, 2)) AS d FROM users a, tr b WHERE a.row_id <> b.row_id),
near AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY key ORDER BY d, other) <= 5),
reach AS (SELECT key AS other, max(d) AS reach FROM near WHERE key % 2 = 0 GROUP BY 1),
density AS (SELECT key, 1 / (avg(greatest(d, reach)) + 1e-10) AS density FROM near JOIN reach USING (other) GROUP BY key),
factor AS (SELECT n.key AS row_id, avg(o.density) / max(k.density) AS score FROM near n JOIN density o ON o.key = n.other JOIN density k ON k.key = n.key WHERE n.key % 2 = 1 GROUP BY 1)
"""


@query(LOF + "SELECT row_id, round(score, 6) AS score, CAST(score > 1.5 AS INTEGER) AS pred_ano FROM factor")
def lof_scores(spark, sf):
    users = _users(spark, sf)
    rows = Vectorizer(None, ["n", "errors", "kinds"]).fit(users).transform(users)
    return LocalOutlierFactor(5).fit(rows.where("row_id % 2 = 0")).transform(rows.where("row_id % 2 = 1")).select("row_id", F.round("score", 6).alias("score"), "pred_ano")


@query("""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * y)))) AS v FROM embeddings),
s AS (SELECT a.vec_id, a.label AS anomalous, b.vec_id AS nearest, b.label AS normal, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS similarity FROM u a, u b WHERE a.label >= 5 AND b.label < 5)
SELECT vec_id, arg_min(nearest, (-similarity, nearest)) AS nearest, any_value(anomalous) AS anomalous, arg_min(normal, (-similarity, nearest)) AS normal FROM s GROUP BY vec_id""")
def nearest_pairs(spark, sf):
    """Each predicted anomaly with the normal row next to it and both rows' content."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", (F.col("label") >= 5).cast("int").alias("pred_ano"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return NNExplainer(e, "vec_id").content("label").select("vec_id", "nearest", "anomalous", "normal")


@query(f"WITH {EVENTS} SELECT row_id, CASE WHEN anomaly THEN 'missed' ELSE 'wrong' END AS kind FROM events_log WHERE anomaly <> (row_id % 5 = 0)")
def wrong_predictions(spark, sf):
    log = log_events(spark, sf).withColumn("pred_ano", (F.col("row_id") % 5 == 0).cast("int"))
    x = NNExplainer(log)
    return x.false_positives().select("row_id", F.lit("wrong").alias("kind")).union(x.false_negatives().select("row_id", F.lit("missed").alias("kind")))


@query("SELECT unnest(['IsolationForest', 'LR', 'DT']) AS model, 'errors' AS feature, true AS adds_up")
def shapley_values(spark, sf):
    """The feature that made the labels has the largest total of values, in three models."""
    users = _users(spark, sf).withColumn("same", F.lit(1.0))
    ad = AnomalyDetector(numeric_cols=["same", "errors"])
    ad.set_data(users, users)
    out = None
    for name in ("IsolationForest", "LR", "DT"):
        top = ShapExplainer(ad.train(name)).sorted_shapvalues().limit(1).select(F.lit(name).alias("model"), "feature", (F.col("total") > 0).alias("adds_up"))
        out = top if out is None else out.union(top)
    return out


@query("SELECT unnest(['LR', 'DT', 'XGB']) AS model, 'errors' AS feature")
def top_features(spark, sf):
    """The feature of largest weight or importance."""
    users = _users(spark, sf).withColumn("same", F.lit(1.0))
    ad = AnomalyDetector(numeric_cols=["same", "errors"])
    ad.set_data(users, users)
    ad.train("LR")
    out = ad.importances(1).select(F.lit("LR").alias("model"), "feature")
    for name, options in (("DT", {}), ("XGB", {"n_estimators": 3})):
        ad.train(name, **options)
        out = out.union(ad.importances(1).select(F.lit(name), "feature"))
    return out


@query(USERS + "SELECT row_id, true AS placed FROM users")
def plotted_rows(spark, sf):
    """Rows on their two main components."""
    users = _users(spark, sf).withColumn("pred_ano", F.col("anomaly").cast("int"))
    out = NNExplainer(Vectorizer(None, ["n", "errors", "kinds"]).fit(users).transform(users)).plane()
    return out.select("row_id", (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("placed"))


@query("SELECT CAST(NULL AS DOUBLE) AS cosine, CAST(NULL AS DOUBLE) AS jaccard, CAST(NULL AS DOUBLE) AS containment")
def empty_distances(spark, sf):
    """Logs without a term have no distance."""
    none = log_events(spark, sf).select("row_id", F.lit("! ?").alias("m_message"))
    return LogDistance(none, none).measures()


@query(r"""WITH t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents WHERE lang IN ('en', 'fr')),
c AS (SELECT term, count(*) FILTER (WHERE lang = 'en') AS a, count(*) FILTER (WHERE lang = 'fr') AS b FROM t GROUP BY term),
w AS (SELECT a * (ln(3 / (1 + CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER))) + 1) AS a, b * (ln(3 / (1 + CAST(a > 0 AS INTEGER) + CAST(b > 0 AS INTEGER))) + 1) AS b FROM c)
SELECT round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 6) AS cosine FROM w""")
def tfidf_distance(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("m_message"), "lang")
    return LogDistance(d.where("lang = 'en'"), d.where("lang = 'fr'"), vectorizer="tfidf").cosine().select(F.round("cosine", 6).alias("cosine"))


@query(f"WITH {EVENTS} SELECT row_id, m_timestamp - INTERVAL 700 DAY AS nanos, date_trunc('second', m_timestamp) - INTERVAL 700 DAY AS seconds FROM events_log")
def repaired_epochs(spark, sf):
    """Times whose leading digits were lost or changed."""
    at = micros("m_timestamp") - 700 * 86_400_000_000
    nanos, seconds = (at * 1000).cast("string"), F.floor(at / 1_000_000).cast("string")
    broken = F.col("row_id") % 3 == 0
    cut = F.when(broken, F.concat(F.lit("-6"), F.substr(nanos, F.lit(3)), F.lit("0"))).otherwise(nanos)
    changed = F.when(broken, F.concat(F.lit("18"), F.substr(seconds, F.lit(3)))).otherwise(seconds)
    out = log_events(spark, sf).select("row_id", cut.alias("nanos"), changed.alias("seconds"))
    return out.select("row_id", epoch_nanos("nanos").cast("timestamp_ntz").alias("nanos"), epoch_seconds("seconds").cast("timestamp_ntz").alias("seconds"))


def _streamed(spark, sf, make):
    """What a stream of events has written after all of them have passed."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    path = scratch_path(spark, "stream")
    made = make(as_log(stream))
    made.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.parquet(path)


@query(f"WITH {EVENTS} SELECT row_id, {sql_mask('m_message')} AS e_message_normalized, array_to_string(string_split(m_message, ' '), '|') AS e_words, CAST(length(m_message) AS INTEGER) AS e_chars_len FROM events_log")
def stream_enriched(spark, sf):
    out = _streamed(spark, sf, lambda log: enhance_stream(log.select("row_id", "m_message")))
    return out.select("row_id", "e_message_normalized", F.array_join("e_words", "|").alias("e_words"), "e_chars_len")


def _covers(template: str, message: str, wild: str = "<*>"):
    """Whether a template's words are those of a message, but for wild ones."""
    a, b = F.split(template, " "), F.split(message, " ")
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | (x == wild), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(same, lambda x: x)


@query(f"WITH {EVENTS} SELECT row_id, {sql_mask('m_message')} AS message, true AS covered FROM events_log")
def stream_drain(spark, sf):
    """A stream's templates, each of which covers its line."""
    masked = lambda log: log.select("row_id", text.mask(F.col("m_message")).alias("e_message_normalized"))
    out = _streamed(spark, sf, lambda log: parse_stream(masked(log)))
    spaced = F.array_join(t.online.drain_tokens("message"), " ")
    return out.withColumn("tokens", spaced).select("row_id", "message", _covers("e_event_drain_template", "tokens").alias("covered"))


@query(f"WITH {EVENTS} SELECT row_id, {sql_mask('m_message')} AS message, true AS known FROM events_log")
def drain_state(spark, sf):
    """Two batches with the state between them: the ids of the second's templates are those of the first's."""
    log = log_events(spark, sf).select("row_id", text.mask(F.col("m_message")).alias("e_message_normalized"))
    state = DrainState(spark, scratch_path(spark, "drain"))
    first = state.parse(log)
    again = state.parse(log).select("row_id", F.col("e_event_drain_id").alias("again"))
    seen = first.select("e_event_drain_id").distinct().select(F.col("e_event_drain_id").alias("again"), F.lit(True).alias("known"))
    return first.join(again, "row_id").join(seen, "again", "left").select("row_id", "message", F.coalesce("known", F.lit(False)).alias("known"))


@query(f"WITH {EVENTS} SELECT row_id, true AS masked, true AS covered FROM events_log")
def drain_masked(spark, sf):
    """Drain with masks of its own: no digit is left outside of words, and templates cover the masked lines."""
    out = t.parse_drain(log_events(spark, sf), templates=True, drain_masking=True)
    own = [(to.replace("<", "<:").replace(">", ":>"), p) for to, p in text.MASKS]
    lines = out.withColumn("tokens", F.array_join(t.online.drain_tokens_of(text.mask(F.col("m_message"), own)), " "))
    return lines.select("row_id", (F.contains("tokens", F.lit("<:NUM:>")) & ~F.col("tokens").rlike(r"(^| )\d+( |$)")).alias("masked"), _covers("e_event_drain_template", "tokens").alias("covered"))


@query(f"WITH {EVENTS} SELECT row_id, 64 AS size, true AS known FROM events_log")
def embedded_messages(spark, sf):
    """The stand-in encoder's vectors, all of one length."""
    e = EventLogEnhancer(log_events(spark, sf))
    e.normalize()
    out = e.embed(lambda df, column, name: with_encoder(df, column, name, hashing_encoder))
    norm = F.sqrt(F.aggregate("e_bert_emb", F.lit(0.0), lambda a, x: a + x * x))
    return out.select("row_id", F.size("e_bert_emb").alias("size"), (norm > 0).alias("known"))
