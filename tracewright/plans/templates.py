"""Queries of the template parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import templates as t
from ..operators.templates import bijection
from ..scratch import save
from ..sources.tables import log_documents, log_events
from .enrichment import EVENTS, sql_mask

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LINES = f"WITH {EVENTS}, m AS (SELECT row_id, {sql_mask('m_message')} AS text FROM events_log UNION ALL SELECT doc_id + 1000000, {sql_mask('text')} FROM documents)"


def _lines(spark, sf):
    """Masked first lines of events and documents."""
    events = log_events(spark, sf).select("row_id", "m_message")
    docs = log_documents(spark, sf).select((F.col("row_id") + 1_000_000).alias("row_id"), "m_message")
    # saved, because parsers read their lines twice and the masks are costly
    return save(events.union(docs).select("row_id", text.mask(F.col("m_message")).alias("e_message_normalized")), "lines")


def _has(template, words, wild):
    """Whether words have all that template fixes; by a set, as a search for each would grow with the square of a line."""
    missing = F.array_except(template, F.concat(words, F.array(F.lit(wild))))
    return (F.size(template) == 0) | (F.size(missing) == 0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(LINES + r"""
, d AS (SELECT text, min(row_id) AS first, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM m WHERE text IS NOT NULL GROUP BY text),
b AS (SELECT *, len(w) AS size, len(list_filter(w, lambda x: x = '<*>')) AS params FROM d),
h AS (SELECT size, params, count(*) AS events, arg_min(w, first) AS hw, arg_min(text, first) AS ht FROM b GROUP BY size, params),
j AS (SELECT b.*, events > 2 AND size > 0 AND (w <> hw OR text = ht) AS merges FROM b JOIN h USING (size, params)),
x AS (SELECT size, params, unnest(w) AS word, generate_subscripts(w, 1) AS pos, text FROM j WHERE merges),
p AS (SELECT size, params, pos, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS shown, count(*) AS n FROM x GROUP BY size, params, pos),
t AS (SELECT size, params, string_agg(shown, ' ' ORDER BY pos) AS merged FROM p GROUP BY size, params HAVING max(n) > 1),
r AS (SELECT j.text, CASE WHEN merges THEN coalesce(merged, j.text) ELSE j.text END AS e_template_ael FROM j LEFT JOIN t USING (size, params))
SELECT m.row_id, e_template_ael, substr(md5(e_template_ael), 1, 8) AS e_event_ael_id FROM m LEFT JOIN r USING (text)""")
def ael_templates(spark, sf):
    return t.parse_ael(_lines(spark, sf)).select("row_id", "e_template_ael", "e_event_ael_id")


@query(LINES + r"""
, d AS (SELECT text, min(row_id) AS first, count(*) AS n, string_split(regexp_replace(replace(text, ',', ', '), ' +', ' ', 'g'), ' ') AS w FROM m WHERE text IS NOT NULL GROUP BY text),
x AS (SELECT text, first, n, len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
o AS (SELECT pos, word, sum(n) AS often FROM x GROUP BY pos, word),
f AS (SELECT x.*, often FROM x JOIN o USING (pos, word)),
s AS (SELECT text, often, count(*) AS c, min(pos) AS p FROM f GROUP BY text, often),
r AS (SELECT text, often AS root, c AS root_words FROM s QUALIFY row_number() OVER (PARTITION BY text ORDER BY c DESC, p) = 1),
g AS (SELECT f.*, root, root_words FROM f JOIN r USING (text)),
h AS (SELECT size, root, root_words, min(first) AS first FROM g GROUP BY ALL),
l AS (SELECT size, root, root_words, pos FROM g JOIN h USING (size, root, root_words, first) WHERE often <> root),
v AS (SELECT DISTINCT size, root, root_words, unnest(ws) AS word FROM (SELECT size, root, root_words, pos, list(DISTINCT word) AS ws FROM g JOIN l USING (size, root, root_words, pos) GROUP BY ALL HAVING count(DISTINCT word) >= 2)),
q AS (SELECT g.text, g.pos, CASE WHEN contains(g.word, '<*>') OR v.word IS NOT NULL OR (len(regexp_extract_all(g.word, '\p{Nd}')) > 0 AND len(regexp_extract_all(g.word, '\p{Nd}')) / length(g.word) >= 0.3) THEN '<*>' ELSE g.word END AS shown
 FROM g LEFT JOIN v ON g.size = v.size AND g.root = v.root AND g.root_words = v.root_words AND g.word = v.word),
k AS (SELECT text, string_agg(shown, ' ' ORDER BY pos) AS e_template_brain FROM q GROUP BY text)
, i AS (SELECT e_template_brain, 'E' || (row_number() OVER (ORDER BY min(first)) - 1) AS e_event_brain_id FROM k JOIN d USING (text) GROUP BY 1)
SELECT m.row_id, e_template_brain, e_event_brain_id FROM m LEFT JOIN k USING (text) LEFT JOIN i USING (e_template_brain)""")
def brain_templates(spark, sf):
    return t.parse_brain(_lines(spark, sf)).select("row_id", "e_template_brain", "e_event_brain_id")


@query(LINES + r""", d AS (SELECT text, list_filter(regexp_split_to_array(text, '[\s=:,]'), lambda x: x <> '') AS w FROM m WHERE text IS NOT NULL GROUP BY text)
SELECT CAST(len(w) AS INTEGER) AS size, count(*) AS messages FROM d GROUP BY 1""")
def iplom_step1_lengths(spark, sf):
    texts = _lines(spark, sf).select(F.col("e_message_normalized").alias("text")).where("text IS NOT NULL").distinct()
    tokens = F.filter(F.split("text", r"[\s=:,]"), lambda x: x != "")
    return bijection.step1(texts.withColumn("tokens", tokens)).groupBy("size").agg(F.count("*").alias("messages"))


@query(LINES + r""", d AS (SELECT text, string_split(text, ' ') AS w FROM m WHERE text IS NOT NULL GROUP BY text),
x AS (SELECT len(w) AS size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
c AS (SELECT size, pos, count(DISTINCT word) AS n FROM x GROUP BY size, pos),
f AS (SELECT size, pos AS spot FROM c QUALIFY row_number() OVER (PARTITION BY size ORDER BY n, pos) = 1 AND n > 1)
SELECT d.text, CASE WHEN spot IS NOT NULL THEN w[spot] END AS key2 FROM d LEFT JOIN f ON len(d.w) = f.size""")
def iplom_step2_columns(spark, sf):
    texts = _lines(spark, sf).select(F.col("e_message_normalized").alias("text")).where("text IS NOT NULL").distinct()
    return bijection.step2(bijection.step1(texts.withColumn("tokens", F.split("text", " ")))).select("text", "key2")


IPLOM = LINES + r"""
, d AS (SELECT text, min(row_id) AS first, count(*) AS n, {tokens} AS w FROM m WHERE text IS NOT NULL GROUP BY text),
a AS (SELECT *, len(w) AS size FROM d WHERE len(w) > 0),
x AS (SELECT size, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM a),
f AS (SELECT size, pos AS spot FROM (SELECT size, pos, count(DISTINCT word) AS words FROM x GROUP BY size, pos) QUALIFY row_number() OVER (PARTITION BY size ORDER BY words, pos) = 1 AND words > 1),
b AS (SELECT a.*, CASE WHEN spot IS NOT NULL THEN w[spot] END AS key2 FROM a LEFT JOIN f USING (size)),
y AS (SELECT size, key2, pos, count(DISTINCT word) AS words FROM (SELECT size, key2, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM b) GROUP BY size, key2, pos),
r AS (SELECT *, row_number() OVER (PARTITION BY size, key2 ORDER BY words = 1, same DESC, words, pos) AS r FROM (SELECT *, count(*) OVER (PARTITION BY size, key2, words) AS same FROM y)),
g AS (SELECT size, key2, count(*) FILTER (WHERE words = 1) / count(*) AS good, max(pos) FILTER (WHERE r = 1 AND words > 1) AS q1, max(pos) FILTER (WHERE r = 2 AND words > 1) AS q2 FROM r GROUP BY size, key2),
p AS (SELECT size, key2, least(q1, q2) AS p1, greatest(q1, q2) AS p2 FROM g WHERE good <= 0.35 AND q1 IS NOT NULL AND q2 IS NOT NULL),
j AS (SELECT b.*, p1, w[p1] AS v1, w[p2] AS v2 FROM b LEFT JOIN p ON b.size = p.size AND b.key2 IS NOT DISTINCT FROM p.key2),
o AS (SELECT size, key2, v1, v2, sum(n) AS n FROM j WHERE p1 IS NOT NULL GROUP BY ALL),
s1 AS (SELECT size, key2, v1, count(*) AS m1, sum(n) AS n1 FROM o GROUP BY ALL), s2 AS (SELECT size, key2, v2, count(*) AS m2, sum(n) AS n2 FROM o GROUP BY ALL),
k AS (SELECT j.text, j.w, j.size, j.key2, CASE WHEN m1 > 1 AND m2 > 1 THEN NULL WHEN m1 > 1 THEN CASE WHEN m1 / n1 < 0.1 THEN '2:' || j.v2 ELSE '1:' || j.v1 END
 WHEN m2 > 1 THEN CASE WHEN m2 / n2 < 0.1 THEN '1:' || j.v1 ELSE '2:' || j.v2 END WHEN m1 = 1 THEN '1:' || j.v1 END AS key3
 FROM j LEFT JOIN s1 ON j.size = s1.size AND j.key2 IS NOT DISTINCT FROM s1.key2 AND j.v1 = s1.v1 LEFT JOIN s2 ON j.size = s2.size AND j.key2 IS NOT DISTINCT FROM s2.key2 AND j.v2 = s2.v2),
z AS (SELECT size, key2, key3, pos, CASE WHEN min(word) = max(word) THEN min(word) ELSE '<*>' END AS shown FROM (SELECT size, key2, key3, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM k) GROUP BY size, key2, key3, pos),
t AS (SELECT size, key2, key3, string_agg(shown, ' ' ORDER BY pos) AS template FROM z GROUP BY size, key2, key3),
u AS (SELECT text, template, k.size, k.key2, k.key3 FROM k JOIN t ON k.size = t.size AND k.key2 IS NOT DISTINCT FROM t.key2 AND k.key3 IS NOT DISTINCT FROM t.key3)
"""
IPLOM_BY_MARKS = IPLOM.replace("{tokens}", r"list_filter(regexp_split_to_array(text, '[\s=:,]'), lambda x: x <> '')")
IPLOM_BY_SPACES = IPLOM.replace("{tokens}", "string_split(text, ' ')")


@query(IPLOM_BY_MARKS + "SELECT row_id, template AS e_template_iplom, coalesce(substr(md5(template), 1, 8), 'e_null') AS e_event_iplom_id FROM m LEFT JOIN u USING (text)")
def iplom_templates(spark, sf):
    return t.parse_iplom(_lines(spark, sf)).select("row_id", "e_template_iplom", "e_event_iplom_id")


@query(IPLOM_BY_SPACES + """, l AS (SELECT DISTINCT size, key2, key3 FROM u),
i AS (SELECT *, 'e' || dense_rank() OVER (ORDER BY size) || CASE WHEN key2 IS NOT NULL THEN 'e' || dense_rank() OVER (PARTITION BY size ORDER BY key2) ELSE '' END
 || CASE WHEN key3 IS NOT NULL THEN 'e' || dense_rank() OVER (PARTITION BY size, key2 ORDER BY key3 NULLS FIRST) ELSE '' END AS id FROM l),
v AS (SELECT text, template, id FROM u JOIN i ON u.size = i.size AND u.key2 IS NOT DISTINCT FROM i.key2 AND u.key3 IS NOT DISTINCT FROM i.key3)
SELECT row_id, template AS e_template_pliplom, id AS e_event_pliplom_id FROM m LEFT JOIN v USING (text)""")
def pliplom_templates(spark, sf):
    return t.parse_pliplom(_lines(spark, sf)).select("row_id", "e_template_pliplom", "e_event_pliplom_id")


@query(LINES + " SELECT parser, row_id, true AS covered FROM m, (SELECT unnest(['drain', 'lenma', 'spell', 'tip']) AS parser)")
def templates_cover(spark, sf):
    """Whether each line has what its template fixes: word for word at its place (Drain, LenMa), or at all (Spell, Tipping)."""
    lines = _lines(spark, sf)
    message, name = F.col("e_message_normalized"), "e_message_normalized"
    blank = lambda c: F.coalesce(c, F.array().cast("array<string>"))

    def by_place(template, words, wild):
        same = F.zip_with(template, words, lambda x, y: F.coalesce((x == y) | (x == wild), F.lit(False)))
        return (F.size(template) == F.size(words)) & F.forall(same, lambda x: x)

    drain = t.parse_drain(lines, templates=True).select(F.lit("drain").alias("parser"), "row_id", by_place(t.bins.blank_split(F.col("e_event_drain_template")), t.online.drain_tokens(name), "<*>").alias("covered"))
    lenma = t.parse_lenma(lines.withColumn("e_words", text.words(message))).select(F.lit("lenma"), "row_id", by_place(F.split("e_template_lenma", " "), F.col("e_words"), ""))
    spell = t.parse_spell(lines).select(F.lit("spell"), "row_id", _has(F.split("e_template_spell", " "), F.split(F.trim(F.regexp_replace(message, r"\s+", " ")), " "), "*"))
    tip = t.parse_tip(lines, templates=True).select(F.lit("tip"), "row_id", _has(blank(F.filter(F.split("e_event_tip_template", " "), lambda x: x != "")), t.bins.blank_split(message), "<*>"))
    return drain.union(lenma).union(spell).union(tip)


@query()
def drain_templates(spark, sf):
    return t.parse_drain(_lines(spark, sf), templates=True)


@query()
def lenma_templates(spark, sf):
    return t.parse_lenma(_lines(spark, sf).withColumn("e_words", text.words(F.col("e_message_normalized"))))


@query()
def spell_templates(spark, sf):
    return t.parse_spell(_lines(spark, sf))


@query()
def tip_templates(spark, sf):
    return t.parse_tip(_lines(spark, sf), templates=True)
