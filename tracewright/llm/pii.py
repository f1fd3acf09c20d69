"""Personal data and secrets in texts, with DataFrame operations only.

Regular expressions propose spans of each kind; validators confirm them: the parts of an
address, the Luhn sum of a card, the digits of a phone number, the remainder modulo 97
of an account number (IBAN), letters and digits together in a secret. Words in the
CONTEXT characters before and after a span raise its score, others lower it. Spans of the
base kinds stay whatever their score. A proposed social security number and a secret of
no known form, which have no checksum, count only with a fitting word near them.

The expressions are possessive wherever that finds the same, so no text makes them
backtrack far or nest deeply. Positions are code points; they follow from the lengths of
the matches and of the parts between them. A null text counts as empty. Repeated rows
are alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT, RAISE, LEAST = 40, 0.3, 0.5
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_LOCAL = r"[A-Za-z0-9._%+-]"
_KEYS = r"(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|xox[abps]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)"
#: kind: (what a text must contain, expression, score, words that raise it, words that lower it)
KINDS = {
    "email": ("@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, "mail|contact|write", None),
    "ip": (".", r"[0-9]++(?:\.[0-9]++){3}", 0.6, "ip|host|server|address|client", "version|release|section"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9])++", 0.7, "card|credit|visa|pay|account", "isbn|serial|tracking"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|fax", None),
    "iban": (None, r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.9, "iban|account|bank|transfer", None),
    "ssn": ("-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, "ssn|social|security", None),
    "key": (None, rf"(?<![A-Za-z0-9]){_KEYS}", 0.9, "key|token|secret|auth", None),
    "secret": (None, r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+", 0.3, "token|secret|password|passwd|api|key|auth|bearer|credential", "commit|sha|md5|checksum|digest"),
}
BASE = ("email", "ip", "card", "phone")
_EMPTY = "CAST(array() AS array<struct<start: int, end: int, text: string>>)"


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum of 0 modulo 10."""
    digit = lambda i: F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
    doubled = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    add = lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number, spaces left out, has remainder 1."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    add = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), add) == 1)


def _valid(kind: str, text: Column) -> Column:
    digits = F.regexp_replace(text, "[^0-9]", "")
    n = F.length(digits)
    if kind == "ip":
        return text.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(text)
    if kind == "secret":
        return text.rlike("[0-9]") & text.rlike("[A-Za-z]") & ~text.rlike("^(?:AKIA|gh[opsu]_|xox[abps]-|eyJ)")
    return F.lit(True)


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for docs (doc_id, text).

    spans: kind, start, end (exclusive), text and score, by kind as in KINDS, then start.
    """
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    matches = lambda needle, regex: F.when(F.contains("text", F.lit(needle)) if needle else F.lit(True), F.regexp_extract_all("text", F.lit(regex), F.lit(0)))
    now = now.select("*", *(matches(needle, regex).alias(f"m_{k}") for k, (needle, regex, *_) in KINDS.items()))
    # the parts before each match, only where there are matches
    now = now.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("text", regex, -1)).alias(f"p_{k}") for k, (_, regex, *_) in KINDS.items()))
    begin = "a.at + char_length(p_{0}[i])"
    walk = f"""aggregate(sequence(0, size(m_{{0}}) - 1), struct(0 AS at, {_EMPTY} AS found), (a, i) -> struct(
        {begin} + char_length(m_{{0}}[i]) AS at, concat(a.found, array(struct({begin} AS start, {begin} + char_length(m_{{0}}[i]) AS end, m_{{0}}[i] AS text))) AS found), a -> a.found)"""
    now = now.select("doc_id", "text", *(F.expr(f"CASE WHEN size(m_{k}) > 0 THEN {walk.format(k)} ELSE {_EMPTY} END").alias(f"s_{k}") for k in KINDS))

    def confirmed(kind: str) -> Column:
        _, _, score, up, down = KINDS[kind]
        around = lambda s: F.concat_ws("\n", F.substr("text", F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1, F.least(s["start"], F.lit(CONTEXT))), F.substr("text", s["end"] + 1, F.lit(CONTEXT)))
        by = lambda s, words, step: F.when(around(s).rlike(rf"(?i)(?<![a-z])(?:{words})"), step).otherwise(0.0) if words else F.lit(0.0)
        scored = lambda s: F.round(F.least(F.lit(1.0), F.lit(score) + by(s, up, RAISE) - by(s, down, RAISE)), 2)
        spans = F.transform(F.filter(f"s_{kind}", lambda s: _valid(kind, s["text"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), scored(s).alias("score")))
        return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= LEAST)

    return now.select("doc_id", F.concat(*map(confirmed, KINDS)).alias("spans"))


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Every row of documents with the personal data found in it."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores)
