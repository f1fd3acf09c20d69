"""Columns derived from a message: words, tokens, n-grams, lengths and masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The masking patterns and their replacements, in order. A separator before
# or after is part of the match, so neighbours need a second pass.
MASKS = (
    ("${start}<ID>${end}", r"(?<start>[^A-Za-z0-9]|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))(?<end>[^A-Za-z0-9]|\z)"),
    ("${start}<IP>${end}", r"(?<start>[^A-Za-z0-9]|^)(\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}{1,3})(?<end>[^A-Za-z0-9]|\z)"),
    ("${start}<SEQ>${end}", r"(?<start>[^A-Za-z0-9]|^)([0-9a-f]{6,} ?){3,}(?<end>[^A-Za-z0-9]|\z)"),
    ("${start}<SEQ>${end}", r"(?<start>[^A-Za-z0-9]|^)([0-9A-F]{4} ?){4,}(?<end>[^A-Za-z0-9]|\z)"),
    ("${start}<HEX>${end}", r"(?<start>[^A-Za-z0-9]|^)(0x[a-f0-9A-F]+)(?<end>[^A-Za-z0-9]|\z)"),
    ("${start}<NUM>${end}", r"(?<start>[^A-Za-z0-9]|^)([\-\+]?\p{Nd}+)(?<end>[^A-Za-z0-9]|\z)"),
    ("${cmd}<CMD>", r"(?<cmd>executed cmd )(\".+?\")"),
)

#: What any match of a mask has in it. It is found in a small part of the time that a search for the mask takes, so texts
#: without it are left as they are.
CORES = dict(
    zip(
        (pattern for _, pattern in MASKS),
        (
            r"[0-9a-f]{2}:[0-9a-f]{2,}:[0-9a-f]{2,}:[0-9a-f]{2}",
            r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}{1,3}\.\p{Nd}",
            r"[0-9a-f]{6} ?[0-9a-f]{6}",
            r"[0-9A-F]{4} ?[0-9A-F]{4}",
            r"0x[a-f0-9A-F]",
            r"\p{Nd}",
        ),
    )
)


def words(message: Column) -> Column:
    """Split at single spaces; empty strings stay."""
    return F.split(message, " ")


def alphanumerics(message: Column) -> Column:
    """All runs of ASCII letters and decimal digits."""
    return F.regexp_extract_all(message, F.lit(r"[a-zA-Z\p{Nd}]+"), F.lit(0))


def trigram_bag(message: Column) -> Column:
    """All three-character pieces from offsets 0, 1 and 2, not across newlines; not in text order."""
    pieces = [F.regexp_extract_all(F.substr(message, F.lit(k + 1)), F.lit(r"[^\n]{3}"), F.lit(0)) for k in range(3)]
    return F.concat(*pieces)


def char_ngrams(message: Column, n: int = 3) -> Column:
    """The sliding n-grams in text order; none if n < 1 or the text is shorter."""
    if n < 1:
        return F.when(message.isNotNull(), F.array().cast("array<string>"))
    slide = F.transform(F.sequence(F.lit(1), F.char_length(message) - n + 1), lambda i: F.substr(message, i, F.lit(n)))
    return F.when(F.char_length(message) >= n, slide).when(message.isNotNull(), F.array().cast("array<string>"))


def line_count(message: Column) -> Column:
    """Newline characters: \\n and \\r count one each."""
    return F.regexp_count(message, F.lit("[\n\r]"))


def first_line(message: Column) -> Column:
    return F.substring_index(message, "\n", 1)


def mask(message: Column, patterns=MASKS, lower: bool = False, twice: bool = True) -> Column:
    """The first line with each pattern's matches replaced, twice each unless told otherwise.

    patterns: (replacement, pattern) pairs in Java's syntax.
    """
    out = first_line(message)
    out = F.lower(out) if lower else out
    for replacement, pattern in patterns:
        for _ in range(2 if twice else 1):
            out = _replaced(out, pattern, replacement)
    return out


def _replaced(message: Column, pattern: str, replacement: str) -> Column:
    core = CORES.get(pattern)
    if core is None:
        return F.regexp_replace(message, pattern, replacement)
    # an array of one, so that the message is worked out once
    return F.transform(F.array(message), lambda x: F.when(x.rlike(core), F.regexp_replace(x, pattern, replacement)).otherwise(x))[0]
