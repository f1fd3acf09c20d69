"""Parsers that learn line by line: Drain, LenMa and Spell.

Each has a key that a line and the clusters it can join share, so lines with other keys
don't change its result. Lines are dealt by key, sorted by row_id within it and streamed:
a task holds the clusters of one key at a time, never its lines.
"""

from __future__ import annotations

from array import array
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.text import MASKS, mask
from ...model import MESSAGE, ROW, require
from ...scratch import save
from ..windows import numbered
from .bins import WILD, blank_split, short_id


#: Lines that a task remembers with their clusters; beyond it, it forgets and works them out again.
MOST_SEEN = 100_000


class Drain:
    """Clusters of one key: a line joins the one that agrees in most positions, sim_th of them at least."""

    def __init__(self, sim_th: float = 0.4):
        self.sim_th, self.found, self.changes = sim_th, [], 0

    def add(self, tokens: list[str]) -> int:
        best, rank = -1, (-1.0, -1)
        for k, template in enumerate(self.found):
            same = sum(a == b and a != WILD for a, b in zip(template, tokens, strict=True))
            this = (same / len(tokens) if tokens else 1.0, template.count(WILD))
            if this > rank:
                best, rank = k, this
        if best < 0 or rank[0] < self.sim_th:
            self.found.append(list(tokens))
            self.changes += 1
            return len(self.found) - 1
        merged = [a if a == b else WILD for a, b in zip(self.found[best], tokens, strict=True)]
        if merged != self.found[best]:
            self.found[best] = merged
            self.changes += 1
        return best

    def template(self, k: int) -> str:
        return " ".join(self.found[k])


class LimitedDrain(Drain):
    """Drain over all lines, with limits on live clusters and on the first tokens of a length.

    A first token that has no branch of its own looks in the branch of parameters. It gets
    one if no cluster there is like it and the length has room; the last place is kept for
    parameters. When there are too many clusters, the one that was used longest ago is
    forgotten.
    """

    def __init__(self, sim_th: float = 0.4, max_clusters: int = 1024, max_children: int = 100):
        super().__init__(sim_th)
        self.max_clusters, self.max_children = max_clusters, max_children
        self.live: OrderedDict[int, None] = OrderedDict()  # in the order of their last use
        self.branches: dict[int, dict[str, list[int]]] = {}  # token count -> first token -> clusters

    def _branch(self, children: dict[str, list[int]], tokens: list[str]) -> str | None:
        """The branch in which a line is looked for."""
        if len(tokens) < 2:
            return "" if "" in children else None
        return tokens[0] if tokens[0] in children else WILD if WILD in children else None

    def _place(self, children: dict[str, list[int]], tokens: list[str]) -> str:
        """The branch to which a line's new cluster goes."""
        first = "" if len(tokens) < 2 else tokens[0]
        if first in children or not first:
            return first
        room = self.max_children - len(children) - (WILD not in children)
        return WILD if room <= 0 or any(c.isdigit() for c in first) else first

    def add(self, tokens: list[str]) -> int:
        self.changes += 1  # even a use changes what is forgotten next
        children = self.branches.setdefault(len(tokens), {})
        branch = self._branch(children, tokens)
        best, rank = -1, (-1.0, -1)
        for k in children.get(branch, ()):
            if k in self.live:
                template = self.found[k]
                same = sum(a == b and a != WILD for a, b in zip(template, tokens, strict=True))
                this = (same / len(tokens) if tokens else 1.0, template.count(WILD))
                if this > rank:
                    best, rank = k, this
        if best >= 0 and rank[0] >= self.sim_th:
            self.found[best] = [a if a == b else WILD for a, b in zip(self.found[best], tokens, strict=True)]
            self.live.move_to_end(best)
            return best
        self.found.append(list(tokens))
        k = len(self.found) - 1
        self.live[k] = None
        if len(self.live) > self.max_clusters:
            self.live.popitem(last=False)
        own = children.setdefault(self._place(children, tokens), [])
        own[:] = [c for c in own if c in self.live] + [k]
        return k


class LenMa:
    """Clusters of equal word count and first word, joined by exact match or by similar word lengths."""

    def __init__(self, threshold: float = 0.9, least_same: int = 3):
        self.threshold, self.least_same, self.found, self.changes = threshold, least_same, [], 0

    def add(self, words: list[str]) -> int:
        lengths = np.array([len(w) for w in words], float)
        best, rank = -1, self.threshold
        for k, (own, sizes) in enumerate(self.found):
            if all(a is None or a == b for a, b in zip(own, words, strict=True)):
                score = 1.0
            elif sum(a == b for a, b in zip(own, words, strict=True)) < self.least_same:
                continue
            else:
                score = float(sizes @ lengths / max(np.sqrt((sizes @ sizes) * (lengths @ lengths)), 1e-300))
            if score > rank or (score == rank and best < 0):
                best, rank = k, score
        if best < 0:
            self.found.append((list(words), lengths))
            self.changes += 1
            return len(self.found) - 1
        own, sizes = self.found[best]
        merged = [a if a == b else None for a, b in zip(own, words, strict=True)]
        if merged != own or (sizes != lengths).any():
            self.found[best] = (merged, lengths)
            self.changes += 1
        return best

    def template(self, k: int) -> str:
        return " ".join("" if w is None else w for w in self.found[k][0])


class Spell:
    """Clusters joined by the longest common subsequence, found greedily from the left."""

    STAR = "*"

    def __init__(self):
        self.found: list[list[str]] = []
        self.changes = 0
        self.holders: dict[str, dict[int, int]] = {}  # which templates have a word, and how often

    def _put(self, k: int, template: list[str]) -> None:
        old = Counter(self.found[k]) if k < len(self.found) else Counter()
        self.found[k:] = [template] if k == len(self.found) else [template, *self.found[k + 1 :]]
        new = Counter(template)
        for word in old.keys() | new.keys():
            if new[word]:
                self.holders.setdefault(word, {})[k] = new[word]
            elif word in self.holders:
                self.holders[word].pop(k, None)
        self.changes += 1

    def _candidates(self, words: list[str], least: float) -> list[int]:
        """Templates, in order, that share as many words with a line as a common subsequence of least needs.

        Such a template has one of the words that few templates have: the commonest ones
        together are fewer than least. They only count for templates found by the others.
        """
        held = sorted((len(self.holders.get(word, ())), word, n) for word, n in Counter(words).items() if word != self.STAR)
        rest, cut = 0, len(held)
        while cut and rest + held[cut - 1][2] < least:
            cut -= 1
            rest += held[cut][2]
        shared: dict[int, int] = {}
        for _, word, n in held[:cut]:
            for k, m in self.holders.get(word, {}).items():
                shared[k] = shared.get(k, 0) + min(m, n)
        for _, word, n in held[cut:]:
            holders = self.holders.get(word, {})
            shared = {k: s + min(holders.get(k, 0), n) for k, s in shared.items() if s + rest >= least}
            rest -= n
        return sorted(k for k, n in shared.items() if n >= least)

    def _walk(self, template: list[str], words: list[str]):
        """(token, where it next stands in words or None, where the search began) for each fixed token."""
        last, at = {word: k for k, word in enumerate(words)}, 0
        for token in template:
            if token == self.STAR:
                yield token, None, at
                continue
            hit = words.index(token, at) if last.get(token, -1) >= at else None
            yield token, hit, at
            at = at if hit is None else hit + 1

    def _best(self, words: list[str]) -> tuple[int, int]:
        """(the first of the templates that have most in common with a line or -1, how much that is)."""
        best, most, size = -1, 0, len(words)
        for k in self._candidates(words, max(1, size / 2)):
            template = self.found[k]
            if size / 2 <= len(template) <= 2 * size:
                common = sum(hit is not None for _, hit, _ in self._walk(template, words))
                if common >= size / 2 and common > most:
                    best, most = k, common
        return best, most

    def add(self, words: list[str]) -> int:
        return self._join(self._best(words)[0], words)

    def _join(self, best: int, words: list[str]) -> int:
        """Let a line into a cluster, or into one of its own."""
        size = len(words)
        if best < 0:
            self._put(len(self.found), list(words))
            return len(self.found) - 1
        merged: list[str] = []
        for token, hit, began in self._walk(self.found[best], words):
            skipped = token == self.STAR or (hit is None and began < size) or (hit is not None and hit > began)
            if skipped and (not merged or merged[-1] != self.STAR):
                merged.append(self.STAR)
            if hit is not None:
                merged.append(token)
        if (merged or [""]) != self.found[best]:
            self._put(best, merged or [""])
        return best

    def template(self, k: int) -> str:
        return " ".join(self.found[k])


class IndexedSpell(Spell):
    """Spell for many templates: the same clusters, with an index of arrays.

    A word's repeats are items of their own, so a line and a template share as many items
    as words. A template only loses words, so what the index has of it is a bound for what
    it can have in common with a line; templates are compared in the order of that bound.
    """

    #: So many changes that a known line is compared with one by one; after more it is searched for.
    NEAR = 64

    def __init__(self):
        super().__init__()
        self.items: dict[str | tuple[str, int], array] = {}  # templates, in order, that began with an item
        self.sizes, self.fixed = array("i"), array("i")  # a template's tokens, and those that aren't stars
        self.changed = array("i")  # the last change of a template
        self.log = array("i")  # the template of each change

    def _items(self, words: list[str]) -> list[str | tuple[str, int]]:
        seen: dict[str, int] = {}
        out: list[str | tuple[str, int]] = []
        for word in words:
            n = seen.get(word, 0)
            seen[word] = n + 1
            out.append((word, n) if n else word)
        return out if self.STAR not in seen else [x for x in out if self.STAR != (x[0] if isinstance(x, tuple) else x)]

    def _put(self, k: int, template: list[str]) -> None:
        fixed = len(template) - template.count(self.STAR)
        self.changes += 1
        self.log.append(k)
        if k < len(self.found):
            self.found[k], self.sizes[k], self.fixed[k], self.changed[k] = template, len(template), fixed, self.changes
            return
        self.found.append(template)
        for values, x in ((self.sizes, len(template)), (self.fixed, fixed), (self.changed, self.changes)):
            values.append(x)
        for item in self._items(template):
            held = self.items.get(item)
            if held is None:
                self.items[item] = held = array("i")
            held.append(k)

    def _bounds(self, words: list[str]) -> list[tuple[int, int]]:
        """(template, bound for what it has in common with a line) where that and its length let them meet; the largest first.

        A template that shares enough items has one of the rarer ones. Those bring the
        templates, the commoner ones are looked up for what is left of them.
        """
        size = len(words)
        least = max(1, (size + 1) // 2)
        held = sorted((h for h in map(self.items.get, self._items(words)) if h is not None), key=len)
        if len(held) < least:
            return []
        view = lambda values: np.frombuffer(values, np.int32)
        rest = least - 1
        rare, common = held[: len(held) - rest], held[len(held) - rest :]
        found, shared = np.unique(view(rare[0]) if len(rare) == 1 else np.concatenate([view(h) for h in rare]), return_counts=True)
        sizes = view(self.sizes)[found]
        meets = (2 * sizes >= size) & (sizes <= 2 * size) & (view(self.fixed)[found] >= least)
        found, shared = found[meets], shared[meets]
        for h in common:
            if not len(found):
                return []
            h = view(h)
            shared += h[np.minimum(np.searchsorted(h, found), len(h) - 1)] == found
            rest -= 1
            enough = shared + rest >= least
            found, shared = found[enough], shared[enough]
        shared = np.minimum(shared, view(self.fixed)[found])
        order = np.argsort(-shared, kind="stable")
        return list(zip(found[order].tolist(), shared[order].tolist()))

    def _better(self, bounds, words: list[str], best: int = -1, most: int = 0) -> tuple[int, int]:
        """As _best(), of best and the templates of bounds."""
        size, last = len(words), None
        for k, bound in bounds:
            if bound < most:
                break
            if bound == most and k > best:
                continue
            last = last or {word: n for n, word in enumerate(words)}
            common = at = 0
            for token in self.found[k]:
                if last.get(token, -1) >= at and token != self.STAR:
                    at = words.index(token, at) + 1
                    common += 1
            if 2 * common >= size and (common > most or (common == most and k < best)):
                best, most = k, common
        return best, most

    def _best(self, words: list[str]) -> tuple[int, int]:
        return self._better(self._bounds(words), words)

    def again(self, words: list[str], was: tuple[int, int, int] | None) -> tuple[int, int, int]:
        """add(), for a line that had been added: was is what this gave for it the last time.

        Gives (cluster, what they had in common, changes before). As long as that cluster
        is as it was, only templates that changed since can be better.
        """
        before = self.changes
        if was is not None and was[2] == before:
            return was
        if was is not None and self.changed[was[0]] <= was[2] and before - was[2] <= self.NEAR:
            size = len(words)
            since = [(k, size) for k in set(self.log[was[2] :]) if size <= 2 * self.sizes[k] <= 4 * size]
            best, most = self._better(since, words, was[0], was[1])
            return (self._join(best, words) if best != was[0] else best), most, before
        best, most = self._best(words)
        return self._join(best, words), most, before


def _stream(make, names: list[str], at: int):
    """Add _cluster and _line (the template at that line); at the end of a key, a row per cluster with its _final."""

    def run(batches):
        key = machine = None
        seen: dict[tuple, tuple[int, int]] = {}
        empty = lambda n, schema: [pa.nulls(n, f.type) for f in schema]

        def finals(schema):
            n = len(machine.found)
            rows = empty(n, schema)
            rows[names.index("_key")] = pa.array([key] * n, pa.string())
            return pa.RecordBatch.from_arrays([*rows, pa.array(range(n), pa.int32()), pa.nulls(n, pa.string()), pa.array([machine.template(k) for k in range(n)], pa.string())], [*names, "_cluster", "_line", "_final"])

        for batch in batches:
            clusters, lines = [], []
            ends = []
            for this, tokens in zip(batch.column(names.index("_key")).to_pylist(), batch.column(at).to_pylist(), strict=True):
                if machine is None or this != key:
                    if machine is not None:
                        ends.append(finals(batch.schema))
                    key, machine = this, make()
                    seen.clear()
                line = tuple(tokens)
                before = machine.changes
                changes, k = seen.get(line, (-1, -1))
                if changes != before:
                    k = machine.add(tokens)
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    if machine.changes == before:  # the same line finds the same cluster until something changes
                        seen[line] = (before, k)
                clusters.append(k)
                lines.append(machine.template(k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(clusters, pa.int32()), pa.array(lines, pa.string()), pa.nulls(len(lines), pa.string())], [*names, "_cluster", "_line", "_final"])
            yield from ends
        if machine is not None:
            yield finals(batch.schema)

    return run


def _parse(df: DataFrame, tokens: Column, key: Column, make) -> tuple[DataFrame, DataFrame]:
    """(the lines of df with _key, _cluster and _line, the clusters with _final and _first row)."""
    require(df, ROW)
    ready = df.withColumns({"_tokens": tokens, "_key": key}).where("_tokens IS NOT NULL")
    dealt = ready.repartition("_key").sortWithinPartitions("_key", ROW)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in dealt.schema)
    done = save(dealt.mapInArrow(_stream(make, dealt.columns, dealt.columns.index("_tokens")), fields + "_cluster int, _line string, _final string"), "templates")
    lines = done.where("_final IS NULL").drop("_final", "_tokens")
    first = lines.groupBy("_key", "_cluster").agg(F.min(ROW).alias("_first"))
    return lines, done.where("_final IS NOT NULL").select("_key", "_cluster", "_final").join(first, ["_key", "_cluster"])


def _with_nulls(df: DataFrame, out: DataFrame, column: str) -> DataFrame:
    """out and the rows of df without a message."""
    return out.unionByName(df.where(F.col(column).isNull()), allowMissingColumns=True)


def drain_tokens_of(message: Column) -> Column:
    """Tokens between white space and underscores."""
    return blank_split(F.replace(message, F.lit("_"), F.lit(" ")))


def drain_tokens(column: str) -> Column:
    return drain_tokens_of(F.col(column))


def drain_key(tokens: Column) -> Column:
    """Token count and first token; one with digits counts as a parameter."""
    first = F.when(F.get(tokens, F.lit(0)).rlike("[0-9]"), WILD).otherwise(F.get(tokens, F.lit(0)))
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.when(F.size(tokens) > 1, first))


def parse_drain(df: DataFrame, column: str = "e_message_normalized", templates: bool = False, sim_th: float = 0.4, drain_masking: bool = False, limits: tuple[int, int] | None = None) -> DataFrame:
    """df with e_event_drain_id, numbered by first row, and with templates also each line's template then.

    drain_masking takes the first line of m_message, with masks of the parser's own form
    <:NUM:>, in place of column. Without limits lines are dealt by token count and first
    token. limits (live clusters, first tokens of a length, 1024 and 100 as a rule) make
    any two lines matter to each other, so all go through one task, see LimitedDrain.
    """
    if drain_masking:
        require(df, MESSAGE)
        masked = [(to.replace("<", "<:").replace(">", ":>"), pattern) for to, pattern in MASKS]
        made = parse_drain(df.withColumn("_masked", mask(F.col(MESSAGE), masked)), "_masked", templates, sim_th, limits=limits)
        return made.drop("_masked")
    tokens = drain_tokens(column)
    make = (lambda: LimitedDrain(sim_th, *limits)) if limits else (lambda: Drain(sim_th))
    lines, clusters = _parse(df, tokens, F.lit("all") if limits else drain_key(tokens), make)
    ids = numbered(clusters, "_first", "_k").select("_key", "_cluster", F.concat(F.lit("e"), F.col("_k")).alias("e_event_drain_id"))
    out = lines.join(ids, ["_key", "_cluster"]).withColumnRenamed("_line", "e_event_drain_template").drop("_key", "_cluster")
    return _with_nulls(df, out if templates else out.drop("e_event_drain_template"), column)


def parse_lenma(df: DataFrame, column: str = "e_words", threshold: float = 0.9) -> DataFrame:
    """df with e_event_lenma_id and e_template_lenma, the template at the end; differing words are empty in it."""
    words = F.col(column)
    key = F.concat_ws(" ", F.size(words).cast("string"), F.get(words, F.lit(0)))
    return _final(df, column, words, key, lambda: LenMa(threshold), "lenma")


def parse_spell(df: DataFrame, column: str = "e_message_normalized", banded: bool = False) -> DataFrame:
    """df with e_event_spell_id and e_template_spell, the template at the end.

    Any two lines of like length may meet, so the exact result takes one stream. banded
    lets only lines whose lengths have the same power of two below them meet.
    """
    text = F.trim(F.regexp_replace(column, r"\s+", " "))
    key = F.length(F.bin(F.size(F.split(text, " ")))).cast("string") if banded else F.lit("all")
    require(df, ROW)
    lines = df.withColumns({"_text": text, "_at": F.coalesce(F.col(ROW).cast("long"), F.lit(-(2**63)))}).where("_text IS NOT NULL").withColumns({"_key": key, "_mark": F.unhex(F.md5("_text"))})
    texts = lines.groupBy("_key", "_text").agg(F.min("_at").alias("_at"), F.count("*").alias("_n"))
    events = lines.select("_key", "_at", "_mark", F.lit(None).cast("string").alias("_text"), F.lit(None).cast("long").alias("_n"))
    texts = texts.select("_key", "_at", F.unhex(F.md5("_text")).alias("_mark"), "_text", "_n")
    # a text comes before its first line
    dealt = events.union(texts).repartition("_key").sortWithinPartitions("_key", "_at", "_mark", F.col("_n").isNull())
    done = save(dealt.mapInArrow(_stream_texts, "_key string, _mark binary, _from long, _to long, _cluster int, _final string"), "templates")
    final = done.where("_final IS NOT NULL").select("_key", "_cluster", F.col("_final").alias("e_template_spell"), short_id(F.col("_final")).alias("e_event_spell_id"))
    spans = done.where("_final IS NULL").drop("_final").join(final, ["_key", "_cluster"]).select("_key", "_mark", "_from", "_to", "e_template_spell", "e_event_spell_id")
    out = lines.join(spans, ["_key", "_mark"]).where("_at >= _from AND (_to IS NULL OR _at < _to)")
    return _with_nulls(df, out.drop("_text", "_at", "_key", "_mark", "_from", "_to"), column)


def _stream_texts(batches):
    """Of texts and, by mark, their lines in order: from which line on to before which one a text is in a cluster; at the end of a key, each cluster's template."""
    names = ["_key", "_mark", "_from", "_to", "_cluster", "_final"]
    types = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    key = machine = None
    known: dict[bytes, list] = {}  # words, lines to come, what again() gave, first line in that cluster
    out: list[tuple] = []

    def given():
        batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types, strict=True)], names)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in ("_key", "_at", "_mark", "_text", "_n")]
        for this, at, mark, text, n in zip(*columns, strict=True):
            if n is not None:
                if machine is None or this != key:
                    if machine is not None:
                        out.extend((key, None, None, None, k, machine.template(k)) for k in range(len(machine.found)))
                    key, machine = this, IndexedSpell()
                known[mark] = [text.split(" "), n, None, at]
                continue
            own = known[mark]
            was = own[2]
            now = was if was is not None and was[2] == machine.changes else machine.again(own[0], was)
            if was is not None and was[0] != now[0]:
                out.append((key, mark, own[3], at, was[0], None))
                own[3] = at
            own[1] -= 1
            own[2] = now
            if not own[1]:
                out.append((key, mark, own[3], None, now[0], None))
                del known[mark]
        if len(out) >= 10_000:
            yield given()
    if machine is not None:
        out.extend((key, None, None, None, k, machine.template(k)) for k in range(len(machine.found)))
    if out:
        yield given()


def _final(df: DataFrame, column: str, tokens: Column, key: Column, make, name: str) -> DataFrame:
    lines, clusters = _parse(df, tokens, key, make)
    named = clusters.select("_key", "_cluster", F.col("_final").alias(f"e_template_{name}"), short_id(F.col("_final")).alias(f"e_event_{name}_id"))
    out = lines.join(named, ["_key", "_cluster"]).drop("_key", "_cluster", "_line")
    return _with_nulls(df, out, column)


parse_drain.id_column, parse_drain.more_columns = "e_event_drain_id", ("e_event_drain_template",)
parse_lenma.id_column, parse_lenma.more_columns = "e_event_lenma_id", ("e_template_lenma",)
parse_spell.id_column, parse_spell.more_columns = "e_event_spell_id", ("e_template_spell",)
