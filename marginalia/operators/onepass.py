"""Many terms and patterns found in one pass over a text, with their places.

A text is searched once for triggers: a trie of all terms, digits and signs, built from the table of patterns and compiled as one
expression. Patterns then run over the stretches around triggers only. Terms of a lexicon are looked up by the words themselves, so no
pattern is made for a term.
"""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import bound, spread, starts_of

MARK = "\uffff"  # no character of any language
BACK, ON = 4, 6  # spaces up to which a match goes back from a trigger, and on from it


def trie(terms: list[str]) -> str:
    """An expression for any of the terms, longest first, in which terms with the same beginning share it."""
    tree: dict = {}
    for term in terms:
        node = tree
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}

    def shown(node: dict) -> str:
        ways = [re.escape(c) + shown(rest) for c, rest in sorted(node.items()) if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})" + ("?" if "" in node else "")

    return shown(tree)


@dataclass(frozen=True)
class Triggers:
    """What tells that a match may be near. words: whole words or phrases; inside: texts anywhere, both in any case; shapes that begin
    with no letter; forms, as they are. gated: patterns spell their triggers; if not, each is tried on every stretch."""

    words: tuple[str, ...] = ()
    inside: tuple[str, ...] = ()
    shapes: tuple[str, ...] = ()
    forms: tuple[str, ...] = ()
    gated: bool = True

    def pattern(self) -> str:
        """One expression for all; each way looks at the next character first, by which most places of a text are left at once."""
        first = lambda terms: "".join(re.escape(c) for c in sorted({c for t in terms for c in (t[0].lower(), t[0].upper())}))
        ways = [rf"(?![A-Za-z ,.\n])(?:{'|'.join(self.shapes)})"] if self.shapes else []
        if self.words:
            ways.append(rf"(?=[{first(self.words)}])\b(?i:{trie([w.lower() for w in self.words])})(?:\b|(?<=\.))")
        if self.inside:
            ways.append(rf"(?=[{first(self.inside)}])(?i:{trie([w.lower() for w in self.inside])})")
        return f"(?:{'|'.join([*ways, *self.forms])})"

    def kinds(self, pattern: str) -> list[str]:
        """The triggers, in lower case and 0 for digits, one of which a match of `pattern` has near: those that it spells or that it
        matches. Signs stand for themselves."""
        if not self.gated:
            return []
        plain = pattern.replace("\\", "").lower()
        words = {w.lower() for w in (*self.words, *self.inside)}
        spelt = {w for w in words if w in plain or re.search(pattern, w, re.IGNORECASE)}
        signs = {c.lower() for c in pattern if re.fullmatch("|".join(self.shapes) or "(?!)", c)} - set("0123456789")
        return sorted(spelt | signs | ({"0"} if r"\d" in pattern or "[0-9]" in pattern else set()))


def kind_of(hit: Column) -> Column:
    """A trigger as Triggers.kinds names it."""
    return F.when(hit.rlike(r"(?U)^\d"), "0").otherwise(F.lower(hit))


def cut_at(text: Column, triggers: str) -> Column:
    """array<string>: what lies before the first trigger, the trigger, what lies up to the next one, and so on."""
    # Marks are set in one search and cut at in a cheap one. A text that has the mark itself is searched twice instead.
    marked = F.split(F.regexp_replace(text, triggers, f"{MARK}$0{MARK}"), MARK, -1)
    gaps, hits = F.split(text, triggers, -1), F.regexp_extract_all(text, F.lit(triggers), F.lit(0))
    twice = F.flatten(F.transform(gaps, lambda g, k: F.array_compact(F.array(g, F.get(hits, k)))))
    return F.when(text.contains(MARK), twice).otherwise(marked)


def stretches(text: Column, triggers: str) -> Column:
    """array<struct<start, text, kinds>>: the parts of a text around its triggers, with the kinds of those, BACK words before and ON words after;
    neighbours that would meet are one. Parts begin and end next to a space or an end of the text, so that edges of words stay what they are."""
    none = F.array().cast("array<struct<start:bigint,text:string,kinds:array<string>>>")

    def found(parts: Column) -> Column:
        wide = lambda k: F.length(F.get(parts, 2 * k)) - F.length(F.replace(F.get(parts, 2 * k), F.lit(" "), F.lit(""))) > BACK + ON
        last = (F.size(parts) - 3) / 2
        nth = F.sequence(F.lit(0), last.cast("int"))
        opens, closes = F.filter(nth, lambda k: (k == 0) | wide(k)), F.filter(nth, lambda k: (k == last) | wide(k + 1))
        state = F.struct(F.arrays_zip(opens.alias("a"), closes.alias("z")).alias("ranges"), starts_of(F.transform(parts, F.length)).alias("at"))
        return bound(state, lambda s: F.transform(s["ranges"], lambda r: part(parts, s["at"], r["a"], r["z"])))

    def part(parts: Column, at: Column, a: Column, z: Column) -> Column:
        lead = F.substring_index(F.get(parts, 2 * a), " ", -BACK - 1)
        body = F.array_join(F.slice(parts, 2 * a + 2, 2 * (z - a) + 1), "")
        whole = F.concat(lead, body, F.substring_index(F.get(parts, 2 * z + 2), " ", ON + 1))
        kinds = F.array_distinct(F.transform(F.sequence(a, z), lambda k: kind_of(F.get(parts, 2 * k + 1))))
        return F.struct((F.get(at, 2 * a + 1) - F.length(lead)).alias("start"), whole.alias("text"), kinds.alias("kinds"))

    return bound(cut_at(text, triggers), lambda p: F.when(F.size(p) > 1, found(p)).otherwise(none))


def spans_of(parts: Column) -> Column:
    """array<struct<start, end>>: the places of the hits in what cut_at() gives."""
    odd = lambda at: F.filter(F.transform(at, lambda x, i: F.when(i % 2 == 1, F.struct(x.alias("start"), F.get(at, i + 1).alias("end")))), lambda x: x.isNotNull())
    return bound(starts_of(F.transform(parts, lambda x: F.length(x))), odd)


def pattern_places(rows: DataFrame, keys: list[str], text: str, patterns: list[tuple[str, str]], triggers: Triggers) -> DataFrame:
    """(keys, pattern_group, start, end): the places of all matches of each pattern, in any case, in code points from 0.

    A null or empty text has none. Every match must hold a trigger, or one must lie within BACK spaces after its beginning. A pattern
    is tried only on stretches with a trigger of its own.
    """
    loud = spread(rows, keys, stretches(F.col(text), triggers.pattern()), "s").select(*keys, F.col("s.start").alias("from"), "s.text", "s.kinds")

    def tried(group: str, pattern: str) -> Column:
        own, kinds = F.lit(True), triggers.kinds(pattern)
        if kinds:
            own = F.arrays_overlap("kinds", F.split(F.lit("\n".join(kinds)), "\n"))
        return F.when(own, F.struct(F.lit(group).alias("pattern_group"), cut_at(F.col("text"), f"(?iU:{pattern})").alias("parts")))

    # Patterns give rows of one shape, so that what is made of them is planned once and not for each pattern.
    each = spread(loud, [*keys, "from"], F.array(*[tried(*p) for p in patterns]), "m").where(F.size("m.parts") > 1)
    found = spread(each.select(*keys, "from", "m.*"), [*keys, "from", "pattern_group"], spans_of(F.col("parts")), "s")
    return found.select(*keys, "pattern_group", (F.col("from") + F.col("s.start")).alias("start"), (F.col("from") + F.col("s.end")).alias("end"))
