"""References written anew from what is read of them alone: an ordered table of rules, folded over each reference.

A rule looks at what is left of a reference (or at its head, which an earlier rule split off). If its pattern fits, it adds its parts as
segments of a text and a style, keeps parts for the end, and leaves groups of the pattern to the next rules. A rule is passed over once its
step is done, unless what it needs is, or for other kinds. Shapes are rows of the table, so a further one makes no larger plan.

A null reference gives null, an empty one no segments. Names without initials stay whole, what no rule takes after the title of a
web page with a signed source is left out, as are blanks at either end; a year is looked for once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "array<struct<text:string,style:string>>"
PARTS = "array<struct<before:string,group:int,after:string,style:string>>"
RULES = f"array<struct<step:string,pattern:string,needs:string,of:string,head:int,no_year:boolean,kinds:array<string>,sets:array<string>,left:array<int>,parts:{PARTS},tail:{PARTS}>>"
YEAR_GROUP = -1

# Addresses, years, editions, editors, dates, pages, names, and the styles of segments.
LINK = r"https?://\S+"
YEAR = r"\b(?:19|20)\d{2}\b"
ACCESSED = r"(?i)accessed.*$"
EDITION = r"\d+(?:st|nd|rd|th)?\s+ed\.?"
SPLIT = r"(?s)^(.+?)(?:\.\s+(.*))?$"
EDITORS = r"(?is)^In:\s+(.+?)(?:,\s*eds?\.?|\s+\(eds?\.?\))\s*\.?\s*(.*)$"
YEAR_END = r"(?s)^(.*?)[;.]\s*(\d{4})(?::(\d+)[-–](\d+))?\.?$"
JOURNAL_END = r"(?s)^(.+?)[. ]+(\d{4});\s*(\w+)(?:\((\w+)\))?:([^\-–\s]*)(?:[-–](\w*)[\w\-–]*)?\.?$"
DATE = r"(?is)^(.*?)\((\d{4}|n\.d\.|n\. d\.)(?:,\s*(?:([A-Za-z]+)\s*(\d+)?[^)]*|([^)]+)))?\)\.?\s*(.*)$"
CHAPTER = r"(?is)^(.*?)[.\s]*\bIn\s+(.+?)\s+\(Eds?\.?\),\s*(.*)$"
PAGES = r"(?is)^(.*?)\s*\(pp\.?\s*(\d+)[-–](\d+)\)\.?\s*(.*)$"
EDITION_SIGNED = r"(?s)^(.*?)\s*\(([^)]+ed\.)\)\.?\s*(.*)$"
VOLUME_SIGNED = r"(?s)^([^.]*)\.(.*\d\(\d+\).*)$"
SPACED_NAME = r"^(.+)\s+([A-Z]+(?:\.?[A-Z]+)*)$"
LEADING_INITIALS = r"^([A-Z]\.?\s*[A-Z]?\.?)\s+(.+)$"
INITIALS = r"^[A-Z]\.?(?:[\s-]*[A-Z]\.)*\s*[A-Z]?\.?$"
MANUAL = ["book", "edited_book", "thesis", "web"]
OTHER = ["article"]


def part(group: int, style: str, before: str = "", after: str = "") -> tuple:
    """A group of the pattern with signs around it, all left out if it is empty."""
    return before, group, after, style


def sign(text: str) -> tuple:
    return text, 0, "", ""


def rule(step: str, pattern: str, *parts: tuple, kinds=(*MANUAL, *OTHER), sets=(), needs="", of="rest", left=(), head=0, tail=(), no_year=False) -> dict:
    return {"step": step, "pattern": pattern, "parts": parts, "kinds": kinds, "sets": (step, *sets), "needs": needs, "of": of, "left": left, "head": head, "tail": tail, "no_year": no_year}


def titles(step: str, pattern: str, style_by_kind: dict, *parts: tuple, **more) -> list[dict]:
    """One rule for each style that a title has by kind."""
    return [rule(step, pattern, part(1, style), *parts, kinds=[k for k in style_by_kind if style_by_kind[k] == style], **more) for style in dict.fromkeys(style_by_kind.values())]


AMA_TITLES = {"book": "bib_book", "edited_book": "bib_chaptertitle", "thesis": "bib_title", "web": "bib_title"}
APA_TITLES = {"book": "bib_book", "web": "bib_title", "edited_book": "bib_book", "thesis": "bib_book", "article": "bib_book"}
FROM_YEAR = (part(YEAR_GROUP, "bib_year", before="; "), sign("."))

AMA = [
    rule("authors", SPLIT, part(1, "authors", after=". "), left=[2]),
    rule("split", SPLIT, left=[2], head=1),
    *titles("title", rf"(?is)^(.*?)[\s.]*\b({EDITION})$", AMA_TITLES, sign(". "), part(2, "bib_editionno", after=". "), of="head", sets=["edition"]),
    *titles("title", r"(?s)^(.*)$", AMA_TITLES, sign(". "), of="head"),
    rule("title", r"(?s)^(.*?)\.*$", part(1, "bib_article"), sign(". "), of="head", kinds=OTHER),
    rule("end", r"^$", sets=["place", "edition"]),
    rule("edition", rf"(?is)^({EDITION})\s+(.+)$", part(1, "bib_editionno", after=". "), kinds=MANUAL, left=[2]),
    rule("editors", EDITORS, part(1, "editors", before="In: ", after=", eds. "), kinds=MANUAL, left=[2]),
    rule("end", YEAR_END, kinds=MANUAL, left=[1], tail=[sign("; "), part(2, "bib_year"), part(3, "bib_fpage", before=":"), part(4, "bib_lpage", before="-"), sign(".")]),
    rule("end", r"(?s)^(.*?)[;.\s]*$", kinds=MANUAL, left=[1], tail=FROM_YEAR, no_year=True),
    rule("book", r"(?s)^(.+?)\. (.+)$", part(1, "bib_book", after=". "), kinds=["edited_book"], left=[2]),
    rule("place", r"(?s)^(.+?):\s*(.+)$", part(1, "bib_location", after=": "), part(2, "bib_publisher"), kinds=MANUAL),
    rule("place", r"(?s)^(.+)$", part(1, "bib_publisher"), kinds=["book", "edited_book", "thesis"]),
    rule("end", JOURNAL_END, part(1, "bib_journal", after=". "), part(2, "bib_year", after=";"), part(3, "bib_volume"), part(4, "bib_issue", "(", ")"), sign(":"), part(5, "bib_fpage"), part(6, "bib_lpage", before="-"), sign("."), kinds=OTHER),
    rule("end", r"(?s)^(.*)$", kinds=OTHER, left=[1], sets=["loose"], tail=FROM_YEAR, no_year=True),
    rule("journal", r"(?s)^(.*?)[;.\s]*$", part(1, "bib_journal"), kinds=OTHER, needs="loose"),
]

APA = [
    rule("authors", r"(?s)^([^(]{6,}?)\s*(\(.*)$", part(1, "authors", after=". "), left=[2]),
    rule("authors", SPLIT, part(1, "authors", after=". "), left=[2]),
    rule("date", DATE, sign("("), part(2, "bib_year"), part(3, "bib_month", before=", "), part(4, "bib_day", before=" "), part(5, "bib_month", before=", "), sign("). "), left=[1, 6]),
    rule("date", r"(?s)^(.*)$", part(YEAR_GROUP, "bib_year", "(", "). "), left=[1]),
    rule("chapter", CHAPTER, part(1, "bib_chaptertitle", after=". "), part(2, "editors", before="In ", after=" (Eds.), "), kinds=MANUAL, sets=["title"], left=[3]),
    rule("book", PAGES, part(1, "bib_book"), part(2, "bib_fpage", before=" (pp. "), part(3, "bib_lpage", before="-"), sign("). "), kinds=MANUAL, needs="chapter", left=[4]),
    rule("book", r"(?s)^([^.]*)(?:\.\s*(.*))?$", part(1, "bib_book", after=". "), kinds=MANUAL, needs="chapter", left=[2]),
    *titles("title", EDITION_SIGNED, {k: v for k, v in APA_TITLES.items() if k in MANUAL}, part(2, "bib_editionno", " (", ")"), sign(". "), left=[3]),
    *titles("title", VOLUME_SIGNED, {"edited_book": "bib_article", "thesis": "bib_article"}, sign(". "), left=[2], sets=["in journal"]),
    *titles("title", r"(?s)^([^.]*)(?:\.(.*))?$", APA_TITLES, sign(". "), left=[2]),
    rule("source", r"(?s)^\s*(.+?)[.\s]*$", part(1, "bib_journal", after="."), needs="in journal"),
    rule("source", r"(?s)^\s*(.+?)[.\s]*$", part(1, "bib_publisher", after=".")),
]


def table(rules: list[dict]) -> Column:
    """The rules as one constant."""
    parts = lambda ps: [dict(zip(("before", "group", "after", "style"), p, strict=True)) for p in ps]
    return F.from_json(F.lit(json.dumps([r | {"parts": parts(r["parts"]), "tail": parts(r["tail"])} for r in rules])), RULES)


def _bound(value: Column, use) -> Column:
    """`use` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _segment(text: Column, style: Column) -> Column:
    return F.struct(text.alias("text"), F.nullif(style, F.lit("")).alias("style"))


def _made(parts: Column, text: Column, pattern: Column, year: Column) -> Column:
    """The segments of a rule's parts."""
    found = lambda p: F.when(p["group"] == YEAR_GROUP, year).otherwise(F.btrim(F.call_function("regexp_extract", text, pattern, F.greatest(p["group"], F.lit(0)))))
    plain = lambda t: _segment(t, F.lit(""))
    whole = lambda p: _bound(found(p), lambda t: F.when(t == "", F.array().cast(SEGMENT)).otherwise(F.array(plain(p["before"]), _segment(t, p["style"]), plain(p["after"]))))
    return F.flatten(F.transform(parts, lambda p: F.when(p["group"] == 0, F.array(plain(p["before"]))).otherwise(whole(p))))


def _step(state: Column, r: Column, kind: Column, year: Column) -> Column:
    text = F.when(r["of"] == "head", state["head"]).otherwise(state["rest"])
    fits = F.array_contains(r["kinds"], kind) & ~F.array_contains(state["done"], r["step"]) & ((r["needs"] == "") | F.array_contains(state["done"], r["needs"]))
    group = lambda n: F.call_function("regexp_extract", text, r["pattern"], n)
    left = F.btrim(F.array_join(F.transform(r["left"], group), ""))
    rest = F.when(r["of"] == "head", state["rest"]).when(r["no_year"] & (year != ""), F.rtrim(F.btrim(F.replace(left, year, F.lit(""))), F.lit(";. "))).otherwise(left)
    segments = F.concat(state["segments"], _made(r["parts"], text, r["pattern"], year))
    after = F.struct(
        rest.alias("rest"), F.when(r["head"] > 0, group(r["head"])).otherwise(state["head"]).alias("head"), F.concat(state["done"], r["sets"]).alias("done"),
        segments.alias("segments"), F.concat(state["tail"], _made(r["tail"], text, r["pattern"], year)).alias("tail"),
    )
    return F.when(fits & F.regexp_like(text, r["pattern"]), after).otherwise(state)


def _listed(names: Column, each, last_sign: Column) -> Column:
    """Segments of names with a comma and a blank between, and a sign before the last of several."""
    comma = F.array(_segment(F.lit(", "), F.lit("")))
    before = lambda i: F.when(i == 0, F.array().cast(SEGMENT)).when(i == F.size(names) - 1, F.concat(comma, F.array(_segment(last_sign, F.lit(""))))).otherwise(comma)
    return F.flatten(F.transform(names, lambda a, i: F.concat(before(i), each(a))))


def _pieces(text: Column, signs: str) -> Column:
    return F.filter(F.transform(F.split(text, signs), lambda p: F.btrim(p)), lambda p: p != "")


def _signed(name: Column, pattern: str, groups: tuple[tuple[int, str], tuple[int, str]], whole: str, bare: bool) -> Column:
    """A name of two groups with a blank between, or whole."""
    clean = lambda c: F.regexp_replace(c, r"[. ]", "") if bare else c
    (g, first), (h, second) = groups
    two = F.array(_segment(F.regexp_extract(name, pattern, g), F.lit(first)), _segment(F.lit(" "), F.lit("")), _segment(clean(F.regexp_extract(name, pattern, h)), F.lit(second)))
    return F.when(name.rlike(pattern), two).otherwise(F.array(_segment(name, F.lit(whole))))


def spaced_names(text: Column, kind: str = "bib_", bare: bool = True) -> Column:
    """`Smith JB, Jones M` as segments; initials without points if `bare`."""
    each = lambda a: _signed(a, SPACED_NAME, ((1, f"{kind}surname"), (2, f"{kind}fname")), f"{kind}surname", bare)
    return _bound(_pieces(text, ","), lambda names: _listed(names, each, F.lit("")))


def comma_names(text: Column) -> Column:
    """`Smith, J. B., & Jones, M.` as segments: a name and the initials after it."""
    is_initials = lambda p: F.coalesce(p.rlike(INITIALS), F.lit(False))
    paired = lambda ps: F.filter(
        F.transform(ps, lambda p, i: F.struct(
            p.alias("name"), F.when(~is_initials(p) & is_initials(F.get(ps, i + 1)), F.get(ps, i + 1)).alias("initials"),
            (is_initials(p) & (i > 0) & ~is_initials(F.get(ps, F.greatest(i - 1, F.lit(0))))).alias("taken"),
        )), lambda a: ~a["taken"])
    surname = lambda a: F.array(_segment(a["name"], F.lit("bib_surname")))
    initials = lambda a: F.array(_segment(F.lit(", "), F.lit("")), _segment(a["initials"], F.lit("bib_fname")))
    each = lambda a: F.when(a["initials"].isNotNull(), F.concat(surname(a), initials(a))).otherwise(surname(a))
    return _bound(_pieces(F.regexp_replace(text, r"\s+&\s+", ","), ","), lambda ps: _bound(paired(ps), lambda names: _listed(names, each, F.lit("& "))))


def leading_names(text: Column) -> Column:
    """`S. Coates, J. Rosenthal, & D. Schechter`, of editors, as segments."""
    each = lambda a: _signed(a, LEADING_INITIALS, ((1, "bib_ed-fname"), (2, "bib_ed-surname")), "bib_ed-surname", False)
    return _bound(_pieces(text, ",|&"), lambda names: _listed(names, each, F.when(text.contains("&"), "& ").otherwise("")))


def _tidied(groups: Column) -> Column:
    """Groups of segments in a row without empty ones, without a point, comma or semicolon after another, whose blank stays, and without blanks after blanks."""
    ends = lambda t, signs: F.right(t, F.lit(1)).isin(*signs)

    def add(out: Column, group: Column) -> Column:
        last = F.coalesce(F.element_at(F.element_at(out, -1), -1)["text"], F.lit(""))
        text = F.element_at(group, 1)["text"]
        again = (F.size(group) == 1) & F.btrim(text).isin(".", ";", ",") & ends(F.rtrim(last), (".", ";", ","))
        twice = (F.size(group) == 1) & (F.btrim(text) == "") & ends(last, (" ",))
        blank = F.array(F.array(_segment(F.lit(" "), F.lit(""))))
        return F.when(again & ends(text, (" ",)) & ~ends(last, (" ",)), F.concat(out, blank)).when(again | twice, out).otherwise(F.concat(out, F.array(group)))

    full = F.filter(F.transform(groups, lambda g: F.filter(g, lambda s: F.coalesce(s["text"], F.lit("")) != "")), lambda g: F.size(g) > 0)
    guarded = lambda out, g: F.when(F.size(out) == 0, F.array(g)).otherwise(add(out, g))
    return F.flatten(F.aggregate(full, F.array().cast(f"array<{SEGMENT}>"), guarded))


def segments(reference: Column, kind: Column, style: str) -> Column:
    """array<struct<text, style>> of a reference that is written in `style`: ama or apa, by its kind: book, edited_book, thesis, web, else article."""
    rules, authors, editors = {"ama": (AMA, spaced_names, lambda t: spaced_names(t, "bib_ed-", False)), "apa": (APA, comma_names, leading_names)}[style]
    kind = F.when(kind.isin(*MANUAL), kind).otherwise("article")
    address = F.regexp_extract(reference, LINK, 0)
    link = F.rtrim(address, F.lit(".,;)"))
    clean = F.when(link != "", F.rtrim(F.btrim(F.replace(reference, address, F.lit(""))), F.lit(".,;( "))).otherwise(F.btrim(reference))
    none = F.array().cast(SEGMENT)
    accessed = F.regexp_extract(reference, ACCESSED, 0)
    linked = F.when(link != "", F.array(_segment(F.lit(" "), F.lit("")), _segment(link, F.lit("bib_url")))).otherwise(none)
    said = F.when((kind == "web") & (accessed != ""), F.array(_segment(F.lit(". "), F.lit("")), _segment(accessed, F.lit("bib_comment")))).otherwise(none)
    last = F.concat(linked, F.lit(none) if style == "apa" else said)
    last = last if style == "apa" else F.when(kind.isin("web", "article"), last).otherwise(none)

    def read(text: Column) -> Column:
        year = F.regexp_extract(text, YEAR, 0)
        start = F.struct(text.alias("rest"), F.lit("").alias("head"), F.array().cast("array<string>").alias("done"), none.alias("segments"), none.alias("tail"))
        end = F.aggregate(table(rules), start, lambda s, r: _step(s, r, kind, year))
        named = lambda s: F.when(s["style"] == "authors", authors(s["text"])).when(s["style"] == "editors", editors(s["text"])).otherwise(F.array(s))
        return _bound(end, lambda s: _tidied(F.transform(F.concat(s["segments"], s["tail"], last), named)))

    return F.when(reference.isNull(), F.lit(None)).when(clean == "", linked).otherwise(_bound(clean, read))
