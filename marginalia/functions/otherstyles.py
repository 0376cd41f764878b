"""Author-year citations and references of the Vancouver and Chicago styles, and which parser a style has."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import authoryear as A
from marginalia.functions.text import settled
from marginalia.operators import matching

# Years as numbers alone, words before a citation, shapes of references and of citations that tell a style.
PLAIN_YEAR = r"\b((?:19|20)\d{2})[a-z]?\b"
LEAD_WORD = r"(?i)^(?:see|cf\.?|e\.g\.?,?|i\.e\.?,?)\s+"
PAGE_MENTION = r"(?i)\bp\.?\s*\d+"
VANCOUVER_REFERENCE = r"^([A-Z][^.]+?)\.\s*([^.]+?)\.\s*.*?(\d{4})"
CHICAGO_REFERENCE = r"^([A-Z][^.]+?)\.\s*(\d{4})\.\s*"
APA_SHAPE = r"\([A-Z][a-z]+,\s*\d{4}\)"
VANCOUVER_SHAPE = r"\([A-Z][a-z]+\s+\d{4}\)"
MOST_AUTHOR_WORDS = 6


def _bare(content: Column) -> Column:
    """What a citation says without brackets and leading words."""
    return F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(content, r"\[[^\]]+\]", "")), LEAD_WORD, ""))


def _cites(content: Column) -> Column:
    """Whether it may be a citation: no page, no month."""
    return ~content.rlike(PAGE_MENTION) & ~content.rlike(f"(?i)(?:{A.MONTHS})")


def vancouver_in_text(paras: DataFrame) -> DataFrame:
    """doc_id, para_no, author, year, type, warnings, raw: a row for each year in parentheses with an author of up to six words."""
    inside = F.transform(F.regexp_extract_all("text", F.lit(A.PARENS), F.lit(1)), lambda x: _bare(x))
    rows = paras.select("doc_id", "para_no", F.explode(inside).alias("content")).where(_cites(F.col("content")))
    years = F.regexp_extract_all("content", F.lit(PLAIN_YEAR), F.lit(1))
    author = F.btrim(F.regexp_replace("content", PLAIN_YEAR, ""))
    author = F.btrim(F.regexp_replace(F.regexp_replace(author, r"^\d+\s*", ""), r"[.,;:]+$", ""))
    found = rows.select("doc_id", "para_no", author.alias("author"), F.explode(years).alias("year"), F.concat(F.lit("("), "content", F.lit(")")).alias("raw"))
    words = F.size(F.filter(F.split("author", r"\s+"), lambda w: w != ""))
    found = found.where((F.length("author") >= 2) & (words <= MOST_AUTHOR_WORDS))
    none = F.array().cast("array<string>")
    return found.select("doc_id", "para_no", "author", "year", F.lit("parenthetical").alias("type"), none.alias("warnings"), "raw")


def _reference(line: Column, pattern: str, year_group: int, author: Callable[[Column], Column]) -> Column:
    """struct(author, year, full_author, abbreviations) of a reference line, null if it has not the shape."""
    full = F.btrim(F.regexp_extract(line, pattern, 1))
    none = F.array().cast("array<string>")
    found = F.struct(author(full).alias("author"), F.regexp_extract(line, pattern, year_group).alias("year"), full.alias("full_author"), none.alias("abbreviations"))
    return F.when(line.rlike(pattern), found)


def vancouver_reference(line: Column) -> Column:
    """Authors as `First et al` from three on, `First and Second` of two."""

    def author(full: Column) -> Column:
        parts = F.transform(F.split(full, ","), lambda p: F.btrim(p))
        return F.when(F.size(parts) >= 3, F.concat(parts[0], F.lit(" et al"))).when(F.size(parts) == 2, F.concat_ws(" and ", parts)).otherwise(full)

    return _reference(line, VANCOUVER_REFERENCE, 3, author)


def chicago_reference(line: Column) -> Column:
    """Authors as the first, with et al. where commas part three or more."""

    def author(full: Column) -> Column:
        parts = F.split(full, ",")
        return F.concat(F.btrim(parts[0]), F.when(F.size(parts) >= 3, " et al.").otherwise(""))

    return _reference(line, CHICAGO_REFERENCE, 2, author)


def apa_reference(line: Column) -> Column:
    parsed = A.parsed_reference(line)
    names = ("author", "year", "full_author", "abbreviations")
    return F.when(line.rlike(A.REFERENCE), F.struct(*[parsed[n].alias(n) for n in names]))


#: For each style: what reads its citations from paragraphs and its references from lines.
PARSERS: dict[str, tuple[Callable[[DataFrame], DataFrame], Callable[[Column], Column]]] = {
    "apa": (A.in_text, apa_reference),
    "vancouver": (vancouver_in_text, vancouver_reference),
    "chicago": (vancouver_in_text, chicago_reference),
}


def parser(style: str) -> tuple[Callable[[DataFrame], DataFrame], Callable[[Column], Column]]:
    """The parser of a style by name; ValueError for others, where callers take APA."""
    key = style.strip().lower()
    if key not in PARSERS:
        raise ValueError(f"no parser for the style {style!r}; there are {', '.join(PARSERS)}")
    return PARSERS[key]


def detected_style(apa: Column, vancouver: Column) -> Column:
    """The style by how many citations have each shape; Vancouver wins ties if it occurs, else APA."""
    return F.when(apa > vancouver, "apa").when(vancouver > 0, "vancouver").otherwise("apa")


def document_styles(paras: DataFrame, first: int = 50) -> DataFrame:
    """(doc_id, style) by the first paragraphs of each document."""
    n = lambda shape: F.sum(F.regexp_count("text", F.lit(shape)))
    return paras.where(F.col("para_no") <= first).groupBy("doc_id").agg(detected_style(n(APA_SHAPE), n(VANCOUVER_SHAPE)).alias("style"))


def by_style(paras: DataFrame, styles: DataFrame) -> DataFrame:
    """in-text citations, each document's read by the parser of its style (doc_id, style); a style without one goes as APA."""
    known = F.when(F.lower(F.trim("style")).isin(*PARSERS), F.lower(F.trim("style"))).otherwise("apa")
    marked = paras.join(styles.select("doc_id", known.alias("style")), "doc_id")
    out = None
    for read in dict.fromkeys(r for r, _ in PARSERS.values()):
        own = read(marked.where(F.col("style").isin(*[s for s, (r, _) in PARSERS.items() if r is read])))
        out = own if out is None else out.unionByName(own)
    return out


def single_citation(text: Column) -> Column:
    """array<struct<author, year>> of one citation's text; empty if it is none."""
    content = _bare(F.btrim(text))
    author = F.btrim(F.regexp_replace(content, r",?\s*(?:19|20)\d{2}[a-z]?,?\s*", ""))
    author = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(author, r",\s*$", "")), r"^\d+,?\s*", ""))
    years = F.regexp_extract_all(content, F.lit(PLAIN_YEAR), F.lit(1))
    found = F.transform(years, lambda y: F.struct(author.alias("author"), y.alias("year")))
    return F.when(_cites(content) & (F.length(author) >= 2), found).otherwise(F.array().cast("array<struct<author:string,year:string>>"))


def loose_match(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, cite_id, ref_pos): the first reference of the citation's document and year that has its first surname,
    holds its author's name, or has all of its words; null if none has.

    Equal citations are looked up once, equal references once with their first place. Surnames meet by equality; a name within a reference is
    found by its rarest run of characters, a set of words by its rarest word, each within document and year, so that no list of a frequent one is compared.
    """
    words = lambda c: F.array_distinct(F.array_except(F.regexp_extract_all(c, F.lit(r"\b[a-z]{2,}\b"), F.lit(0)), F.array(*map(F.lit, ("et", "al", "and", "the")))))
    at, place = ["doc_id", "year"], F.min("ref_pos").alias("ref_pos")
    x = cites.select("doc_id", "cite_id", "year", F.btrim("author").alias("author"))
    asked = x.select(*at, "author").distinct()
    names = refs.groupBy(*at, "full_author").agg(place)
    y = settled(names, [*at, "ref_pos"], whole=F.lower("full_author"), surname=A.first_surname(F.col("full_author")))

    same = asked.withColumn("surname", A.first_surname(F.col("author"))).where("surname <> ''").join(y.groupBy(*at, "surname").agg(place), [*at, "surname"])
    fulls = y.where("whole IS NOT NULL").groupBy(*at, "whole").agg(place)
    named = asked.withColumn("part", F.lower("author"))
    held = matching.containing(named, fulls, ("doc_id", "year")).join(fulls, [*at, "whole"]).groupBy(*at, "part").agg(place)
    empty = named.where("part = ''").join(fulls.groupBy(*at).agg(place), at)  # is in every name

    has = fulls.select(*at, "ref_pos", words(F.col("whole")).alias("has"))
    posted = has.select(*at, "ref_pos", "has", F.explode("has").alias("word"))
    rare = posted.groupBy(*at, "word").agg(F.count("*").alias("n"))
    sets = named.select(*at, F.array_sort(words(F.col("part"))).alias("wants")).where(F.size("wants") > 0).distinct()
    rarest = sets.withColumn("word", F.explode("wants")).join(rare, [*at, "word"], "left").groupBy(*at, "wants").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0")
    all_in = rarest.select(*at, "wants", F.col("r.word").alias("word")).join(posted, [*at, "word"]).where(F.size(F.array_except("wants", "has")) == 0).groupBy(*at, "wants").agg(place)
    subset = named.withColumn("wants", F.array_sort(words(F.col("part")))).join(all_in, [*at, "wants"])

    found = [r.select(*at, "author", "ref_pos") for r in (same, named.join(held, [*at, "part"]), empty, subset)]
    best = found[0].union(found[1]).union(found[2]).union(found[3]).groupBy(*at, "author").agg(place)
    hit = x.join(best, [*at, "author"]).groupBy("doc_id", "cite_id").agg(place)
    return x.select("doc_id", "cite_id").join(hit, ["doc_id", "cite_id"], "left")


def is_url(text: Column) -> Column:
    """Whether a text has a scheme and a place: `scheme://place`."""
    return F.coalesce(text.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def text_in_runs(runs: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The runs of a paragraph that hold a piece of `wanted` (keys, find): found in the joined text as it is, else in any case.

    `runs` has the keys, run_no and text. Runs are laid end to end by a window; a wanted text meets only its paragraph's runs.
    """
    order = W.partitionBy(*keys).orderBy("run_no")
    end = F.sum(F.length("text")).over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = runs.select(*keys, "run_no", (end - F.length("text")).alias("start"), end.alias("end"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda r: r["text"]), "")
    whole = runs.groupBy(*keys).agg(line.alias("line"))
    exact = F.instr("line", F.col("find"))
    at = F.when(exact > 0, exact).otherwise(F.instr(F.lower("line"), F.lower("find")))
    spot = wanted.where("find <> ''").join(whole, keys).select(*keys, "find", (at - 1).alias("from"), (at - 1 + F.length("find")).alias("to")).where("from >= 0")
    return placed.join(spot, keys).where("start < to AND end > from").select(*keys, "find", "run_no")
