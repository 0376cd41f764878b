"""Loops of the manuscript workflow as windows, joins and aggregations over any DataFrame."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from marginalia.functions.text import spread
from marginalia.operators import matching

# The colour that stands over others, endings of files that go into an archive and their size, scores of acceptance.
FIRST_COLOUR = "yellow"
KEPT_ENDINGS = (".docx", ".txt", ".xlsx", ".html", ".pdf", ".zip")
MOST_BYTES = 50 * 1024 * 1024
LEAST_WITH_DOI, LEAST_WITHOUT, TITLE_FLOOR, TITLE_SURE, SCORE_SURE = 0.6, 0.75, 0.4, 0.8, 0.9


def standing_colours(marks: DataFrame, keys: list[str], made: str, colour: str) -> DataFrame:
    """(keys, colour): of all marks on a place yellow if there is one, else the one made last."""
    order = F.struct((F.col(colour) == FIRST_COLOUR).alias("first"), F.col(made).alias("made"))
    return marks.groupBy(*keys).agg(F.max_by(colour, order).alias(colour))


def carried(value: str, keys: list[str], place: str) -> Column:
    """The last value seen so far, null before the first."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, 0))


def first_of(rows: DataFrame, keys: list[str], made: str) -> DataFrame:
    """One row for each key, the one made first."""
    names = rows.columns
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*names), made).alias("row")).select("row.*")


def abbreviation_advice(keys: list[str], made: str) -> Column:
    """`define` at the first occurrence, `use` after it."""
    first = F.row_number().over(W.partitionBy(*keys).orderBy(made)) == 1
    return F.when(first, "define").otherwise("use")


def open_ranges(marks: DataFrame, keys: list[str], name: str, place: str, step: str) -> DataFrame:
    """`marks` with `open`: how many named ranges, of those its document has, are open at each run (1 opens, -1 closes).

    A run's depth in every range is carried in a map of the ranges' steps; ranges of a document are few.
    """
    order = W.partitionBy(*keys).orderBy(place)
    own = W.partitionBy(*keys, name).orderBy(place)
    depth = marks.withColumn("_depth", F.sum(step).over(own.rowsBetween(W.unboundedPreceding, 0)))
    # A range counts from the run where it comes above zero to that where it falls back.
    was = F.coalesce(F.lag("_depth").over(own), F.lit(0))
    turned = (F.col("_depth") > 0).cast("int") - (was > 0).cast("int")
    turns = depth.withColumn("_turn", turned)
    return turns.withColumn("open", F.sum("_turn").over(order.rowsBetween(W.unboundedPreceding, 0)).cast("long")).drop("_depth", "_turn")


def closing_levels(keys: list[str], place: str, level: str) -> Column:
    """Sections that a heading closes: those open at its level or deeper."""
    before = F.lag(level).over(W.partitionBy(*keys).orderBy(place))
    return F.greatest(F.coalesce(before - F.col(level) + 1, F.lit(0)), F.lit(0)).cast("long")


def numbered(keys: list[str], place: str) -> Column:
    """Numbers from 1 within the keys."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(place)).cast("long")


def merged_citations(rows: DataFrame, cite: str, place: str, warnings: str) -> DataFrame:
    """(cite, warnings, places): every warning of a citation once, every place once, in order."""
    said = F.sort_array(F.array_distinct(F.flatten(F.collect_set(warnings))))
    return rows.groupBy(cite).agg(said.alias("warnings"), F.sort_array(F.collect_set(place)).alias("places"))


def total_size(*lists: Column) -> Column:
    """Items in all lists; a null one has none."""
    return sum((F.greatest(F.size(x), F.lit(0)) for x in lists), F.lit(0)).cast("long")


def accepted(score: Column, has_doi: Column, title_likeness: Column, author_fits: Column) -> Column:
    """Whether a candidate is taken: a score by whether it has a DOI, no unlike title, and with a foreign author only if both are sure."""
    enough = score >= F.when(has_doi, LEAST_WITH_DOI).otherwise(LEAST_WITHOUT)
    sure = author_fits | ((title_likeness >= TITLE_SURE) & (score >= SCORE_SURE))
    return enough & (title_likeness >= TITLE_FLOOR) & sure


def zip_members(files: DataFrame, name: str, size: str) -> DataFrame:
    """Files that go into an archive: of a known ending, under 50 MB."""
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return files.where(ending.isin(*KEPT_ENDINGS) & (F.col(size) < MOST_BYTES))


def cached(asked: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """`asked` with the cache's value of its key, trimmed and in lower case; the least of several, null if there is none."""
    bare = F.lower(F.btrim(key))
    known = cache.groupBy(bare.alias("_key")).agg(F.min(value).alias(value))
    return asked.join(known, F.lower(F.btrim(asked[key])) == F.col("_key"), "left").drop("_key")


def resolved_labels(cites: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """`cites` with the id of their label in the document, or else of the label without its last letter; labels in any case.

    Two equi-joins; of several ids of a label the least.
    """
    known = labels.groupBy(key, F.lower("label").alias("_label")).agg(F.min("id").alias("id"))
    low = F.lower("label")
    short = F.when(low.rlike("[a-z]$"), F.substring(low, F.lit(1), F.length(low) - 1))
    own = known.select(key, "_label", F.col("id").alias("_own"))
    part = known.select(key, F.col("_label").alias("_short"), F.col("id").alias("_part"))
    met = cites.withColumn("_label", low).withColumn("_short", short).join(own, [key, "_label"], "left").join(part, [key, "_short"], "left")
    return met.withColumn("id", F.coalesce("_own", "_part")).drop("_label", "_short", "_own", "_part")


def single_links(cites: DataFrame, references: DataFrame) -> DataFrame:
    """(cite, ref_id): citations (names, year) that exactly one reference line holds, names in order and then the year.

    Equal citations are looked up once, equal lines once. Citations meet those lines of their year that have the rarest run of characters of
    their names, and are compared with these by pattern; a name shorter than three characters counts as a run.
    """
    each = F.filter(F.split("names", r"[\s,.()]+"), lambda w: ~w.isin("", "and", "et", "al"))
    quoted = F.transform(each, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    pattern = F.concat(F.lit("(?is)"), F.array_join(quoted, ".*?"), F.lit(r".*?\b"), F.col("year"), F.lit(r"\b"))
    small = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase)  # noqa: E731  # the case that a pattern leaves out
    years = F.array_distinct(F.regexp_extract_all("line", F.lit(r"\b([0-9]{4})\b"), F.lit(1)))
    lines = references.groupBy("line").agg(F.count("*").alias("n"), F.min("ref_id").alias("ref_id"))
    lines = spread(lines, ["line", "n", "ref_id"], years, "year").withColumn("whole", small(F.col("line")))
    asked = cites.where(F.size(quoted) > 0).select("names", "year").distinct()
    met = matching.met_by_runs(asked.withColumn("needs", F.transform(each, small)), lines.select("year", "whole").distinct(), ("year",))
    hits = met.join(lines, ["year", "whole"]).where(F.rlike("line", pattern)).groupBy("names", "year").agg(F.sum("n").alias("n"), F.min("ref_id").alias("ref_id"))
    links = cites.select("cite", "names", "year").join(hits, ["names", "year"]).groupBy("cite").agg(F.sum("n").alias("n"), F.min("ref_id").alias("ref_id"))
    return links.where("n = 1").select("cite", "ref_id")


def first_holding(heads: list[str | None], texts: list[str | None], pages: list[int | None]) -> list[int | None]:
    """The least page whose text holds each head.

    A text that holds a head has the head's inner words between blanks, so texts are looked up by the rarest of these; of a head without inner
    words the longest one is looked up within the distinct words of all texts. What is found is compared in the order of pages.
    """
    order = sorted((page, text) for page, text in zip(pages, texts, strict=True) if page is not None and text is not None)
    having: dict[str, list[int]] = {}
    for at, (_, text) in enumerate(order):
        for word in set(text.split(" ")):
            having.setdefault(word, []).append(at)
    starts, line = list(accumulate((len(w) + 1 for w in having), initial=0)), " ".join(having)
    words = list(having)

    def within(part: str) -> list[int]:
        found, at = set(), line.find(part)
        while at >= 0:
            k = bisect_right(starts, at) - 1
            found.update(having[words[k]])
            at = line.find(part, starts[k + 1])
        return sorted(found)

    def first(head: str) -> int | None:
        every = head.split(" ")
        inner = [w for w in every[1:-1] if w]
        longest = max(every, key=len)
        some = min((having.get(w, []) for w in inner), key=len) if inner else within(longest) if longest else range(len(order))
        return next((order[at][0] for at in some if head in order[at][1]), None)

    known = {head: first(head) for head in set(heads) if head is not None}
    return [known.get(head) for head in heads]


@F.pandas_udf(ArrayType(LongType()))
def _first_holding(heads: pd.Series, texts: pd.Series, pages: pd.Series) -> pd.Series:
    whole = lambda xs: [None if x is None or x != x else int(x) for x in xs]
    return pd.Series([first_holding(list(h), list(t), whole(p)) for h, t, p in zip(heads, texts, pages, strict=True)], dtype=object)


def first_pages(heads: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, para_no, sent_no, page): the first page of the document whose text (page_text) holds a head.

    Heads and texts of a document come together once, and its heads are looked up there: a task holds a document's text, not a text for each word.
    """
    field = lambda rows, name: F.transform(rows, lambda x: x[name])
    asked = heads.groupBy("doc_id").agg(F.collect_list(F.struct("para_no", "sent_no", "head")).alias("_heads"))
    said = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page", "page_text")).alias("_pages"))
    found = asked.join(said.hint("merge"), "doc_id").withColumn("_page", _first_holding(field("_heads", "head"), field("_pages", "page_text"), field("_pages", "page")))
    each = found.select("doc_id", F.inline(F.arrays_zip(field("_heads", "para_no").alias("para_no"), field("_heads", "sent_no").alias("sent_no"), F.col("_page").alias("page"))))
    return each.where("page IS NOT NULL").groupBy("doc_id", "para_no", "sent_no").agg(F.min("page").alias("page"))
