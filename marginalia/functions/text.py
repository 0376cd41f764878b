"""Paragraphs, sentences, pages, tags and scripts as DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SENTENCE = r"[^.!?]+[.!?]*"
BLOCK = 128  # parts whose places are summed together
WORDS_A_PAGE, PARAGRAPHS_A_PAGE = 160, 40
# Script, first and last code point; Latin-1 letters are added to the scripts that are marked.
SCRIPTS = [
    ("Latin-1", "À", "ÿ"), ("Chinese", "一", "鿿"), ("Greek", "Ͱ", "Ͽ"), ("Cyrillic", "Ѐ", "ӿ"), ("Hebrew", "֐", "׿"), ("Arabic", "؀", "ۿ"), ("Arabic", "ݐ", "ݿ"),
    ("Devanagari", "ऀ", "ॿ"), ("Japanese", "぀", "ゟ"), ("Japanese", "゠", "ヿ"), ("Korean", "가", "힯"), ("Thai", "฀", "๿"), ("Currency", "₠", "⃏"),
]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once, however often `use` speaks of it.

    Projections that Catalyst joins repeat an expression wherever its name stands; the variable of a function over an array of one isn't replaced.
    """
    return F.get(F.transform(F.array(value), use), 0)


def spread(rows: DataFrame, keep: list[str], array: Column, name: str) -> DataFrame:
    """`keep` and a row for each element of an array that is not null.

    Before a plain explode Catalyst asks whether the array has elements, and works the array out once more for that; not so here.
    """
    return rows.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def settled(rows: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """`keep` and `columns`, each worked out once for a row: Catalyst moves no filter on them below this, where it would repeat them."""
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return rows.select(*keep, made.alias("_made")).select(*keep, "_made.*")


def starts_of(lengths: Column) -> Column:
    """The sum of the lengths before each one. Sums go by blocks, so time grows with the number of lengths, not with its square."""
    none = F.array().cast("array<bigint>")
    add = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    sums = lambda xs: F.aggregate(xs, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out")), add)

    def of(n: Column) -> Column:
        firsts = F.when(F.size(n) > 0, F.sequence(F.lit(1), F.size(n), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(firsts, lambda i: sums(F.slice(n, i, F.lit(BLOCK))))
        shifted = lambda b: F.zip_with(b, sums(F.transform(b, lambda x: x["at"]))["out"], lambda x, s: F.transform(x["out"], lambda v: v + s))
        return F.flatten(bound(blocks, shifted))

    return bound(F.transform(lengths, lambda n: n.cast("bigint")), of)


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): the lines of each document from 1 on; blank ones keep their number."""
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("i", "text")).where("text IS NOT NULL").select("doc_id", (F.col("i") + 1).cast("long").alias("para_no"), "text")


def sentences(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, sent_no, start, sentence): with the place of each sentence in its paragraph, from 0."""
    # Places are summed along each paragraph's own sentences, so nothing is shuffled. The marks before the first sentence count as a part.
    parts = F.concat(F.array(F.regexp_extract("text", r"^[.!?]*", 0)), F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)))
    each = bound(parts, lambda p: F.arrays_zip(starts_of(F.transform(p, F.length)).alias("start"), p.alias("sentence")))
    found = paras.select("doc_id", "para_no", F.posexplode_outer(each).alias("i", "s")).where("i > 0")
    return found.select("doc_id", "para_no", (F.col("i") - 1).cast("long").alias("sent_no"), "s.start", "s.sentence")


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n]+"), lambda x: x != "")).cast("long")


def pages_by_words(paras: DataFrame, *keep: str) -> DataFrame:
    """Page of each paragraph from the words before it; columns to `keep` come along."""
    before = F.sum(n_words(F.col("text"))).over(W.partitionBy("doc_id").orderBy("para_no").rowsBetween(W.unboundedPreceding, -1))
    return paras.select("doc_id", "para_no", *keep, F.greatest(F.lit(1), F.ceil(F.coalesce(before, F.lit(0)) / WORDS_A_PAGE)).cast("long").alias("page"))


def pages_by_breaks(paras: DataFrame, breaks: Column) -> DataFrame:
    """Page of each paragraph, where a break counts for the paragraphs after it."""
    before = F.sum(breaks).over(W.partitionBy("doc_id").orderBy("para_no").rowsBetween(W.unboundedPreceding, -1))
    return paras.select("doc_id", "para_no", (1 + F.coalesce(before, F.lit(0))).cast("long").alias("page"))


def section_rows(paras: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Rows between an opening and a closing marker; markers are left out."""
    mark = F.when(opens, 1).when(closes, 0)
    inside = F.last(mark, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("para_no"))
    return paras.withColumn("_in", F.coalesce(inside, F.lit(0))).where((F.col("_in") == 1) & ~opens & ~closes).drop("_in")


def rows_before(paras: DataFrame, stop: Column) -> DataFrame:
    """Rows of each document before its first stop."""
    first = F.min(F.when(stop, F.col("para_no"))).over(W.partitionBy("doc_id"))
    return paras.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("para_no") < F.col("_first"))).drop("_first")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def without_images(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, r"(?i)<img[^>]*>", ""), r"url\(data:[^)]*\)", "")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """Overlapping spans joined; spans that only touch stay apart."""
    w = W.partitionBy(*key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    return spans.withColumn("_new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def look_ahead(paras: DataFrame, asks: Column, stops: Column, answer: Column, reach: int = 9) -> DataFrame:
    """For each row that asks, the first answer in the next `reach` rows, none beyond a row that stops."""
    w = W.partitionBy("doc_id").orderBy("para_no").rowsBetween(1, reach)
    place = F.col("para_no")
    said = paras.select("*", asks.alias("_asks"), stops.alias("_stops"), answer.alias("_answer"))
    hit = F.when(F.col("_answer").isNotNull(), F.struct(place.alias("at"), F.col("_answer").alias("answer")))
    first = lambda c: F.first(c, ignorenulls=True).over(w)
    df = said.select("*", first(F.when(F.col("_stops"), place)).alias("_stop"), first(hit).alias("_hit")).drop("_stops", "_answer")
    hit = F.when(F.col("_stop").isNull() | (F.col("_hit.at") < F.col("_stop")), F.col("_hit.answer"))
    return df.where("_asks").withColumn("answer", hit).drop("_asks", "_stop", "_hit")


def hex_entities(text: Column) -> Column:
    """Decimal character entities written in hexadecimal, of four digits at least; numbers beyond 2**31 stay."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)&#[0-9]{1,9};|&|[^&]+"), F.lit(0))
    number = lambda x: F.regexp_extract(x, r"^&#([0-9]+);$", 1)
    code = lambda x: F.hex(number(x).try_cast("long"))
    wide = lambda x: F.when(F.length(code(x)) < 4, F.lpad(code(x), 4, "0")).otherwise(code(x))
    return F.array_join(F.transform(parts, lambda x: F.when(number(x) != "", F.concat(F.lit("&#x"), wide(x), F.lit(";"))).otherwise(x)), "")
