"""Captions, mentions and credits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import credits as C
from marginalia.functions import text as T
from marginalia.functions.numbers import each_number

# Labels of captioned items.
LABEL = r"(?i)(?:\b)(Figure|Fig\.?|Table|Tab\.?|Box|Exhibit|Appendix|Case\s+Study)\.?\s*([0-9]+(?:[.\-][0-9]+)*)([A-Za-z]?)\b"
LABELS = r"(?i)\b(Figures?|Figs?\.?|Tables?|Tabs?\.?|Box(?:es)?|Exhibits?|Append(?:ix|ices)|Case\s+Stud(?:y|ies))\.?\s+"
RANGE = LABELS + r"([0-9]+\.[0-9]+)\s*(?:to|through|-)\s*([0-9]+\.[0-9]+)\b"
PAIR = LABELS + r"([0-9]+(?:[.\-][0-9]+)*[A-Za-z]?)\s+(?:and|&)\s*([0-9]+(?:[.\-][0-9]+)*[A-Za-z]?)\b"
CAPTION = r"(?i)^(figure|fig\.|table|tab\.|box|exhibit|appendix|case study)"


def plain_dashes(text: Column) -> Column:
    return F.translate(text, "–— ", "-- ")


def item_type(label: Column) -> Column:
    low, out = F.lower(label), F.lit("Figure")
    for start, name in (("tab", "Table"), ("box", "Box"), ("exhibit", "Exhibit"), ("appendix", "Appendix"), ("case", "Case Study")):
        out = F.when(low.startswith(start), name).otherwise(out)
    return out


def items(paras: DataFrame) -> DataFrame:
    """doc_id, para_no, item_type, item_no, is_caption for every numbered item a paragraph names.

    A range within a chapter names each item of it, one over chapters its ends, a pair both; what ranges and
    pairs cover is not read again as single items.
    """
    text = plain_dashes(F.col("text"))
    dotted = lambda c: F.replace(c, F.lit("-"), F.lit("."))
    none = F.lit(None).cast("int")
    named = lambda label, no: F.struct(item_type(label).alias("item_type"), no.alias("item_no"), none.alias("low"), none.alias("high"))
    part = lambda c, k: F.split_part(c, F.lit("."), F.lit(k)).try_cast("int")

    def span(m):
        label, a, z = (F.regexp_extract(m, RANGE, k) for k in (1, 2, 3))
        inner = F.struct(item_type(label).alias("item_type"), part(a, 1).cast("string").alias("item_no"), part(a, 2).alias("low"), part(z, 2).alias("high"))
        return F.when((part(a, 1) == part(z, 1)) & (part(a, 2) <= part(z, 2)), F.array(inner)).otherwise(F.array(named(label, a), named(label, z)))

    both = lambda m: F.array(*[named(F.regexp_extract(m, PAIR, 1), dotted(F.regexp_extract(m, PAIR, k))) for k in (2, 3)])
    one = lambda m: F.array(named(F.regexp_extract(m, LABEL, 1), dotted(F.concat(F.regexp_extract(m, LABEL, 2), F.regexp_extract(m, LABEL, 3)))))
    every = lambda c, p, f: F.flatten(F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(0)), f))
    no_range = F.regexp_replace(text, RANGE, " ; ")
    found = F.concat(every(text, RANGE, span), every(no_range, PAIR, both), every(F.regexp_replace(no_range, PAIR, " ; "), LABEL, one))
    rows = T.spread(paras.select("doc_id", "para_no", text.rlike(CAPTION).alias("is_caption"), found.alias("found")), ["doc_id", "para_no", "is_caption"], F.col("found"), "m")
    rows = rows.select("doc_id", "para_no", "is_caption", "m.*")
    # A range within a chapter is spelled out as rows, however wide; what is no range stands for itself.
    numbered = each_number(rows.withColumns({"low": F.coalesce("low", F.lit(0)), "high": F.coalesce("high", F.lit(0)), "whole": F.col("low").isNull()}), "low", "high", "n")
    number = F.when(F.col("whole"), F.col("item_no")).otherwise(F.concat_ws(".", "item_no", "n"))
    return numbered.select("doc_id", "para_no", "item_type", number.alias("item_no"), "is_caption")


def with_sources(paras: DataFrame, found: Column, stops: Column, most: int = 4) -> Column:
    """Credits, where a Sources block takes along the next lines, up to `most`, that begin with a capital, up to a caption."""
    ahead = W.partitionBy("doc_id").orderBy("para_no").rowsBetween(1, most)
    line = F.struct("para_no", F.col("text").alias("text"), (F.col("text").rlike(r"^\p{Lu}") & ~stops).alias("goes"))
    lines = F.array_sort(F.collect_list(line).over(ahead))
    none = F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("out"))
    add = lambda a, x: F.struct((a["on"] & x["goes"]).alias("on"), F.when(a["on"] & x["goes"], F.concat(a["out"], F.array(x["text"]))).otherwise(a["out"]).alias("out"))
    more = F.aggregate(lines, none, add)["out"]
    return F.when(F.lower(found).contains("sources"), F.concat_ws(" ", found, F.array_join(F.when(F.size(more) > 0, more), " "))).otherwise(found)


def permission_log(paras: DataFrame) -> DataFrame:
    """A row for each caption: its item, text, its own credit or the first within nine paragraphs and before the next caption,
    chapter, need of permission."""
    text = plain_dashes(F.col("text"))
    is_caption, found = text.rlike(CAPTION), C.credit_sentence(F.col("text"))
    rows = T.look_ahead(paras, is_caption, is_caption, with_sources(paras, found, is_caption))
    number = F.regexp_extract(text, LABEL, 2)
    caption, credit = F.btrim(F.regexp_replace(text, LABEL, "")), F.coalesce(found, "answer", F.lit(""))
    return rows.select(
        "doc_id",
        "para_no",
        item_type(F.regexp_extract(text, LABEL, 1)).alias("item_type"),
        number.alias("item_no"),
        caption.alias("caption"),
        credit.alias("credit"),
        F.split_part(number, F.lit("."), F.lit(1)).alias("chapter"),
        C.needs_permission(caption, credit).alias("needs_permission"),
    )
