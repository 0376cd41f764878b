"""Numbered citations in text: ranges out, ranges back in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions.text import bound, spread, starts_of

# A hyphen, an en dash or an em dash, and the marks around a citation.
DASH = "[-–—]"
CARET = r"\^([\d,\-–—\s]+)\^"
BRACKETED = r"[\^\[\(]([\d,\-–—\s]+)[\^\]\)]"
NUMERIC_RUN = r"^[\d,\-–—\s]+$"
LEADING_NUMBER = r"^\[?\d+\]?[\.\s]*"

#: Numbers of a range that are in memory together where ranges are spelled out as rows.
STEP = 1 << 16


def number_ranges(text: Column) -> Column:
    """array<struct<low, high>>: what a text such as `1-3, 7` names, in order; a range that runs backwards and numbers beyond 32 bits give none."""

    def one(part: Column) -> Column:
        a, z = (F.regexp_extract(part, rf"^\s*(\d+)\s*(?:{DASH}\s*(\d+)\s*)?$", k) for k in (1, 2))
        low, high = a.try_cast("int"), F.when(z == "", a).otherwise(z).try_cast("int")
        return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))

    return F.array_compact(F.transform(F.split(text, ","), one))


def get_numbers(text: Column) -> Column:
    """The ids that number_ranges() names as one array. Where a text may name millions, use id_rows()."""
    return F.flatten(F.transform(number_ranges(text), lambda r: F.sequence(r["low"], r["high"])))


def each_number(rows: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """`rows` once for each number from `low` to `high`, in steps, so that no range is ever held whole."""
    step = F.explode(F.sequence(F.col(low).cast("long"), F.col(high).cast("long"), F.lit(STEP))).alias("_step")
    cut = rows.select("*", step)
    return cut.select("*", F.explode(F.sequence("_step", F.least(F.col("_step") + STEP - 1, F.col(high).cast("long")))).alias(name)).drop("_step")


def id_rows(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """(keep, seq, n): a row for each id that the texts name, seq counting a text's ids from 0."""
    placed = bound(number_ranges(F.col(text)), lambda r: F.arrays_zip(starts_of(F.transform(r, lambda x: x["high"].cast("long") - x["low"] + 1)).alias("before"), r.alias("range")))
    each = spread(rows, keep, placed, "_r").select(*keep, "_r.before", "_r.range.low", "_r.range.high")
    return each_number(each, "low", "high", "n").select(*keep, (F.col("before") + F.col("n") - F.col("low")).alias("seq"), "n")


def format_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """(key, shown): the distinct numbers of each key with runs of three or more as `a-b`, of two as `a,b`."""
    each = rows.select(key, F.col(number).alias("n")).distinct()
    island = each.withColumn("island", F.col("n") - F.row_number().over(W.partitionBy(key).orderBy("n")))
    runs = island.groupBy(key, "island").agg(F.min("n").alias("a"), F.max("n").alias("z"))
    a, z = F.col("a").cast("string"), F.col("z").cast("string")
    shown = F.when(F.col("a") == F.col("z"), a).when(F.col("a") + 1 == F.col("z"), F.concat(a, F.lit(","), z)).otherwise(F.concat(a, F.lit("-"), z))
    order = F.sort_array(F.collect_list(F.struct("a", shown.alias("shown"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(order, lambda x: x["shown"]), ", ").alias("shown"))


def renumbered_text(paras: DataFrame, mapping: DataFrame) -> DataFrame:
    """(doc_id, para_no, text): the paragraphs with the numbers of each citation mark put through `mapping` (doc_id, old, new)
    and written anew, marks aside; a number without an entry stays.

    Texts are cut at their marks; only marks are spelled out, joined by document and number, and put back.
    """
    cut = rf"{BRACKETED}|[^\^\[\(]+|[\^\[\(]"
    pieces = paras.select("doc_id", "para_no", F.posexplode(F.regexp_extract_all("text", F.lit(cut), F.lit(0))).alias("n", "piece"))
    inside = F.regexp_extract("piece", f"^{BRACKETED}$", 1)
    pieces = pieces.withColumn("inside", F.when(F.size(number_ranges(inside)) > 0, inside))
    marks = id_rows(pieces.where("inside IS NOT NULL").withColumn("key", F.struct("doc_id", "para_no", "n")), ["key", "doc_id"], "inside")
    marks = marks.select("key", "doc_id", F.col("n").alias("old"))
    new = marks.join(mapping.select("doc_id", "old", "new"), ["doc_id", "old"], "left").select("key", F.coalesce("new", "old").alias("id"))
    shown = format_numbers(new, "key", "id").select("key.*", "shown")
    each = pieces.join(shown, ["doc_id", "para_no", "n"], "left")
    line = F.array_sort(F.collect_list(F.struct("n", F.coalesce("shown", "piece").alias("piece"))))
    return each.groupBy("doc_id", "para_no").agg(F.array_join(F.transform(line, lambda x: x["piece"]), "").alias("text"))
