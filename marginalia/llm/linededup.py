"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the pages of the host; lines over the
boilerplate ratio, on `least_pages` pages or more, are dropped from all the host's pages.

Edge cases: null is read as the empty text; a null host is a host of its own. Blank lines are neither
counted nor dropped. Lines are compared without white space at their ends. A line that a page repeats
counts as one page. Equal rows are pages each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS

#: A host has at most (lines a page) / ratio boilerplate lines; above this many in all, none are broadcast.
BROADCAST_LINES = 1 << 19


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _digest(line: Column) -> Column:
    """128 bits of a line, as two hashes with different starts."""
    return F.struct(F.xxhash64(_bare(line)).alias("a"), F.xxhash64(F.lit("line"), _bare(line)).alias("b"))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """(host, line, pages, total): the digests of lines on over `ratio` of their host's pages."""
    lines = F.array_distinct(F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _bare(x) != ""), _digest))
    pages = docs.select(F.col(host).alias("host"), F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)
    totals = docs.groupBy(F.col(host).alias("t_host")).agg(F.count("*").alias("total"))
    return pages.join(totals, F.col("host").eqNullSafe(F.col("t_host"))).where(F.col("pages") > ratio * F.col("total")).drop("t_host")


def _without(text: Column, bad: Column) -> tuple[Column, Column]:
    """(text without the lines whose digests are in `bad`, number of lines dropped)."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: (_bare(x) == "") | ~F.array_contains(bad, _digest(x)))
    return F.array_join(kept, "\n"), (F.size(lines) - F.size(kept)).cast("long")


def drop_boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """`docs` with the boilerplate lines gone from `text`, and n_dropped, the lines taken from each.

    The lines are few (a host has a bounded number) and are counted first. Up to BROADCAST_LINES go to
    every task by host; beyond that, hosts' lists are joined by shuffle, where AQE splits a hot host.
    """
    bad = boilerplate(docs, host, ratio, least_pages).groupBy(F.col("host").alias("b_host")).agg(F.collect_list("line").alias("b_lines"))
    bad = bad.checkpoint()
    small = (bad.agg(F.sum(F.size("b_lines"))).first()[0] or 0) <= BROADCAST_LINES
    rows = docs.select(F.struct("*").alias("_row"), F.col(host).alias("_host"), "text")
    rows = rows.join(F.broadcast(bad) if small else bad, F.col("_host").eqNullSafe(F.col("b_host")), "left")
    text, dropped = _without(F.col("text"), F.col("b_lines"))
    untouched = F.col("b_lines").isNull() | F.col("text").isNull()
    names = [F.when(untouched, F.col("text")).otherwise(text).alias(c) if c == "text" else F.col(f"_row.{c}").alias(c) for c in docs.columns]
    return rows.select(*names, F.when(untouched, F.lit(0).cast("long")).otherwise(dropped).alias("n_dropped"))


def dedup_lines(docs: DataFrame, host: str = "source", ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """`docs` with the columns they came with, without boilerplate lines."""
    own = docs.columns
    return drop_boilerplate(docs, host, ratio, least_pages).select(*own)
