"""Runs of text cut at the edges of coloured spans, by a sweep over places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Colours in the order in which they cover each other; the last stands over all.
RANKED = "darkGray lightGray darkBlue darkCyan darkGreen darkMagenta darkRed darkYellow black white blue red magenta green cyan yellow".split()

KEYS = ["doc_id", "para_no"]


def coloured(runs: DataFrame, spans: DataFrame, ranked: list[str] = RANKED) -> DataFrame:
    """(doc_id, para_no, run_no, seg_no, text, colour): each run in as few segments as there are changes of colour in it.

    runs: doc_id, para_no, run_no, text, whose texts in the order of run_no make up the paragraph. spans: doc_id, para_no, start, end (code
    points of the paragraph, from 0), colour. Where spans overlap, the colour that comes later in `ranked` shows; other colours don't.
    A sweep over the edges of a paragraph alone, which are few, keeps a running sum a colour, however many spans overlap, and leaves the places where
    what shows changes. These and the runs' beginnings are put in one order, in which a change cuts the run that it falls into: each piece is a segment.
    Spans that are empty, turned round or beyond the text colour nothing; empty and null runs give no rows.
    """
    size = F.length("text")
    begun = F.sum(size).over(W.partitionBy(*KEYS).orderBy("run_no")) - size
    placed = runs.where(size > 0).select(*KEYS, "run_no", "text", begun.cast("long").alias("at"))
    own = spans.where(F.col("end") > F.col("start")).where(F.col("colour").isin(ranked))
    rank = F.array_position(F.array(*map(F.lit, ranked)), F.col("colour"))
    ends = F.array(F.struct(F.greatest("start", F.lit(0)).cast("long").alias("at"), F.lit(1).alias("step")), F.struct(F.col("end").cast("long").alias("at"), F.lit(-1).alias("step")))
    edges = own.select(*KEYS, rank.alias("rank"), F.explode(ends).alias("e")).select(*KEYS, "rank", "e.at", "e.step")
    steps = edges.groupBy(*KEYS, "at").agg(*[F.sum(F.when(F.col("rank") == k, F.col("step")).otherwise(0)).alias(f"c{k}") for k in range(1, len(ranked) + 1)])
    in_order = W.partitionBy(*KEYS).orderBy("at")
    open_ = [F.when(F.sum(f"c{k}").over(in_order.rowsBetween(W.unboundedPreceding, 0)) > 0, c) for k, c in reversed(list(enumerate(ranked, 1)))]
    shown = steps.select(*KEYS, "at", F.coalesce(*open_).alias("colour"))
    changes = shown.withColumn("before", F.lag("colour").over(in_order)).where("NOT colour <=> before").select(*KEYS, "at", "colour")

    # A change at the place where a run begins comes before the run, so that it cuts nothing.
    text_none, run_none = F.lit(None).cast("string").alias("text"), F.lit(None).cast(runs.schema["run_no"].dataType).alias("run_no")
    both = placed.select(*KEYS, "at", F.lit(True).alias("is_run"), "run_no", "text", F.lit(None).cast("string").alias("colour")).unionByName(
        changes.select(*KEYS, "at", F.lit(False).alias("is_run"), run_none, text_none, "colour")
    )
    by_place = W.partitionBy(*KEYS).orderBy("at", "is_run")
    sofar = by_place.rowsBetween(W.unboundedPreceding, 0)
    last = lambda c, of: F.last(F.when(of, c), ignorenulls=True).over(sofar)
    run, is_run = F.struct("run_no", "text", "at", "row"), F.col("is_run")
    numbered = both.withColumn("row", F.row_number().over(by_place))
    swept = numbered.select(*KEYS, "at", "row", last(run, is_run).alias("r"), last(F.struct("colour"), ~is_run)["colour"].alias("colour"), F.lead("at").over(by_place).alias("next"))
    stop = F.col("r.at") + F.length("r.text")
    cut = swept.where("r IS NOT NULL").withColumn("to", F.least(stop, F.coalesce("next", stop))).where("to > at")
    piece = F.substr("r.text", (F.col("at") - F.col("r.at") + 1).cast("int"), (F.col("to") - F.col("at")).cast("int"))
    return cut.select(*KEYS, "r.run_no", (F.col("row") - F.col("r.row")).cast("long").alias("seg_no"), piece.alias("text"), "colour")
