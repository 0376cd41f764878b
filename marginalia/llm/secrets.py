"""Secret scans: base patterns, and weak parts that count only beside their complements.

A text holds parts of three classes: access identifiers, secrets and endpoints. Parts found by the
base patterns are findings in themselves. A weak part (a user name, an opaque mixed token, a host)
is reported only if, within `scope` code points of its start, an access identifier and a secret
occur (itself included), which an interval join over scope buckets finds.

Edge cases: null is read as the empty text, which has no findings. Rows are told apart by id and
content: equal rows get equal results, one for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import row_key, written

# Kind, class, pattern, least length, the group that the length is taken of.
BASE = [
    ("assign", "secret", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    ("access", "access", r"AKIA[A-Z0-9]+", 20, 0),
    ("hex", "secret", r"[0-9a-f]{24,}", 24, 0),
]
WEAK = [
    ("user", "access", r"(?i)\b(?:user(?:name)?|login|client_?id)\x20?[:=]\x20?[A-Za-z0-9._@-]+|(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", 6, 0),
    ("opaque", "secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}", 20, 0),
    ("endpoint", "endpoint", r"https?://[^\x20\x09-\x0D\"'<>]+|\b[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\b", 7, 0),
]
KINDS = [k for k, *_ in BASE + WEAK]
#: Rows without any of these strings or shapes hold no part; one cheap look spares them the rest.
HINT = r"(?i)passw|secret|token|api_?key|user|login|client_?id|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{20}|@|://|[0-9]\.[0-9]"


def _matches(pattern: str, group: int) -> Column:
    """Array of (before, size, taken): lengths of the text before a match, the match and its group."""
    text, p = F.col("text"), F.lit(pattern)
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, p, F.lit(0))
    taken = F.regexp_extract_all(text, p, F.lit(group)) if group else found
    row = F.transform(F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("a"), found.alias("b"), taken.alias("c")),
                      lambda x: F.struct(F.length(x["a"]).alias("before"), F.length(x["b"]).alias("size"), F.length(x["c"]).alias("taken")))
    empty = F.array().cast("array<struct<before:int,size:int,taken:int>>")
    return F.when(text.rlike(pattern), row).otherwise(empty)


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kind, class, start, end): base and weak parts of each text, in code points."""
    rows = docs.select(*row_key(), "text").where(F.col("text").rlike(HINT))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(c).alias("class"), F.lit(least).alias("least"), _matches(p, g).alias("m")) for k, c, p, least, g in BASE + WEAK])
    rows = rows.select("doc_id", "text_key", F.explode(kinds).alias("k")).where(F.size("k.m") > 0)
    rows = rows.select("doc_id", "text_key", "k.kind", "k.class", "k.least", F.posexplode("k.m").alias("i", "m")).distinct()
    upto = F.sum(F.col("m.before") + F.col("m.size")).over(W.partitionBy("doc_id", "text_key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("end", upto).where(F.col("m.taken") >= F.col("least")).select("doc_id", "text_key", "kind", "class", (F.col("end") - F.col("m.size")).alias("start"), "end")


def linked_weak(found: DataFrame, scope: int = 200) -> DataFrame:
    """The weak parts beside which an access identifier and a secret occur, themselves included.

    Parts meet on (row, bucket of `scope` code points), so a long document spreads over buckets, and
    as parts of a kind don't overlap, a bucket holds a bounded number of them.
    """
    bucket = F.floor(F.col("start") / scope)
    weak = found.where(~F.col("kind").isin([k for k, *_ in BASE])).withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    near = found.select(F.col("doc_id").alias("n_id"), F.col("text_key").alias("n_key"), F.col("start").alias("n_start"), F.col("class").alias("n_class"), bucket.alias("n_bucket"))
    on = F.col("doc_id").eqNullSafe(F.col("n_id")) & (F.col("text_key") == F.col("n_key")) & (F.col("bucket") == F.col("n_bucket")) & (F.abs(F.col("start") - F.col("n_start")) <= scope)
    both = weak.join(near, on).groupBy("doc_id", "text_key", "kind", "class", "start", "end").agg(F.max((F.col("n_class") == "access").cast("int")).alias("a"), F.max((F.col("n_class") == "secret").cast("int")).alias("s"))
    return both.where("a = 1 AND s = 1").drop("a", "s")


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """One row for each document: doc_id, text_key and `spans`, an array of (start, rank, kind, end) in text order.

    Base spans always stay; linked weak spans join them.
    """
    found = written(parts(docs), "parts")  # few rows, read three times
    spans = found.where(F.col("kind").isin([k for k, *_ in BASE])).unionByName(linked_weak(found, scope))
    rank = reduce(lambda a, k: F.when(F.col("kind") == k, KINDS.index(k)).otherwise(a), KINDS, F.lit(len(KINDS)))
    each = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("spans"))
    rows, each = docs.select(*row_key()), each.withColumnsRenamed({"doc_id": "s_id", "text_key": "s_key"})
    return rows.join(each, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("text_key") == F.col("s_key")), "left").select(
        "doc_id", "text_key", F.coalesce("spans", F.array().cast(each.schema["spans"].dataType)).alias("spans")
    )


def span_text(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
