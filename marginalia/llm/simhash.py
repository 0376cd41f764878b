"""SimHash near-duplicates over a byte-position inverted index with count filtering.

A fingerprint has 64 bits in 8 bytes. If two differ in r bits or fewer, at least m = 8 - r of their
positional bytes agree. Fingerprints are posted under every set of `take` positional bytes (for r = 4:
56 triples). A pair that shares m bytes meets in C(m, take) lists at least (4 of the 56), so the lists
in which each pair meets are tallied, and only pairs that reach that count are compared bit by bit.

Only distinct fingerprints are posted. A posting list of up to `list_limit` is joined with itself;
longer ones (large groups of near copies) are cut into blocks, each pair of blocks is compared in
one bounded task, by shared bytes and then bits, and gives a spanning forest of its links. So a pair that
meets in a long list is settled there, and any other has its full tally. No list is expanded into all its pairs.
A key has 8 * take bits: lists of N random fingerprints hold N / 2**(8 * take), so from some 10**9 on `take` is to be 4.

Edge cases: null is read as the empty text; texts without words have fingerprint zero and are linked
like any other. Fewer words than a shingle: the whole sequence is the shingle. Repeated shingles
count as often as they occur. A null id has null as component_id unless others are in its group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .components import components


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], stops[:-1]])
    k = min(shingle, len(words))
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        a, z = starts[at : min(n, at + (1 << 16))].tolist(), (stops[k - 1 :][at : at + (1 << 16)] - 1).tolist()
        h = np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, z, strict=True)), np.uint64, len(a))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, text_key, fp): fp as a signed 64-bit integer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "fp": fp})

    return docs.select(*row_key(), "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(each, "doc_id long, text_key long, fp long")


def _near(some: np.ndarray, every: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs share 8 - radius positional bytes and differ in `radius` bits or fewer."""
    x, y = (v.view(np.uint8).reshape(-1, 8) for v in (some, every))
    tally = np.zeros((len(some), len(every)), np.uint8)
    for k in range(8):
        tally += x[:, None, k] == y[None, :, k]
    near = tally >= 8 - radius
    i, j = np.nonzero(near)
    near[i, j] = np.bitwise_count(some[i] ^ every[j]) <= radius
    return near


def _forest(group: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Links of a block of fingerprints as (a, b): each with the least of its component within the block."""
    fp = np.unique(group["fp"].to_numpy()).view(np.uint64)
    near = np.vstack([_near(fp[i : i + 512], fp, radius) for i in range(0, len(fp), 512)])
    label = np.arange(len(fp))
    while True:
        low = np.array([label[row].min() for row in near])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(fp))
    return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})


def links(fps: DataFrame, radius: int = 4, take: int = 3, list_limit: int = 32, block: int = 1024) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` at `radius` bits or fewer, enough to connect all that are linked."""
    least = comb(8 - radius, take)
    byte = lambda i: F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255))
    keys = []
    for k, positions in enumerate(combinations(range(8), take)):
        key = F.lit(k).cast("long")
        for i in positions:
            key = F.shiftleft(key, 8).bitwiseOR(byte(i))
        keys.append(key)
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    listed = written(posted.join(sizes, "key"), "posted")

    short = listed.where(F.col("n") <= list_limit)
    x, y = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
    tally = x.join(y, (x.key == y.key) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    met = tally.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    long = listed.where(F.col("n") > list_limit)
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0))), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    paired = long.select("fp", "key", F.explode(others).alias("at")).select("fp", "key", "at.i", "at.j")
    forest = paired.groupBy("key", "i", "j").applyInPandas(lambda g: _forest(g, radius), "a long, b long")
    return met.union(forest).distinct()


#: Fingerprints up to which three bytes make a key; with four, lists are 256 times as short and no pair has to share more than the radius asks.
MOST_BY_THREE = 1 << 28


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, take: int | None = None) -> DataFrame:
    """One row for each document: doc_id, text_key, fp and component_id, the least doc_id that links reach. `take`: bytes of a key, by default by the number of fingerprints."""
    each = written(fingerprints(docs, shingle), "fingerprints")
    fps = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    take = take or (3 if fps.count() <= MOST_BY_THREE else 4)
    roots = components(links(fps.select("fp"), radius, take))
    named = written(fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    # Tables on both sides of each join: what is hot is split where it is read, as no aggregation stands between.
    first = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "first")
    classes = named.join(first, "root").select("fp", "component_id")
    return each.join(classes, "fp").select("doc_id", "text_key", "fp", "component_id")
