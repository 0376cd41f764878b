"""Near copies by SimHash and by Jaccard similarity of word shingles: candidates from MinHash bands, each verified exactly.

With a `radius`, documents whose SimHash fingerprints of the same shingles differ in so many bits or fewer, found by the byte-position
index of simhash.py, are candidates too, and verified likewise. Sets of a similarity of 0.8 can differ in 14 bits, where that index would offer a fixed share of all pairs; those are found by MinHash
and join the same components, so neither way loses what the other finds.

A document is its set of five-word shingles. 160 minima in 32 bands of 5 are posted for each distinct set; a pair
of similarity s meets in some band with chance 1 - (1 - s^5)^32, which is 0.999997 at 0.8 and more above. Every link
is verified on the whole sets, so none is below `least`.

A band's list of up to `list_limit` sets is joined with itself. Longer lists (large groups of near copies) are first
compared with their least set alone, which links most of a group by as many pairs as it has sets. Lists that are still
in several parts are put together where they overlap and cut into blocks; each pair of blocks is compared in one bounded
task, which gives a spanning forest. That is quadratic in what neither is linked to its list's least set nor meets another.

Edge cases: null is read as the empty text; texts without words are alike. Fewer words than a shingle: the whole
sequence is the shingle. Repeated shingles count once. Null ids come last: a group keeps a row with an id if it has one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, unused, written
from .components import components
from .decontam import shingle_hashes, word_hashes
from .simhash import fingerprint, links
from .words import split_words

BANDS, ROWS = 32, 5
_RANDOM = np.random.default_rng(8)
TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    offsets, codes, words = split_words(texts, lower=True)
    hashed = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
    each = (hashed[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
    return [np.unique(shingle_hashes(own, min(shingle, max(1, len(own))))) for own in each]


def bands(own: np.ndarray) -> np.ndarray:
    """A key for each band of the minima of a set's hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 2048):
        low = np.minimum(low, (own[None, at : at + 2048] * TIMES[:, None] + PLUS[:, None]).min(1))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = (key ^ low[k::ROWS]) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketches(docs: DataFrame, shingle: int = 5, fingerprints: bool = False) -> DataFrame:
    """(doc_id, text_key, sig, bands): sig names the shingle set; with `fingerprints` also fp, the text's SimHash as a signed 64-bit integer."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            sets = shingle_sets(b.column("text"), shingle)
            sig = np.fromiter((xxh64_intdigest(s.tobytes()) for s in sets), np.uint64, len(sets)).view(np.int64)
            keys = pa.array(np.concatenate([*map(bands, sets), np.zeros(0, np.int64)]))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
            out = {"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "sig": sig, "bands": lists}
            if fingerprints:
                out["fp"] = np.array([fingerprint(t.as_py(), shingle) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch(out)

    schema = "doc_id long, text_key long, sig long, bands array<long>" + (", fp long" if fingerprints else "")
    return docs.select(*row_key(), "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(each, schema)


def near_fingerprints(each: DataFrame, radius: int) -> DataFrame:
    """(a, b): links between sets some of whose texts have fingerprints within `radius` bits, each by the least set of its fingerprint."""
    told = written(each.select("sig", "fp").distinct(), "fingerprints")
    heads = written(told.groupBy("fp").agg(F.min("sig").alias("head")), "heads")
    equal = told.join(heads, "fp").where("sig <> head").select(F.col("sig").alias("a"), F.col("head").alias("b"))
    x, y = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    close = links(heads.select("fp"), radius).join(x, "a").join(y, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return equal.union(close).distinct()


def whole_sets(docs: DataFrame, reps: DataFrame, sigs: DataFrame, shingle: int) -> DataFrame:
    """(sig, own): the sets named in `sigs`, as bytes, made again from one text of each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"sig": b.column("sig"), "own": pa.array([s.tobytes() for s in shingle_sets(b.column("text"), shingle)], pa.binary())})

    wanted = reps.join(sigs, "sig").select("sig", "rep")
    rows = docs.select(F.xxhash64("text").alias("rep"), "text").join(wanted, "rep").select("sig", "text")
    return rows.mapInArrow(each, "sig long, own binary").groupBy("sig").agg(F.min("own").alias("own"))


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have similarity `least` or more."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = sets.select(F.col("sig").alias("a"), F.col("own").alias("x")), sets.select(F.col("sig").alias("b"), F.col("own").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted sets; two empty ones are alike."""
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _forest(group: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of a pair of blocks as (a, b): each set with the least of its component."""
    sets, sig = [np.frombuffer(x, np.uint64) for x in group["own"]], group["sig"].to_numpy()
    order = np.argsort(sig)
    sets, sig = [sets[i] for i in order], sig[order]
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    values, code, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row, code = row[times[code] > 1], code[times[code] > 1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    cuts = np.searchsorted(code, np.arange(0, len(values) + 2048, 2048))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if j > i:
            used, at = np.unique(code[i:j], return_inverse=True)
            part = np.zeros((len(sets), len(used)), np.float32)
            part[row[i:j], at] = 1
            both += part @ part.T
    near = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= least
    np.fill_diagonal(near, True)
    label = np.arange(len(sets))
    while True:
        low = np.array([label[r].min() for r in near])
        low = low[low]
        if (low == label).all():
            break
        label = low
    moved = label != np.arange(len(sets))
    return pd.DataFrame({"a": sig[moved], "b": sig[label[moved]]})


def groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, list_limit: int = 32, block: int = 256, radius: int | None = None) -> DataFrame:
    """(doc_id, text_key, root): every row, with the least set that links of similarity `least` or more reach; `radius`: candidates from fingerprints too."""
    each = written(sketches(docs, shingle, radius is not None), "sketches")
    reps = written(each.groupBy("sig").agg(F.min("text_key").alias("rep"), F.first("bands").alias("bands")), "sets")
    posted = reps.select("sig", F.explode("bands").alias("key"))
    sizes = posted.groupBy("key").agg(F.count("*").alias("n"), F.min("sig").alias("head")).where("n > 1")
    listed = written(posted.join(sizes, "key"), "posted")

    short, long = listed.where(F.col("n") <= list_limit), listed.where(F.col("n") > list_limit)
    x, y = short.select("key", F.col("sig").alias("a")), short.select("key", F.col("sig").alias("b"))
    met = x.join(y, (x.key == y.key) & (F.col("a") < F.col("b"))).select("a", "b")
    star = long.where("sig <> head").select(F.col("head").alias("a"), F.col("sig").alias("b"))
    met = met.union(star) if radius is None else met.union(star).union(near_fingerprints(each, radius))
    pairs = written(met.distinct(), "pairs")
    named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    sets = written(whole_sets(docs, reps, named, shingle), "whole")
    found = written(verified(pairs, sets, least), "links")
    roots = written(components(found), "roots")

    # Long lists that are in several parts still.
    of = long.select("key", "sig", "head").join(roots, F.col("sig") == F.col("node"), "left").select("key", "sig", "head", F.coalesce("root", "sig").alias("root"))
    parted = of.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    left = written(of.join(parted, "key").select("head", "sig").distinct(), "parted")
    if not left.isEmpty():
        pools = components(left, "head", "sig")
        counted = written(pools.withColumnRenamed("node", "sig").withColumnRenamed("root", "pool"), "pools")
        blocks = counted.groupBy("pool").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
        others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        paired = counted.join(blocks, "pool").select("sig", "pool", F.explode(others).alias("at")).join(sets, "sig").select("pool", "at.i", "at.j", "sig", "own")
        more = paired.groupBy("pool", "i", "j").applyInPandas(lambda g: _forest(g, least), "a long, b long")
        roots = written(components(found.union(more)), "roots")
    named = written(reps.select("sig").join(roots, F.col("sig") == F.col("node"), "left").select("sig", F.coalesce("root", "sig").alias("root")), "named")
    return written(each.select("doc_id", "text_key", "sig").join(named, "sig").select("doc_id", "text_key", "root"), "groups")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, **limits: int) -> DataFrame:
    """`docs` with one row of each group: that of the least id (nulls last), then text; one of equal rows."""
    g_id, g_key = unused(docs, "g_id", "g_key")
    rows = groups(docs, shingle, least, **limits).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = rows.groupBy("root").agg(F.min(place).alias("best"))
    told = written(rows.join(best, "root").select(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key), "n", (place == F.col("best")).alias("kept")), "told")

    def those(df: DataFrame, named: DataFrame, how: str) -> DataFrame:
        return df.join(named, df["doc_id"].eqNullSafe(named[g_id]) & (F.xxhash64(df["text"]) == named[g_key]), how)

    left = those(docs, told.where("NOT kept").select(g_id, g_key), "left_anti")
    twice = told.where("kept AND n > 1").select(g_id, g_key)
    if twice.isEmpty():
        return left
    return those(left, twice, "left_anti").union(those(docs, twice, "left_semi").dropDuplicates(["doc_id", "text"]))
