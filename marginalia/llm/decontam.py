"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

Windows of a document as long as a benchmark item (in words) are fingerprinted over their five-word
shingles; a window is a candidate for the items of its length if one of its 8 fingerprint bytes is
within radius // 8 bits of the item's, which holds for every fingerprint within `radius` bits. Candidates
are verified by weighted-shingle similarity: shingles weighted by how often they occur, shared weight
over that of the larger of both. Windows that hold no shingle of any item of their length have similarity 0 and are not
fingerprinted.

Words are taken at ASCII white space with A-Z in lower case. An item of fewer than five words is one
shingle of all its words. Edge cases: null and empty texts have no windows; items without words match
nothing; equal items are each reported; equal rows each give rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, unused
from .words import split_words

SHINGLE, BLOCKS = 5, 8
#: Items that go to every task at once; more are searched for in further passes over the documents.
ITEMS_A_PASS = 4096
#: Windows that are looked up at once.
WINDOWS = 1 << 12
TURN = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """The hash of each run of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * TURN + words[k : k + n]
    return _mixed(h)


def word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def window_fingerprints(shingles: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each run of `size` shingles."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    upto = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=upto[1:])
    return np.packbits(2 * (upto[size:] - upto[:-size]) > size, axis=1, bitorder="little").view(np.uint64)[:, 0]


class ItemIndex:
    """Fingerprints of a bounded number of items, by length in words, in Hamming blocks."""

    def __init__(self, ids: list, texts: pa.Array, radius: int):
        self.radius, self.ids = radius, ids
        offsets, codes, words = split_words(texts, lower=True)
        hashed = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
        self.shingles = [shingle_hashes(own, min(SHINGLE, max(1, len(own)))) for own in np.split(hashed, offsets[1:-1])] if ids else []
        self.lengths = np.diff(offsets)
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(self.lengths.tolist()):
            if n:
                self.by_length[n].append(i)
        self.fp, self.lists = {}, {}
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius // BLOCKS
        for n, items in self.by_length.items():
            self.fp[n] = np.concatenate([window_fingerprints(self.shingles[i], len(self.shingles[i])) for i in items])
            own = self.fp[n].view(np.uint8).reshape(-1, BLOCKS)
            # For each block, the items that a window's byte leads to: those of byte v are listed from upto[v] to upto[v + 1].
            self.lists[n] = [self._list(near[:, own[:, k]]) for k in range(BLOCKS)]
        # which lengths a shingle is looked for in, by shingle size
        self.owners: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for i, own in enumerate(self.shingles):
            for h in own.tolist():
                self.owners[min(SHINGLE, int(self.lengths[i]))][h].add(int(self.lengths[i]))
        self.owners = {k: dict(v) for k, v in self.owners.items()}
        self.known = {k: np.sort(np.fromiter(v, np.uint64, len(v))) for k, v in self.owners.items()}

    @staticmethod
    def _list(leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(leads.sum(1))]), np.nonzero(leads)[1]

    def candidates(self, fp: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(window, place of the item in its length, bits) within the radius, found by the blocks' lists."""
        for a in range(0, len(fp), WINDOWS):
            own = fp[a : a + WINDOWS].view(np.uint8).reshape(-1, BLOCKS)
            found = []
            for k, (upto, items) in enumerate(self.lists[n]):
                size = (upto[1:] - upto[:-1])[own[:, k]]
                at = np.repeat(upto[own[:, k]] - np.cumsum(size) + size, size) + np.arange(size.sum())
                found.append(np.repeat(np.arange(len(own)), size) * len(self.fp[n]) + items[at])
            pairs = np.unique(np.concatenate(found))
            w, j = pairs // len(self.fp[n]) + a, pairs % len(self.fp[n])
            bits = np.bitwise_count(fp[w] ^ self.fp[n][j])
            close = bits <= self.radius
            yield from zip(w[close].tolist(), j[close].tolist(), bits[close].tolist(), strict=True)

    def matches(self, shingles: np.ndarray, size: int, at: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, bits) of verified windows of one document, of which `at` are known shingles.

        A document shorter than an item is one window.
        """
        starts: dict[int, set[int]] = defaultdict(set)
        for p in at.tolist():
            for n in self.owners[size][int(shingles[p])]:
                last = max(0, len(shingles) - (n - size + 1))
                starts[n].update(range(max(0, p - n + size), min(p, last) + 1))
        for n, found in starts.items():
            m = min(n - size + 1, len(shingles))
            places = np.array(sorted(found))
            for run in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                if not len(run):
                    continue
                fp = window_fingerprints(shingles[run[0] : run[-1] + m], m)
                for w, j, bits in self.candidates(fp, n):
                    item, start = self.by_length[n][j], int(run[0]) + w
                    alike = similarity(shingles[start : start + m], self.shingles[item])
                    if alike >= least:
                        yield item, start, m + size - 1, alike, bits


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weight that two bags of shingles share over the larger bag's weight."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(np.minimum(n[i], m[j]).sum()) / max(len(a), len(b), 1)


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8, radius: int = 23) -> DataFrame:
    """doc_id, text_key, item_id, start_word, n_words, similarity, bits: the best window of each document for each item it leaks."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    passes = max(1, -(-items.count() // (ITEMS_A_PASS // 2)))
    schema = "doc_id long, text_key long, item_id long, start_word long, n_words long, similarity double, bits int"
    rows = docs.select(*row_key(), "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    found = []
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).toArrow()
        text = part.column("text").combine_chunks()
        index = spark.sparkContext.broadcast(ItemIndex(part.column("item_id").to_pylist(), text if isinstance(text, pa.Array) else text.chunk(0), radius))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for b in batches:
                offsets, codes, words = split_words(b.column("text"), lower=True)
                hashed = word_hashes(words)[codes] if len(words) else np.zeros(0, np.uint64)
                best: dict[tuple[int, int], tuple] = {}
                for size, known in ix.known.items():
                    shingles = shingle_hashes(hashed, size)
                    quick = np.zeros(1 << 20, bool)
                    quick[(known >> np.uint64(44)).astype(np.int64)] = True
                    at = np.flatnonzero(quick[(shingles >> np.uint64(44)).astype(np.int64)])
                    at = at[np.isin(shingles[at], known)]
                    doc = np.searchsorted(offsets, at, "right") - 1
                    inside = at + size <= offsets[doc + 1]
                    at, doc = at[inside], doc[inside]
                    for d in np.unique(doc).tolist():
                        own = shingles[offsets[d] : offsets[d + 1] - size + 1]
                        for item, start, n, alike, bits in ix.matches(own, size, at[doc == d] - offsets[d], least):
                            new = (alike, -bits, -start, n)
                            best[d, item] = max(best.get((d, item), new), new)
                keys = sorted(best)
                row = pa.array([d for d, _ in keys], pa.int64())
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").take(row),
                        "text_key": b.column("text_key").take(row),
                        "item_id": pa.array([ix.ids[i] for _, i in keys], pa.int64()),
                        "start_word": pa.array([-best[x][2] for x in keys], pa.int64()),
                        "n_words": pa.array([best[x][3] for x in keys], pa.int64()),
                        "similarity": pa.array([best[x][0] for x in keys], pa.float64()),
                        "bits": pa.array([-best[x][1] for x in keys], pa.int32()),
                    }
                )

        found.append(rows.mapInArrow(search, schema))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """`docs` without those that hold a window alike to an item; null ids are matched as ids are."""
    gone_id, gone_key = unused(docs, "gone_id", "gone_key")
    gone = find_leaks(docs, benchmark, least).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[gone_id]) & (F.xxhash64(docs["text"]) == gone[gone_key]), "left_anti")
