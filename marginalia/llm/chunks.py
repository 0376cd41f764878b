"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = 2h + g(byte). A chunk ends where the low 16 bits, which
depend on the last 16 bytes alone, fall under a threshold (one place in `mean`), unless another such
place lies within the `least` bytes before; longer gaps are cut every `most` bytes from their start.
So boundaries depend on nearby content only and come back to step after an insertion.
Chunks are compared by 96-bit digest; all but the first occurrence (least doc_id, then place) are
repeats, and runs of repeats of `span` bytes or more are reported. Line ends and tabs count as spaces.

Edge cases: null and empty texts have no chunks. Equal rows repeat each other. A null id comes first, rows of one id
as they stand in the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import row_key, unused, written

ONE_BLANK = bytes(32 if 9 <= i <= 13 else i for i in range(256))  # texts that are only wrapped anew stay alike
GAP = 32  # zero bytes between texts, which clear the rolling hash


def gear_table() -> np.ndarray:
    """256 pseudo-random values by a multiplicative rule; 0 for byte 0, so that gaps leave no trace."""
    x = np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)).astype(np.uint16)


def boundaries(texts: list[bytes], mean: int = 24, least: int = 12, most: int = 256) -> list[np.ndarray]:
    """The chunk ends of each text, its length last."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(size + GAP)])[:-1]
    h = gear_table()[np.frombuffer((b"\0" * GAP).join(texts) + b"\0" * GAP, np.uint8)]
    for k in (1, 2, 4, 8):  # windows of 2, 4, 8, 16 bytes
        h[k:] += h[:-k] << np.uint16(k)
    cut = np.flatnonzero(h < 65536 // mean)
    text = np.searchsorted(start, cut, "right") - 1
    inside = cut - start[text] < size[text] if len(cut) else np.zeros(0, bool)
    cut, text = cut[inside] + 1, text[inside]
    if len(cut):
        apart = np.concatenate([[True], (np.diff(cut) > least) | (np.diff(text) > 0)])
        cut, text = cut[apart], text[apart]
    out, by = [], np.searchsorted(text, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        ends = np.concatenate([[0], cut[by[i] : by[i + 1]] - start[i], [size[i]]])
        if (np.diff(ends) > most).any():
            ends = np.concatenate([np.arange(a, z, most) if z - a > most else [a] for a, z in zip(ends[:-1], ends[1:], strict=True)] + [[size[i]]])
        out.append(np.unique(ends[ends > 0]))
    return out


def chunks(docs: DataFrame, mean: int = 24, least: int = 12, most: int = 256) -> DataFrame:
    """(doc_id, text_key, row, start, size, d1, d2): every chunk, in bytes, with its digest; `row` tells all rows apart."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_intdigest

        for b in batches:
            texts = [t.encode().translate(ONE_BLANK) for t in b.column("text").to_pylist()]
            ends = boundaries(texts, mean, least, most)
            n = np.array([len(e) for e in ends])
            starts = [np.concatenate([[0], e[:-1]]) if len(e) else e for e in ends]
            digest = [xxh3_128_intdigest(t[i:j]) for t, a, e in zip(texts, starts, ends, strict=True) for i, j in zip(a.tolist(), e.tolist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(texts)), n))
            raw = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in digest), np.int64).reshape(-1, 2)
            start = np.concatenate([*starts, np.zeros(0)]).astype(np.int32)
            yield pa.record_batch({"doc_id": b.column("doc_id").take(row), "text_key": b.column("text_key").take(row), "row": b.column("row").take(row), "start": start, "size": (np.concatenate([*ends, np.zeros(0)]) - start).astype(np.int32), "d1": raw[:, 0], "d2": (raw[:, 1] >> 32).astype(np.int32)})

    rows = docs.select(*row_key(), F.monotonically_increasing_id().alias("row"), "text").where("text <> ''").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(each, "doc_id long, text_key long, row long, start int, size int, d1 long, d2 int")


def repeated_spans(docs: DataFrame, span: int = 64, **sizes: int) -> DataFrame:
    """doc_id, text_key, copy, start, end, n_chunks, first_doc_id, first_doc_ids: runs of repeated chunks, in bytes, the document
    that has the most of a run first, and all that have `span` bytes or more of it first. `copy` numbers equal rows.

    Digests are summed before they are shuffled, so a hot chunk is one row a task; the join back to the
    chunks has one row for each repeated digest, and AQE splits its hot side.
    """
    each = written(chunks(docs, **sizes), "chunks")  # numbered and hashed once: rows keep their numbers in both passes over them
    place = F.struct(F.col("doc_id").alias("first_doc_id"), F.col("row").alias("first_row"), F.col("start").alias("first_start"))
    dup = each.groupBy("d1", "d2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("d1", "d2", "first.*")
    hit = each.join(dup, ["d1", "d2"]).where("row <> first_row OR start <> first_start")
    by = W.partitionBy("doc_id", "text_key", "row").orderBy("start")
    runs = hit.withColumn("new", F.coalesce((F.lag(F.col("start") + F.col("size")).over(by) < F.col("start")).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by))
    by_first = runs.groupBy("doc_id", "text_key", "row", "run", "first_doc_id").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    firsts = F.collect_list(F.when(F.col("bytes") >= span, F.col("first_doc_id")))
    found = by_first.groupBy("doc_id", "text_key", "row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_chunks"), F.max_by("first_doc_id", "bytes").alias("first_doc_id"), F.sort_array(firsts).alias("first_doc_ids"))
    copy = F.dense_rank().over(W.partitionBy("doc_id", "text_key").orderBy("row"))
    return found.where(F.col("end") - F.col("start") >= span).withColumn("copy", copy).select("doc_id", "text_key", "copy", "start", "end", "n_chunks", "first_doc_id", "first_doc_ids")


def drop_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`docs` with the spans cut from `text`; bytes of a character that a cut leaves are dropped with it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, gone in zip(b.column("text").to_pylist(), b.column(g_gone).to_pylist(), strict=True):
                if gone:
                    raw, kept, at = text.encode(), [], 0
                    for x in gone:
                        kept.append(raw[at : max(at, x["start"])])
                        at = max(at, x["end"])
                    text = b"".join([*kept, raw[at:]]).decode(errors="ignore")
                out.append(text)
            yield pa.record_batch([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    names = docs.columns
    key, nth, g_id, g_key, g_copy, g_gone = unused(docs, "key", "nth", "g_id", "g_key", "g_copy", "g_gone")
    gone = spans.groupBy(F.col("doc_id").alias(g_id), F.col("text_key").alias(g_key), F.col("copy").alias(g_copy)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(g_gone))
    # Equal rows stand for each other, so any numbering of them will do.
    rows = docs.withColumn(key, F.xxhash64("text")).withColumn(nth, F.row_number().over(W.partitionBy("doc_id", key).orderBy(key)))
    rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone[g_id]) & (rows[key] == gone[g_key]) & (rows[nth] == gone[g_copy]), "left").select(*names, g_gone)
    return rows.mapInArrow(cut, docs.schema)
