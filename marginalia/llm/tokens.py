"""Token counts (each distinct pre-token counted once) and token ids in directly addressable files.

Edge cases: null is read as the empty text: no tokens, and for the files the end id alone. Texts of
any length are handled word by word. Equal rows each keep their row.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words as words_
from .common import written

# Letters of which a run is one pre-token, and words made of those, digits and signs only.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = f"^[!-&(-~{LETTERS}]+$"
PRE_TOKEN = f"[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+"
JOINED, CALL = 500, 40

_loaded: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple:
    """(tokenizer, for each id whether it ends a pre-token), loaded once in a worker."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        names = [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]
        _loaded[path] = tok, np.array([n.endswith("</w>") for n in names])
    return _loaded[path]


def encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids): the ids of each word by itself, which white space makes independent of its neighbours.

    Plain words go to the library joined by spaces, many in one call: the ids that end a pre-token then
    show where each word ends. Others (apostrophes, special strings, other scripts) go one by one.
    """
    tok, ends = tokenizer(path)
    plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
    plain = plain.to_numpy(zero_copy_only=False).astype(bool)
    sizes, parts = np.zeros(len(words), np.int64), {}
    picked = np.flatnonzero(plain)
    texts = words.take(pa.array(picked)).to_pylist()
    n_pre = pc.count_substring_regex(words.take(pa.array(picked)), PRE_TOKEN).to_numpy(zero_copy_only=False).astype(np.int64)
    got = [np.zeros(0, np.uint32)]
    for i in range(0, len(texts), JOINED * CALL):  # the library's encodings are large, so few are held at once
        joined = [" ".join(texts[j : j + JOINED]) for j in range(i, min(len(texts), i + JOINED * CALL), JOINED)]
        got += [np.array(e.ids, np.uint32) for e in tok.encode_batch_fast(joined, add_special_tokens=False)]
    ids = np.concatenate(got)
    stops = np.flatnonzero(ends[ids]) + 1
    last = np.cumsum(n_pre) - 1
    if len(last) and last[-1] + 1 != len(stops):  # a vocabulary without some plain word's end: no word is joined
        picked, ids, last, plain = picked[:0], ids[:0], last[:0], np.zeros(len(words), bool)
    upto = stops[last] if len(last) else np.zeros(0, np.int64)
    sizes[picked] = np.diff(upto, prepend=0)
    odd = np.flatnonzero(~plain)
    for k, e in zip(odd.tolist(), tok.encode_batch_fast(words.take(pa.array(odd)).to_pylist(), add_special_tokens=False), strict=True):
        parts[k] = np.array(e.ids, np.uint32)
        sizes[k] = len(parts[k])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1], np.uint32)
    at = np.repeat(offsets[picked] - np.concatenate([[0], upto[:-1]]) if len(upto) else np.zeros(0, np.int64), sizes[picked])
    out[at + np.arange(len(ids))] = ids
    for k, own in parts.items():
        out[offsets[k] : offsets[k + 1]] = own
    return offsets, out


#: Words whose ids a worker keeps at most; the first it meets, among which are the frequent ones.
KEPT_WORDS = 1 << 18
_kept: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}


def encode_again(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """What encode_words gives, with words that this worker has met before not encoded again."""
    known, upto, kept = _kept.get(path, (pa.array([], words.type), np.zeros(1, np.int64), np.zeros(0, np.uint32)))
    place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(place < 0)
    own, ids = encode_words(words.take(pa.array(new)), path)
    first = upto[place]  # of the kept ids, then of the new ones behind them
    first[new] = len(kept) + own[:-1]
    sizes = (upto[1:] - upto[:-1])[place] if len(known) else np.zeros(len(words), np.int64)
    sizes[new] = np.diff(own)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.concatenate([kept, ids])[np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])]
    room = min(KEPT_WORDS - len(known), len(new))
    if room > 0:
        more = words.take(pa.array(new[:room]))
        _kept[path] = pa.concat_arrays([known, more]), np.concatenate([upto, upto[-1] + own[1 : room + 1]]), np.concatenate([kept, ids[: own[room]]])
    return offsets, out


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens: pieces counted once for each distinct pre-token of the corpus,
    joined to the documents' pre-token frequencies and summed; no ids are kept."""
    counts = words_.word_counts(docs, lower=False).select("word", "n")
    valued = written(words_.by_word(counts, lambda w: {"n_tokens": np.diff(encode_words(w, path)[0]).astype(float)}, "n_tokens double"), "pieces")
    each = words_.sum_over_words(docs, valued, ["n_tokens"], lower=False)
    return each.withColumn("n_tokens", F.round("n_tokens").cast("long"))


# --- directly addressable codes -------------------------------------------------------------------

CHUNK_BITS, BLOCK_BITS, MAGIC = 8, 512, b"DACTOK01"


def pack_ids(ids: np.ndarray) -> bytes:
    """Directly addressable codes of a sequence of ids.

    Level k holds the k-th byte of every id that needs one, and, but for the last, a bitmap of those that go on, with
    a directory of the ones before each block of 512 bits. Layout: magic, level count, then for each
    level: count, bytes, bitmap, directory (little-endian, uint64 counts, uint32 directory).
    """
    levels, rest = [], ids.astype(np.uint64)
    while True:
        more = rest >> np.uint64(CHUNK_BITS)
        go_on = more > 0
        bits = np.packbits(go_on, bitorder="little").tobytes()
        bits += b"\0" * (-len(bits) % (BLOCK_BITS // 8))
        ones = np.bitwise_count(np.frombuffer(bits, np.uint64)).reshape(-1, BLOCK_BITS // 64).sum(1)
        ranks = np.concatenate([[0], np.cumsum(ones)])[:-1].astype(np.uint32) if len(ones) else np.zeros(0, np.uint32)
        levels.append(np.uint64(len(rest)).tobytes() + (rest & np.uint64(255)).astype(np.uint8).tobytes() + bits + ranks.tobytes())
        rest = more[go_on]
        if not len(rest):
            return MAGIC + np.uint64(len(levels)).tobytes() + b"".join(levels)


class PackedIds:
    """Reads what pack_ids() wrote; any id by its place, without decoding others."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.levels, at = [], 16
        for _ in range(int.from_bytes(data[8:16], "little")):
            n = int.from_bytes(data[at : at + 8], "little")
            blocks = -(-n // BLOCK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * BLOCK_BITS // 8, at + 8 + n)
            ranks = np.frombuffer(data, np.uint32, blocks, at + 8 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 8 + n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // BLOCK_BITS * BLOCK_BITS
            before = np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first]
            i = int(ranks[i // BLOCK_BITS]) + int(before.sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = None
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if out is not None:
                own[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)] |= out << np.uint32(CHUNK_BITS)
            out = own
        return out


SEGMENT = "part int, seq int, n_tokens long, doc_ids array<long>, ends array<long>, codes binary"


def encode_files(docs: DataFrame, path: str, end_id: int, out: str, segment_tokens: int = 1 << 20) -> None:
    """Writes the ids of all documents, each with `end_id` last, in ascending doc_id order below `out`.

    The files are segments in a Parquet container, so that any store Spark writes to will do and a
    retried task leaves no halves: ids in directly addressable codes, and the documents' ids and ends.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            offsets, codes, words = words_.split_words(b.column("text"), lower=False)
            at, ids = encode_again(words, path)
            size = np.diff(at)
            upto = np.concatenate([[0], np.cumsum(size[codes])])
            ends = upto[offsets[1:]] + np.arange(1, b.num_rows + 1)
            cut = 0
            while cut < b.num_rows:
                before = int(ends[cut - 1]) if cut else 0
                to = max(cut + 1, int(np.searchsorted(ends, before + segment_tokens, "right")))
                first, last = offsets[cut], offsets[to]
                each = size[codes[first:last]]
                own = np.full(int(ends[to - 1]) - before, end_id, np.uint32)
                body = np.ones(len(own), bool)
                body[ends[cut:to] - before - 1] = False
                src = np.repeat(at[codes[first:last]] - upto[first:last] + upto[first], each)
                src += np.arange(len(src))
                own[body] = ids[src]
                yield pa.record_batch(
                    [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(own)], pa.int64()), pa.array([b.column("doc_id").slice(cut, to - cut).to_pylist()], pa.list_(pa.int64())), pa.array([ends[cut:to] - before], pa.list_(pa.int64())), pa.array([pack_ids(own)], pa.binary())],
                    names=["part", "seq", "n_tokens", "doc_ids", "ends", "codes"],
                )
                cut, seq = to, seq + 1

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, SEGMENT).write.option("compression", "none").parquet(out)


def read_files(spark, out: str) -> DataFrame:
    """The segments below `out`."""
    return spark.read.schema(SEGMENT).parquet(out)


def decode_digests(segments: DataFrame) -> DataFrame:
    """From the segments: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, ids, ends, codes in zip(*(b.column(c).to_pylist() for c in ("part", "seq", "doc_ids", "ends", "codes")), strict=True):
                stream = PackedIds(codes).all().astype("<u4")
                starts = [0, *ends[:-1]]
                crc = [zlib.crc32(stream[s:e]) for s, e in zip(starts, ends, strict=True)]
                yield pa.record_batch({"part": pa.array([part] * len(ids), pa.int32()), "seq": pa.array([seq] * len(ids), pa.int32()), "doc_id": pa.array(ids, pa.int64()), "local": pa.array(starts, pa.int64()), "n_tokens": pa.array(np.diff(ends, prepend=0), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    each = segments.select("part", "seq", "doc_ids", "ends", "codes").mapInArrow(decode, "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long")
    # Sums before each segment: within a part by window, and over the parts, of which there are as many as tasks wrote.
    sizes = segments.select("part", "seq", "n_tokens")
    inside = sizes.withColumn("inside", F.sum("n_tokens").over(W.partitionBy("part").orderBy("seq")) - F.col("n_tokens")).drop("n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    starts = inside.join(parts, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("base"))
    return each.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
