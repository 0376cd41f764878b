"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The pieces of a public model span a lattice over each text. Forward filtering sums, at each place, the
weights of all ways to reach it; backward sampling then draws pieces from the end, each in proportion to
the share of its ways. Draws come from a counter hashed with the row's key, so a row's sample is the same
in any batch, task or retry; another `seed` gives another sample.

The model's merges rank its pieces; a piece weighs 1 / (rank + 2) ** sharpness. A space is the piece
character U+2581, which no piece has after another character, so runs of spaces with what follows
are units, sampled apart exactly; each distinct unit's lattice is built once a batch. Characters
without a piece, U+2581 itself too, go byte by byte, so decoding gives back every text.

Edge cases: null gives null ids, the empty text none. Equal rows get equal samples.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

BASE = np.uint64(0x100000001B3)
PREFIX_BITS = 22
SCALE = 2.3  # of a byte's weight, which keeps sums of short units near 1 and changes no share
#: Bytes up to which a unit's ways are summed as they are; beyond, in logarithms.
SHORT = 64
LATTICE_BYTES = 1 << 19  # of units whose lattices are built at once
UNITS = 1 << 17  # that are drawn for at once
_loaded: dict[tuple, "Pieces"] = {}


class Pieces:
    """A model's pieces as bytes, their weights, and a lookup by length and hash."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.bytes = [b""] * size
        for i in plain:
            self.bytes[i] = model.id_to_piece(i).replace("▁", " ").encode()
        self.byte_id = np.zeros(256, np.int64)
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[value], self.bytes[i] = i, bytes([value])
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        self.log_weight = np.full(size, -sharpness * np.log(len(rank) + 2.0))
        for i, k in rank.items():
            self.log_weight[i] = -sharpness * np.log(k + 2.0)
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(self.bytes[i]) for i in plain}):
            own = [i for i in plain if len(self.bytes[i]) == n]
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * BASE + np.array([self.bytes[i][k] + 1 for i in own], np.uint64)
            order = np.argsort(h)
            self.by_size[n] = h[order], np.array(own)[order]
        self.prefix = np.zeros(1 << PREFIX_BITS, bool)  # by hash: whether a piece begins so
        for i in plain:
            h = 0
            for c in self.bytes[i]:
                h = (h * int(BASE) + c + 1) & 0xFFFFFFFFFFFFFFFF
                self.prefix[h >> (64 - PREFIX_BITS)] = True
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        edge = set("".join(model.id_to_piece(i) for i in plain))
        self.has_newline = "\n" in edge


def pieces(path: str, sharpness: float) -> Pieces:
    if (path, sharpness) not in _loaded:
        _loaded[path, sharpness] = Pieces(path, sharpness)
    return _loaded[path, sharpness]


def units(texts: list[bytes], split_lines: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct units): text i consists of units[codes[offsets[i]:offsets[i + 1]]]."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    cut = np.zeros(len(flat) + 1, bool)
    if len(flat):
        space = flat == 32
        cut[1:-1] = space[1:] & ~space[:-1]
        if split_lines:
            line = flat == 10
            cut[:-1] |= line
            cut[1:] |= line
    cut[first] = True
    at = np.flatnonzero(cut)
    offsets = np.searchsorted(at, first)
    array = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
    coded = array.dictionary_encode()
    return offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


CHAR_SIZE = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)


def edges_by_size(flat: np.ndarray, first: np.ndarray, model: Pieces):
    """(size, places where an edge ends, ids) for each size that an edge of some unit has, single bytes as size 1 at last.

    A place is a byte's end, numbered as the byte. A place stays in the search while some piece begins like it.
    """
    n = len(flat)
    stop = np.repeat(first[1:], np.diff(first)).astype(np.int32)
    lead = np.flatnonzero(CHAR_SIZE[flat] > 0).astype(np.int32)
    size = np.minimum(CHAR_SIZE[flat[lead]], stop[lead] - lead)
    covered = np.zeros(n, bool)  # by the first byte: characters that are pieces
    value = flat.astype(np.uint64) + np.uint64(1)
    live, left, h = lead, stop[lead] - lead, np.zeros(len(lead), np.uint64)
    full = np.zeros(n, np.int8)
    full[lead] = size
    for s in range(1, max(model.by_size) + 1):
        inside = left >= s
        live, left, h = live[inside], left[inside], h[inside]
        h = h * BASE + value[live + (s - 1)]
        may = model.prefix[(h >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)]
        live, left, h = live[may], left[may], h[may]
        if not len(live):
            break
        if s in model.by_size:
            known, own = model.by_size[s]
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            found = live[hit]
            if s <= 4:
                covered[found[full[found] == s]] = True
            yield s, found + (s - 1), own[at[hit]]
    bare = np.flatnonzero((full > 0) & ~covered)
    for k in range(4):
        own = bare[full[bare] > k] + k
        if len(own):
            yield 1, own, model.byte_id[flat[own]]


def lattice(flat: np.ndarray, first: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units in `flat`, from first[k] to first[k + 1]: (first edge of each place, limits, ids, sizes).

    A place's edges follow one another; limits are upper ends of their shares of the ways that reach the
    place, in 2**-32. A unit's figures depend on the unit alone.
    """
    n = len(flat)
    found = list(edges_by_size(flat, first, model))
    count = np.zeros(n, np.int32)
    nth = []
    for _, ends, _ in found:
        nth.append(count[ends])
        count[ends] += 1
    rank = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    order = np.argsort(rank.astype(np.int32), kind="stable")
    first_edge = np.zeros(n, np.int64)
    upto = np.concatenate([[0], np.cumsum(count[order])])
    first_edge[order] = upto[:-1]
    total = int(upto[-1])
    ids, sizes, end = np.zeros(total, np.int32), np.zeros(total, np.int16), np.zeros(total, np.int32)
    for (s, ends, own), k in zip(found, nth, strict=True):
        at = first_edge[ends] + k
        ids[at], sizes[at], end[at] = own, s, ends
    ways, alpha = np.zeros(total), np.zeros(n)
    log = n and int(np.diff(first).max()) > SHORT
    weight = model.log_weight[ids] if log else np.exp(model.log_weight[ids] + SCALE * sizes)
    stops = np.searchsorted(rank[order], np.arange(int(rank.max()) + 2 if n else 1))
    for t in range(len(stops) - 1):
        own = order[stops[t] : stops[t + 1]]
        own = own[count[own] > 0]
        if not len(own):
            continue
        a, z = first_edge[own[0]], first_edge[own[-1]] + count[own[-1]]
        begins = sizes[a:z] == t + 1
        from_ = np.where(begins, 0, end[a:z] - sizes[a:z])
        if log:
            ways[a:z] = weight[a:z] + np.where(begins, 0.0, np.where(count[from_] > 0, alpha[from_], -np.inf))
            top = np.maximum.reduceat(ways[a:z], first_edge[own] - a)
            top = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                alpha[own] = np.log(np.add.reduceat(np.exp(ways[a:z] - np.repeat(top, count[own])), first_edge[own] - a)) + top
        else:
            ways[a:z] = weight[a:z] * np.where(begins, 1.0, alpha[from_])
            alpha[own] = np.add.reduceat(ways[a:z], first_edge[own] - a)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.nan_to_num(np.exp(ways - alpha[end]) if log else ways / alpha[end])
    for k in range(1, int(count.max(initial=0))):  # sums within a place, edge by edge
        at = first_edge[count > k] + k
        share[at] += share[at - 1]
    limits = np.where(share > 1 - 1e-12, 2.0**32, share * 2.0**32).astype(np.uint64)
    return first_edge, limits, ids, sizes


def _draw(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(32)


def sample(texts: list[bytes], keys: np.ndarray, model: Pieces) -> list[np.ndarray]:
    """The sampled ids of each text; keys: a 64-bit key for each."""
    offsets, codes, distinct = units(texts, not model.has_newline)
    first = np.concatenate([[0], np.cumsum([len(u) for u in distinct.to_pylist()])]).astype(np.int64)
    flat = np.frombuffer(b"".join(distinct.to_pylist()), np.uint8)
    length = np.diff(first)
    by_length = np.argsort(length > SHORT, kind="stable")  # long units apart, as they are summed in another way
    n_short = int((length <= SHORT).sum())
    parts, edges, at = [], 0, 0
    start_of = np.zeros(len(distinct) + 1, np.int64)
    placed = np.concatenate([[0], np.cumsum(length[by_length])])
    start_of[by_length] = placed[:-1]
    flat = flat[np.repeat(first[by_length] - placed[:-1], length[by_length]) + np.arange(len(flat))]
    while at < len(distinct):
        stop = n_short if at < n_short else len(distinct)
        to = min(stop, max(at + 1, int(np.searchsorted(placed, placed[at] + LATTICE_BYTES, "right")) - 1))
        e, *rest = lattice(flat[placed[at] : placed[to]], placed[at : to + 1] - placed[at], model)
        parts.append((e + edges, *rest))
        edges += len(rest[0])
        at = to
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int16))
    first_edge, limits, edge_ids, edge_sizes = (np.concatenate(x) for x in zip(empty, *parts, strict=True))
    nth = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    seed = np.repeat(keys.astype(np.uint64), np.diff(offsets)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ids, taken = [], np.zeros(len(codes) + 1, np.int64)
    for a in range(0, len(codes), UNITS):  # drawn for a bounded number of units at once
        own, n = _drawn(seed[a : a + UNITS], start_of[codes[a : a + UNITS]], length[codes[a : a + UNITS]], first_edge, limits, edge_ids, edge_sizes)
        ids.append(own)
        taken[a + 1 : a + 1 + len(n)] = n
    out = np.concatenate([np.zeros(0, np.int32), *ids])
    bounds = np.cumsum(taken)[offsets]
    return [out[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _drawn(seed, begin, size, first_edge, limits, edge_ids, edge_sizes) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all units in order, ids of each): backward from each unit's end, a step of all units at a time."""
    where = begin + size
    active, drawn, taken = np.arange(len(seed), dtype=np.int32), [], np.zeros(len(seed), np.int32)
    while len(active):
        u = _draw(seed[active] + taken[active].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        e = first_edge[where[active] - 1]
        over = np.flatnonzero(u >= limits[e])
        while len(over):
            e[over] += 1
            over = over[u[over] >= limits[e[over]]]
        drawn.append((active, edge_ids[e]))
        where[active] -= edge_sizes[e]
        taken[active] += 1
        active = active[where[active] > begin[active]]
    upto = np.concatenate([[0], np.cumsum(taken, dtype=np.int64)])
    out = np.zeros(upto[-1], np.int32)
    for step, (own, ids) in enumerate(drawn):
        out[upto[own + 1] - 1 - step] = ids
    return out, taken


def decode(ids: np.ndarray, model: Pieces) -> bytes:
    """The bytes that the pieces spell."""
    size = model.size[ids]
    at = np.arange(size.sum()) + np.repeat(model.start[ids] - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(ids) else size, size)
    return model.flat[at].tobytes()


def encode(docs: DataFrame, path: str, sharpness: float = 1.0, seed: int = 0, batch_bytes: int = 1 << 22) -> DataFrame:
    """`docs` with `ids` (little-endian 16-bit or, for larger models, 32-bit integers), n_pieces, ids_crc32 (of 32-bit
    integers) and lossless: whether decoding the ids gave back the text. Columns of these four names that `docs` has are replaced."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, sharpness)
        kind = "<u2" if len(model.bytes) <= 1 << 16 else "<u4"
        for b in batches:
            at = 0
            size = [len(t.as_buffer()) if t.is_valid else 0 for t in b.column("text")]
            while at < b.num_rows:
                to, total = at, 0
                while to < b.num_rows and (to == at or total + size[to] <= batch_bytes):
                    total += size[to]
                    to += 1
                part = b.slice(at, to - at)
                at = to
                raw = part.column("text").to_pylist()
                texts = [(t or "").encode() for t in raw]
                got = sample(texts, part.column(seed_name).to_numpy().view(np.uint64), model)
                none = np.array([t is None for t in raw])
                own = {
                    "ids": pa.array([None if x else g.astype(kind).tobytes() for g, x in zip(got, none, strict=True)], pa.binary()),
                    "n_pieces": pa.array([len(g) for g in got], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(g.astype("<u4")) for g in got], pa.int64()),
                    "lossless": pa.array([decode(g, model) == t for g, t in zip(got, texts, strict=True)], pa.bool_()),
                }
                yield pa.record_batch({n: part.column(n) for n in names} | own)

    (seed_name,) = unused(docs, "seed")
    names = [c for c in docs.columns if c not in ("ids", "n_pieces", "ids_crc32", "lossless")]
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names, key.alias(seed_name)).mapInArrow(each, f"{kept}, ids binary, n_pieces long, ids_crc32 long, lossless boolean")
