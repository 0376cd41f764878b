"""Document quality by attention over passages: multiple-instance learning.

A text is a bag of passages of 64 words. Each passage is encoded: shares of pairs of byte classes, of word lengths and of
short words by hash, how many words repeat the one before, how many are distinct; then a dense layer. Gated attention (tanh times
sigmoid) gives each passage a weight, the weights of a document add up to 1, and the weighted sum of the encodings is scored. Only documents
are labelled, so what the weights look at is learnt from those labels alone.

All is fitted on the driver on a bounded sample: up to `most_docs` labelled documents in the order of a hash of their id, up to
`most_passages` passages of each, evenly spread. Scoring reads every passage of every text. A text of over PIECE bytes is read piece by piece,
the weighted sums being put together as they come.

Edge cases: null, empty and blank texts are one passage without words. A document without an id counts as held out. Repeated rows are scored each;
in the sample one row stands for an id, with the mean of its labels. Labels other than 0 and 1 are left out. With no label, or labels
of one kind only, the score is their mean for all (0.5 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import slices, split_words

PASSAGE = 64  # words
PIECE = 1 << 22  # bytes
SHORT, BUCKETS = 4, 64  # short words in bytes, and the buckets they are hashed to
LENGTHS = np.array([2, 3, 4, 6, 9, 13])  # word lengths in bytes that begin a new share

# Classes of bytes: space, line end, small and capital letters, digits, then groups of signs; the last is everything beyond ASCII.
GROUPS = [" \t\x0b\x0c\r", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",", "|", "#$%&*<>", "!?", ":;-_/+=@^~\\`", "\"'()[]{}"]
CLASS = np.full(256, len(GROUPS), np.int64)
for number, signs in enumerate(GROUPS):
    CLASS[[ord(c) for c in signs]] = number
CLASSES = len(GROUPS) + 1
WIDTH = CLASSES**2 + len(LENGTHS) + 1 + BUCKETS + 4


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, first): a row for each passage; the passages of text i begin at first[i]."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets, codes, words = split_words(texts, lower=True)
    count = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(np.maximum(1, -(-count // PASSAGE)))])
    n, doc = int(first[-1]), np.repeat(np.arange(len(count)), count)
    passage = first[doc] + (np.arange(len(codes)) - offsets[doc]) // PASSAGE
    size = np.maximum(np.bincount(passage, minlength=n), 1)

    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    kind, begins = CLASS[raw], np.zeros(len(raw) + 1, bool)
    begins[bounds - bounds[0]] = True
    before = np.concatenate([[1], kind[:-1]]) if len(raw) else kind
    before[begins[:-1]] = 1  # a text begins like a line
    starts = (kind > 1) & ((before <= 1) | begins[:-1])
    owner = np.repeat(np.arange(len(count)), np.diff(bounds))
    at = np.clip(np.cumsum(starts) - 1, offsets[owner], np.maximum(offsets[owner + 1] - 1, 0))  # blanks go with the word before
    held = np.append(passage, n - 1)[np.minimum(at, len(passage))] if len(passage) else first[owner]
    held = np.where(count[owner] > 0, held, first[owner])
    pairs = np.bincount(held * CLASSES**2 + before * CLASSES + kind, minlength=n * CLASSES**2).reshape(n, -1)
    pairs = np.sqrt(pairs / np.maximum(pairs.sum(1, keepdims=True), 1))

    length = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.searchsorted(LENGTHS, length, "right")
    lengths = np.bincount(passage * (len(LENGTHS) + 1) + step[codes], minlength=n * (len(LENGTHS) + 1)).reshape(n, -1) / size[:, None]
    short, bucket = np.flatnonzero(length <= SHORT), np.full(len(words), -1)
    bucket[short] = [zlib.crc32(w.encode()) % BUCKETS for w in words.take(pa.array(short)).to_pylist()]
    own = bucket[codes] >= 0
    bag = np.sqrt(np.bincount(passage[own] * BUCKETS + bucket[codes[own]], minlength=n * BUCKETS).reshape(n, -1) / size[:, None])
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (passage[1:] == passage[:-1])
    kinds = np.unique(passage * max(len(words), 1) + codes) // max(len(words), 1)
    rest = [np.bincount(passage[again], minlength=n) / size, np.bincount(kinds, minlength=n) / size, size / PASSAGE, np.repeat(np.log1p(count) / 10, np.diff(first))]
    return np.hstack([pairs, lengths, bag, np.column_stack(rest)]).astype(np.float32), first[:-1]


def split_long(text: str | None) -> list[str]:
    """A text in pieces of about PIECE bytes, cut at a blank where there is one in reach."""
    raw, out, at = (text or "").encode(), [], 0
    while len(raw) - at > PIECE:
        cut = max(raw.rfind(b" ", at + PIECE // 2, at + PIECE), raw.rfind(b"\n", at + PIECE // 2, at + PIECE))
        cut = cut if cut > at else at + PIECE
        out.append(raw[at:cut].decode(errors="ignore"))
        at = cut
    return [*out, raw[at:].decode(errors="ignore")]


def bags_of(texts: pa.Array) -> list[np.ndarray]:
    """The passages of each text; long ones by their pieces."""
    pieces = [split_long(t) for t in texts.to_pylist()]
    x, first = features(pa.array([p for own in pieces for p in own], pa.string()))
    begin = np.append(first, len(x))[np.concatenate([[0], np.cumsum([len(own) for own in pieces])])]
    return [x[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]


@dataclass
class Model:
    """The layers' weights, or `constant` where nothing could be learnt."""

    layers: dict[str, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    constant: float | None = None

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(encodings, attention logits) of passages."""
        p = self.layers
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]

    def pooled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(greatest logit, sum of weights, weighted sum, passages) of each text; weights are relative to the greatest."""
        x, first = features(texts)
        h, e = self.encoded(x)
        n = np.diff(np.append(first, len(e)))
        top = np.maximum.reduceat(e, first)
        a = np.exp(e - np.repeat(top, n))
        return top, np.add.reduceat(a, first), np.add.reduceat(a[:, None] * h, first, axis=0), n

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, passages, weight of the heaviest passage) of each text."""
        long = np.flatnonzero(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) > PIECE)
        held = pc.if_else(pa.array(np.isin(np.arange(len(texts)), long)), "", texts)
        top, total, z, n = self.pooled(held)
        for i in long:
            pieces = [self.pooled(pa.array([t])) for t in split_long(texts[int(i)].as_py())]
            best = max(m[0] for m, *_ in pieces)
            factor = [np.exp(m[0] - best) for m, *_ in pieces]
            total[i] = sum(f * s[0] for f, (_, s, _, _) in zip(factor, pieces, strict=True))
            z[i] = sum(f * v[0] for f, (_, _, v, _) in zip(factor, pieces, strict=True))
            n[i] = sum(k[0] for *_, k in pieces)
        if self.constant is not None:
            return np.full(len(n), self.constant), n, 1 / total
        return 1 / (1 + np.exp(-((z / total[:, None]) @ self.layers["c"] + self.layers["d"]))), n, 1 / total


def train(bags: list[np.ndarray], labels: np.ndarray, width: int = 32, gate: int = 16, epochs: int = 16, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Model:
    """Fits all layers together to the labels of bags of passages, by Adam on the logistic loss."""
    r = np.random.default_rng(seed)
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH), np.float32)
    mean, scale = (x.mean(0), x.std(0) + 0.05) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    shapes = {"W": (WIDTH, width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": ()}
    p = {k: (r.normal(0, shape[0] ** -0.5, shape) if len(shape) else np.zeros(shape)) * (k not in "bd") for k, shape in shapes.items()}
    if not len(labels) or labels.min() == labels.max():
        return Model(p, mean, scale, float(labels.mean()) if len(labels) else 0.5)
    x = (x - mean) / scale
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    m, v, step = {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}, 0
    sigmoid = lambda t: 1 / (1 + np.exp(-t))
    for epoch in range(epochs):
        order = r.permutation(len(bags))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            n = first[own + 1] - first[own]
            at = np.concatenate([np.arange(first[k], first[k + 1]) for k in own])
            cuts, bag = np.concatenate([[0], np.cumsum(n)[:-1]]), np.repeat(np.arange(len(own)), n)
            h = np.tanh(x[at] @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
            e = (t * s) @ p["w"]
            a = np.exp(e - np.maximum.reduceat(e, cuts)[bag])
            a /= np.add.reduceat(a, cuts)[bag]
            z = np.add.reduceat(a[:, None] * h, cuts, axis=0)
            off = (sigmoid(z @ p["c"] + p["d"]) - labels[own]) / len(own)
            dz = off[:, None] * p["c"]
            da = (dz[bag] * h).sum(1)
            de = a * (da - np.add.reduceat(a * da, cuts)[bag])
            dts = de[:, None] * p["w"]
            dv, du = dts * s * (1 - t**2), dts * t * s * (1 - s)
            dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
            dw = dh * (1 - h**2)
            g = {"W": x[at].T @ dw, "b": dw.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * s).T @ de, "c": z.T @ off, "d": off.sum()}
            step += 1
            lr = rate * (1 - epoch / epochs)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - lr * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8) + decay * p[k])
    return Model({k: w.astype(np.float32) for k, w in p.items()}, mean.astype(np.float32), scale.astype(np.float32))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo the folds, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most_docs: int, most_passages: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(bags, labels) of labelled documents that are not held out."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.avg(label).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            out = []
            for x in bags_of(b.column("text")):
                picked = np.unique(np.linspace(0, len(x) - 1, min(len(x), most_passages)).astype(np.int64))
                out.append(x[picked].astype(np.float16).tobytes())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "key": b.column("key"), "y": b.column("y"), "bag": pa.array(out, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.withColumn("doc_id", F.col("doc_id").cast("long"))), "doc_id")
    bags = rows.select("doc_id", F.xxhash64("text").alias("key"), "y", "text").mapInArrow(each, "doc_id long, key long, y double, bag binary")
    found = bags.groupBy("doc_id").agg(F.min_by("bag", "key").alias("bag"), F.first("y").alias("y")).orderBy("doc_id").collect()
    return [np.frombuffer(r["bag"], np.float16).astype(np.float32).reshape(-1, WIDTH) for r in found], np.array([r["y"] for r in found], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_docs: int = 12_000, most_passages: int = 64) -> Model:
    """A model learnt from up to `most_docs` labelled documents that are not held out, `most_passages` passages of each."""
    return train(*sample(docs, labels, label, most_docs, most_passages))


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, most_weight) of every document; most_weight is that of its heaviest passage."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            s, n, top = shared.value.scores(b.column("text"))
            told = {"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": s.astype(np.float64)}
            yield pa.record_batch(told | {"predicted": (s >= least).astype(np.int32), "n_passages": n.astype(np.int64), "most_weight": top.astype(np.float64)})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int, n_passages long, most_weight double")
