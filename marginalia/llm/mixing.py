"""Logistic context mixing over hashed contexts, bit by bit.

A symbol is coded along a Huffman path of bits. For each bit several predictors look up how often it was 0 and 1 under
a hash of their context and the path so far; a set of weights, chosen by how much the longest contexts have been seen
(the gate), mixes them in the logistic domain; an adaptive table then refines the mix by its gate. At each node the
chances of both bits sum to one, so the symbols of a context are a distribution.

A model is learnt from every row given: tasks count the bits of their rows into slots, whose sums go back to all; then
shards of rows, each a bounded number in the order of their hashes, learn weights online, each row with itself taken out
of the counts. Slots are whole numbers, and rows belong to shards by their hash, so a model does not depend on
partitions or retries.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

GATES, REFINED = 96, 33
BLOCK, PIECE = 1 << 13, 1 << 10
#: Rows that a shard learns from at most, about: its memory and its time.
SHARD_ROWS = 1 << 18
#: Symbols that are worked on at once: what keeps their arrays in a core's cache.
PASS = 1 << 15

U32 = np.uint32
ODD = U32(0x9E3779B1)

#: (contexts: predictor, symbol; the symbols; how often each occurred, as whole 64-bit numbers)
Events = tuple[np.ndarray, np.ndarray, np.ndarray]


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U32(15))) * U32(0x85EBCA77)
    return x ^ (x >> U32(13))


class Code:
    """A Huffman code: the nodes and bits on each symbol's path, step by step.

    With `groups`, each group of symbols has a tree of its own: a symbol is told within its group, and one that is alone in it by no bit.
    """

    def __init__(self, counts: np.ndarray, groups: np.ndarray | None = None):
        paths, nodes = {}, count()
        by_group = np.argsort(np.zeros(len(counts)) if groups is None else groups, kind="stable")
        cuts = [] if groups is None else np.flatnonzero(np.diff(groups[by_group])) + 1
        for members in np.split(by_group, cuts):
            order, least = count(), counts[members].sum() / (1 << 14) + 1  # a floor, which bounds the paths
            heap = [(max(float(counts[s]), float(least)), next(order), s) for s in members.tolist()]
            heapq.heapify(heap)
            while len(heap) > 1:
                a, b = heapq.heappop(heap), heapq.heappop(heap)
                heapq.heappush(heap, (a[0] + b[0], next(order), (a[2], b[2])))
            todo = [(heap[0][2], [])] if heap else []
            while todo:
                tree, path = todo.pop()
                if isinstance(tree, int):
                    paths[tree] = path
                    continue
                own = next(nodes)
                todo += [(tree[bit], [*path, (own, bit)]) for bit in (0, 1)]
        self.length = np.array([len(paths[s]) for s in range(len(counts))], np.int64)
        self.rank = (self.length.max(initial=0) - self.length).astype(np.uint8)  # longest first; bytes sort fast
        self.node = np.zeros((self.length.max(initial=0), len(counts)), np.int64)
        self.bit = np.zeros(self.node.shape, np.int64)
        for s, path in paths.items():
            for t, (own, bit) in enumerate(path):
                self.node[t, s], self.bit[t, s] = own, bit
        self.key = stirred((np.arange(len(counts), dtype=U32) + U32(1)) * ODD)

    def steps(self, contexts: np.ndarray, symbols: np.ndarray, slot_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(symbols' places, bits, slots by predictor) for each step on the paths; long paths come first throughout."""
        order = np.argsort(self.rank[symbols], kind="stable")
        symbols, contexts = symbols[order], contexts[:, order]
        size, shift = self.length[symbols], U32(32 - slot_bits)
        for t in range(int(size.max(initial=0))):
            own = symbols[: np.searchsorted(-size, -t, "left")]
            key = self.key[self.node[t][own]]
            slots = [(((c[: len(own)] ^ key) * ODD) >> shift).astype(np.int64) for c in contexts]
            yield order[: len(own)], self.bit[t][own], slots


class Mixer:
    """What predicts a bit: a table by slot for each predictor, weights by gate and the refining table.

    `counts` (predictor, slot, bit); with `apart`, tables are by slot and bit, each with one occurrence of the bit taken out.
    """

    def __init__(self, code: Code, counts: np.ndarray, apart: bool = False, weights: np.ndarray | None = None, refine: np.ndarray | None = None):
        self.code, self.slot_bits, self.apart = code, int(counts.shape[1]).bit_length() - 1, apart
        predictors, inputs = len(counts), len(counts) + 2
        self.leaning = np.empty((predictors, counts.shape[1] * (2 if apart else 1)), np.float32)
        levels = []
        for k, (n0, n1) in enumerate((c[:, 0], c[:, 1]) for c in counts):  # one at a time, as the tables are large
            if apart:
                n0, n1 = np.stack([np.maximum(n0 - 1, 0), n0], 1).ravel(), np.stack([n1, np.maximum(n1 - 1, 0)], 1).ravel()
            self.leaning[k] = np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))
            if k >= predictors - 2:
                levels.append(np.minimum(np.log2(n0 + n1 + 1), 11).astype(np.uint8))
        self.trusting = np.log((n1 + np.float32(0.02)) / (n0 + np.float32(0.02)))  # the longest context, trusted more
        self.seen = np.stack([np.minimum(levels[0] // 3, 3), (levels[1] * 2 + (np.minimum(n0, n1) == 0)) * 4]).astype(np.uint8)
        self.weights = np.full((GATES, inputs), 1.0 / predictors) if weights is None else weights
        self.refine = np.zeros((REFINED, GATES, 2)) if refine is None else refine
        self.curve = np.repeat(np.eye(inputs)[None] * 20.0, GATES, 0)  # what has been seen of the loss's curvature

    def steps(self, contexts: np.ndarray, symbols: np.ndarray):
        """(places, bits, inputs by row, gates) for each step."""
        for places, bit, slots in self.code.steps(contexts, symbols, self.slot_bits):
            at = [s * 2 + bit for s in slots] if self.apart else slots
            inputs = np.empty((len(at) + 2, len(bit)), np.float32)
            for k, own in enumerate(at):
                np.take(self.leaning[k], own, out=inputs[k], mode="clip")
            np.take(self.trusting, at[-1], out=inputs[-2], mode="clip")
            inputs[-1] = 0.3
            yield places, bit, inputs, self.seen[0].take(at[-2]) + self.seen[1].take(at[-1])

    def mixed(self, inputs: np.ndarray, gate: np.ndarray) -> np.ndarray:
        weights, at = self.weights.astype(np.float32).T.copy(), gate.astype(np.int64)
        total = weights[0].take(at) * inputs[0]
        for w, x in zip(weights[1:], inputs[1:], strict=True):
            total += w.take(at) * x
        return np.clip(total, -14, 14)

    def place(self, x: np.ndarray) -> np.ndarray:
        return np.rint((x + 14) * np.float32((REFINED - 1) / 28)).astype(np.int64)

    def chance(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """That the bit is 1, refined."""
        p = 1 / (1 + np.exp(-x))
        share = 0.5 / (self.refine.sum(2) + 30)
        ones, at = (self.refine[:, :, 1] * share).astype(np.float32).ravel(), self.place(x) * GATES + gate
        return np.clip(p * (np.float32(0.5) + 30 * share.astype(np.float32).ravel().take(at)) + ones.take(at), np.float32(1e-6), np.float32(1 - 1e-6))

    def learn(self, contexts: np.ndarray, symbols: np.ndarray, times: np.ndarray) -> None:
        """Online: mix, refine, correct the weights by a Newton step on the curvature so far."""
        for places, bit, inputs, gate in self.steps(contexts, symbols):
            x, n = self.mixed(inputs, gate), times[places].astype(np.float32)
            p = 1 / (1 + np.exp(-x))
            self.refine += np.bincount((self.place(x) * GATES + gate) * 2 + bit, n, self.refine.size).reshape(self.refine.shape)
            order = np.argsort(gate, kind="stable")
            cuts = np.searchsorted(gate[order], np.arange(GATES + 1))
            rows, bend, slope = inputs[:, order], (p * (1 - p) * n)[order], ((bit - p) * n)[order]
            total = np.zeros(self.weights.shape)
            for g in np.flatnonzero(np.diff(cuts)):
                own = slice(cuts[g], cuts[g + 1])
                self.curve[g] += (rows[:, own] * bend[own]) @ rows[:, own].T
                total[g] = rows[:, own] @ slope[own]
            self.weights += np.clip(np.linalg.solve(self.curve, total[:, :, None])[:, :, 0], -0.5, 0.5)

    def log10(self, contexts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The log10 probability of each symbol in its contexts."""
        out = np.zeros(len(symbols))
        for places, bit, inputs, gate in self.steps(contexts, symbols):
            p = self.chance(self.mixed(inputs, gate), gate)
            out[places] += np.log10(np.where(bit == 1, p, 1 - p))
        return out


def _sum(group: pd.DataFrame, kind: type) -> pd.DataFrame:
    """The sum of a block's arrays over the tasks or shards they come from, in their order, as numbers of a kind."""
    group = group.sort_values("part")
    total = sum(np.frombuffer(x, own).astype(np.float64) for x, own in zip(group["n"], group["kind"], strict=True))
    return pd.DataFrame({"block": group["block"].iloc[:1], "n": [total.astype(kind).tobytes()]})


def _blocks(arrays: np.ndarray, size: int, part: int, whole: bool = False, first: int = 0) -> pa.RecordBatch:
    """The rows of an array cut into blocks, numbered from `first` on, empty ones left out but if `whole`."""
    flat = arrays.ravel()
    rows = np.pad(flat, (0, -len(flat) % size)).reshape(-1, size)
    picked = np.arange(len(rows)) if whole else np.flatnonzero(rows.any(1))
    return pa.record_batch(
        {
            "part": pa.array(np.full(len(picked), part), pa.int64()),
            "block": pa.array(picked + first, pa.int64()),
            "kind": pa.array([rows.dtype.str] * len(picked), pa.string()),
            "n": pa.array([rows[i].tobytes() for i in picked], pa.binary()),
        }
    )


BLOCKS = "part long, block long, kind string, n binary"


def _summed(blocks: DataFrame, size: int, length: int, kind: type = np.float64) -> np.ndarray:
    """Blocks summed in tasks, one small group each, and brought together: an array of a given size and kind."""
    rows = blocks.groupBy("block").applyInPandas(lambda group: _sum(group, kind), "block long, n binary").toArrow()
    out = np.zeros(-(-length // size) * size, kind)
    for i, n in zip(rows.column("block").to_pylist(), rows.column("n"), strict=True):
        out[i * size : (i + 1) * size] = np.frombuffer(n.as_buffer(), kind)
    return out[:length]


def tallied(events: Iterator[Events], code: Code, predictors: int, slot_bits: int) -> np.ndarray:
    """How often each bit occurred in each slot (predictor, slot and bit): 32-bit numbers as long as they hold the sum of all."""
    table, total = np.zeros((predictors, 2 << slot_bits), U32), 0
    for contexts, symbols, times in events:
        total += int(times.sum())
        if table.dtype == U32 and total >= 1 << 32:
            table = table.astype(np.int64)
        for places, bit, slots in code.steps(contexts, symbols, slot_bits):
            n = times[places].astype(table.dtype)
            for k, s in enumerate(slots):
                np.add.at(table[k], s * 2 + bit, n)
    return table


def learn_model(
    rows: DataFrame, events: Callable[[pa.RecordBatch], Iterator[Events]], code: Code, predictors: int, slot_bits: int, size: int | None = None
) -> Mixer:
    """The mixer learnt from `rows` (`size` of them, if known), which have a hash `key` and what `events` makes contexts and symbols of.

    What comes to the driver and goes to the tasks is of the size that `slot_bits` gives, whatever the rows.
    """
    sc = rows.sparkSession.sparkContext
    shards = max(1, -(-(rows.count() if size is None else size) // SHARD_ROWS))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        table = tallied((e for b in batches for e in events(b)), code, predictors, slot_bits)
        for k, own in enumerate(table):  # one at a time, as the tables are large
            yield _blocks(own, BLOCK, TaskContext.get().partitionId(), first=k * len(own) // BLOCK)

    total = _summed(rows.coalesce(max(6, shards)).mapInArrow(tally, BLOCKS), BLOCK, predictors * (2 << slot_bits), np.float32)
    total = total.reshape(predictors, -1, 2)
    counts = sc.broadcast(total)
    inputs = predictors + 2

    def fit(group: pa.Table) -> pa.Table:
        give_back()
        group = group.sort_by("key").combine_chunks()
        own = Mixer(code, counts.value, apart=True)
        for b in group.to_batches():
            for contexts, symbols, times in events(b):
                own.learn(contexts, symbols, times)
        pull = own.curve @ own.weights[:, :, None]
        learnt = np.concatenate([own.curve.ravel(), pull.ravel(), own.refine.ravel()])
        return pa.Table.from_batches([_blocks(learnt, PIECE, group.column("shard")[0].as_py(), whole=True)])

    sharded = rows.withColumn("shard", F.pmod("key", F.lit(shards)))
    learnt = _summed(sharded.groupBy("shard").applyInArrow(fit, BLOCKS), PIECE, GATES * inputs * (inputs + 1) + REFINED * GATES * 2)
    counts.destroy()
    curve, pull, refine = np.split(learnt, [GATES * inputs * inputs, GATES * inputs * (inputs + 1)])
    if not curve.any():
        return Mixer(code, total)
    # Each shard's weights count as far as it has seen them bend.
    weights = np.linalg.solve(curve.reshape(GATES, inputs, inputs), pull.reshape(GATES, inputs, 1))[:, :, 0]
    return Mixer(code, total, weights=weights, refine=refine.reshape(REFINED, GATES, 2))
