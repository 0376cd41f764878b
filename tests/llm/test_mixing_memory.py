"""What learning takes: tables of 32 bits given out one at a time, equal bytes of equal contexts coded once, free memory given back."""

import subprocess
import sys
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from marginalia.llm import mixing, scoring


class Caught(Exception):
    pass


class Rows:
    """Rows whose first pass over Arrow batches is caught."""

    @property
    def sparkSession(self):
        return self

    sparkContext = sparkSession

    def count(self):
        return 1

    def coalesce(self, n):
        return self

    def mapInArrow(self, f, schema):
        raise Caught(f)


def tally(monkeypatch, events, predictors, slot_bits):
    import pyspark

    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: type("Task", (), {"partitionId": lambda self: 0})()))
    with pytest.raises(Caught) as caught:
        mixing.learn_model(Rows(), lambda b: iter(events), mixing.Code(np.array([2, 1])), predictors, slot_bits)
    return caught.value.args[0]


def test_a_task_holds_little_more_than_its_table(monkeypatch):
    contexts = np.random.default_rng(1).integers(0, 1 << 32, (4, 1 << 15), np.uint32)
    events = [(contexts, np.arange(1 << 15) % 2, np.ones(1 << 15, np.int64))]
    run = tally(monkeypatch, events, 4, 20)
    tracemalloc.start()
    total = 0
    for b in run(iter([None])):
        total += sum(int(np.frombuffer(n, kind).sum()) for n, kind in zip(b.column("n").to_pylist(), b.column("kind").to_pylist(), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == 4 << 15
    assert peak < 2 * (4 * (2 << 20) * 4)  # before: five times as much


def test_large_sums_take_64_bits(monkeypatch):
    events = [(np.zeros((2, 2), np.uint32), np.array([0, 1]), np.array([3 << 30, 1 << 30]))] * 5
    blocks = {}
    for b in tally(monkeypatch, events, 2, 12)(iter([None])):
        for k, kind, n in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "n")), strict=True):
            blocks[k] = np.frombuffer(n, kind)
    assert sorted(blocks) == [0, 1] and all(sorted(b[b > 0].tolist()) == [5 << 30, 15 << 30] for b in blocks.values())


def test_equal_bytes_of_equal_contexts_are_one_event():
    words = pa.array([f"{k}{stem}{end}" for k in "01" for stem in ("stand", "stan", "\0", "é") for end in ("", "ing", "ingstanding", "\0\0")])
    (_, contexts, symbols, _, _), *more = scoring.spelled(words)
    assert not more
    want = {}
    for e in zip(*contexts.tolist(), symbols.tolist(), strict=True):
        want[e] = want.get(e, 0) + 1
    ((c, s, n),) = scoring.spelled_events(pa.record_batch({"word": words}))
    got = dict(zip(zip(*c.tolist(), s.tolist(), strict=True), n.tolist(), strict=True))
    assert got == want and len(s) == len(want) < len(symbols) / 2


def test_words_have_the_sum_of_their_bytes():
    r = np.random.default_rng(2)
    code = mixing.Code(r.integers(1, 1000, 256))
    model = mixing.Mixer(code, r.integers(0, 50, (4, 1 << 12, 2)).astype(np.float32))
    words = pa.array([f"{r.integers(0, 5)}{''.join(r.choice(list('abc'), r.integers(0, 9)))}" for _ in range(300)])
    ((_, contexts, symbols, word, _),) = scoring.spelled(words)
    want = np.bincount(word, model.log10(contexts, symbols), len(words))
    assert np.allclose(scoring.spell_log10(words, model), want, rtol=1e-6)
    assert len(scoring.spell_log10(words[:0], model)) == 0


def test_free_memory_is_given_back():
    run = """
import re, numpy as np
from marginalia.llm.common import give_back
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024
arrays = [np.ones(12_000) for _ in range(1000)]
last, arrays = arrays[-1], None
before = held()
give_back()
print(before - held())
"""
    out = subprocess.run([sys.executable, "-c", run], capture_output=True, text=True, check=True)
    assert float(out.stdout.split()[-1]) > 60


def test_tasks_of_32_and_64_bits_are_summed():
    blocks = pd.DataFrame({"part": [1, 0], "block": [5, 5], "kind": ["<i8", "<u4"], "n": [np.array([1 << 33, 1]).tobytes(), np.array([2, 3], np.uint32).tobytes()]})
    got = mixing._sum(blocks, np.float32)
    assert np.frombuffer(got["n"].iloc[0], np.float32).tolist() == [float(1 << 33), 4.0]
