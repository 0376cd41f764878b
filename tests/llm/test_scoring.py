"""Scores by context mixing against a plain version of the whole model, and what makes its steps distributions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from marginalia.llm import mixing, registry, scoring
from tests.llm.test_operators import GAP, SCHEMA, clash, docs, none, rows  # noqa: F401

M = 0xFFFFFFFF
ODD = 0x9E3779B1


def stirred(x):
    x = (x ^ (x >> 15)) * 0x85EBCA77 & M
    return x ^ (x >> 13)


class Slow:
    """A mixer in plain loops over events (contexts, symbol, times), all in one pass."""

    def __init__(self, code, events, predictors, bits):
        self.code, self.bits, self.k = code, bits, predictors
        self.n = defaultdict(lambda: [0, 0])
        for ctx, s, times in events:
            for t in range(code.length[s]):
                for k, slot in enumerate(self.slots(ctx, s, t)):
                    self.n[k, slot][code.bit[t, s]] += times
        inputs = predictors + 2
        self.w = np.full((96, inputs), 1.0 / predictors)
        self.refine = np.zeros((33, 96, 2))
        curve = np.repeat(np.eye(inputs)[None] * 20.0, 96, 0)
        for t in range(max(code.length)):
            total = np.zeros(self.w.shape)
            seen = [self.inputs(ctx, s, t, True) + (code.bit[t, s], times) for ctx, s, times in events if code.length[s] > t]
            for x, gate, bit, times in seen:
                z = float(np.clip(self.w[gate] @ x, -14, 14))
                p = 1 / (1 + math.exp(-z))
                self.refine[self.place(z), gate, bit] += times
                curve[gate] += times * p * (1 - p) * np.outer(x, x)
                total[gate] += times * (bit - p) * x
            self.w = self.w + np.clip(np.linalg.solve(curve, total[:, :, None])[:, :, 0], -0.5, 0.5)

    def slots(self, ctx, s, t):
        key = int(self.code.key[self.code.node[t, s]])
        return [((c ^ key) * ODD & M) >> (32 - self.bits) for c in ctx]

    def place(self, z):
        return round((z + 14) * 32 / 28)

    def inputs(self, ctx, s, t, apart):
        x, seen = [], []
        for k, slot in enumerate(self.slots(ctx, s, t)):
            n = list(self.n.get((k, slot), (0, 0)))
            if apart:
                n[self.code.bit[t, s]] = max(0, n[self.code.bit[t, s]] - 1)
            x.append(math.log((n[1] + 0.4) / (n[0] + 0.4)))
            seen.append((min(int(math.log2(sum(n) + 1)), 11), int(min(n) == 0)))
        x += [math.log((n[1] + 0.02) / (n[0] + 0.02)), 0.3]
        return np.array(x), (seen[-1][0] * 2 + seen[-1][1]) * 4 + min(seen[-2][0] // 3, 3)

    def log10(self, ctx, s):
        out = 0.0
        for t in range(self.code.length[s]):
            x, gate = self.inputs(ctx, s, t, False)
            z = float(np.clip(self.w[gate] @ x, -14, 14))
            p, n = 1 / (1 + math.exp(-z)), self.refine[self.place(z), gate]
            p = min(max(0.5 * p + 0.5 * (n[1] + 30 * p) / (n.sum() + 30), 1e-6), 1 - 1e-6)
            out += math.log10(p if self.code.bit[t, s] else 1 - p)
        return out


def spelled(word):
    raw = word.encode() + b" "
    for i in range(1, len(raw)):
        h, ctx = raw[0], []
        for k in range(1, max(scoring.SPELL_ORDERS) + 1):
            h = stirred((h ^ ((raw[i - k] if i > k else 256) + 1)) * ODD & M)
            if k in scoring.SPELL_ORDERS:
                ctx.append((h + k) & M)
        yield ctx, raw[i], 1


def slow_scores(own):
    """{(doc_id, text): log10 probability} of the whole model."""
    low = lambda t: GAP.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    texts = []
    for d, t, *_ in own:
        words = low(t)
        votes = [sum(w in lang for w in words) for lang in scoring.LANGUAGES]
        kind = votes.index(max(votes)) if max(votes) else len(votes)
        texts.append((d, t, kind, [f"{kind}{w}" for w in words], zlib.crc32(("" if d is None else str(d)).encode()) % 10 != 0))
    c = Counter(w for _, _, _, words, train in texts if train for w in words)
    in_all = Counter()
    for w, n in c.items():
        in_all[w[1:]] += n
    every = {w for x in texts for w in x[3]}
    total = sum(c.values())
    least = max(1.0, total / 2**scoring.SHARE_BITS)

    def cls(n, a):
        if n >= least:
            return 65 + min(8, int(math.floor(math.log2(total / n) / 2)))
        return 2 + int(math.log2(n)) if n > 0 else int(a > 0)

    known = sorted(c)
    flat = Counter()
    for w in known:
        flat.update(w.encode() + b" ")
    code = mixing.Code(np.array([flat[i] + 1 for i in range(256)]))
    speller = Slow(code, [e for w in known for e in spelled(w)], len(scoring.SPELL_ORDERS), max(12, len(known).bit_length()))
    spelt = {w: sum(speller.log10(ctx, s) for ctx, s, _ in spelled(w)) for w in every}

    frequent = {w: i + 1 for i, w in enumerate(w for w in known if c[w] >= least)}
    symbol = lambda w, less=0: (lambda x: x - 64 if x > 64 else 10)(cls(c[w] - less, in_all[w[1:]] - less))

    def surroundings(kind, words):
        for i in range(len(words) + 1):
            one = symbol(words[i - 1]) if i else 11
            two = symbol(words[i - 2]) if i > 1 else 11
            yield [min(15, int(math.log2(i + 1))) << 25 | kind << 29, one << 17 | kind << 29, one << 17 | two << 21 | kind << 29] + [
                x | (frequent.get(words[i - 1], 0) if i else 0) for x in (one << 17 | kind << 29, one << 17 | two << 21 | kind << 29)
            ]

    def hashed(parts):
        return [stirred(stirred((p + k) * ODD & M)) for k, p in enumerate(parts)]

    events, whole = [], Counter()
    for _, _, kind, words, train in texts:
        if train:
            for i, parts in enumerate(surroundings(kind, words)):
                s = symbol(words[i], 1) if i < len(words) else 0
                one, two = parts[4] >> 17 & 15, parts[4] >> 21 & 15
                events.append((hashed(parts), s, 1))
                whole[parts[0], one, two, parts[4] & 0x1FFFF, s] += 1
    tally = Counter(s for _, s, _ in events)
    flow = Slow(mixing.Code(np.array([tally[s] + 1 for s in range(11)])), events, 5, max(12, len(whole).bit_length()))

    once = Counter(w[0] for w in known if c[w] == 1)
    weight = {w: c[w] + once[w[0]] * (in_all[w[1:]] / max(total, 1) + 10 ** spelt[w]) / 2 for w in known}
    mass, apart, others, unspelt = defaultdict(float), defaultdict(float), defaultdict(lambda: float(total)), defaultdict(lambda: 1.0)
    for w in known:
        k = int(w[0])
        mass[k, cls(c[w], in_all[w[1:]])] += weight[w]
        apart[k, cls(c[w] - 1, in_all[w[1:]] - 1)] += c[w]
        others[k] -= in_all[w[1:]]
        unspelt[k] -= 10 ** spelt[w]
    train_texts = Counter(kind for _, _, kind, _, train in texts if train)

    def score(kind, words):
        rare = {0: apart[kind, 0] + 0.5, 1: (apart[kind, 1] + 0.5) * (others[kind] > 0)}
        rare |= {j: (apart[kind, j] + 0.5) * (mass[kind, j] > 0) for j in range(2, 64)}
        seldom = sum(rare[j] for j in range(2, 64))
        shares = [x / sum(rare.values()) for x in (rare[0], rare[1], seldom)]
        drawn = [0, 0, 0]
        out = math.log10((train_texts[kind] + 1) / (sum(train_texts.values()) + 5))
        for i, parts in enumerate(surroundings(kind, words)):
            out += flow.log10(hashed(parts), symbol(words[i]) if i < len(words) else 0)
        for w in words:
            own = cls(c[w], in_all[w[1:]])
            if own > 64:
                out += math.log10(weight[w] / mass[kind, own])
                continue
            sort = min(own, 2)
            out += math.log10((max(4.0 * shares[sort], 1e-9) + drawn[sort]) / (4.0 + sum(drawn)))  # the urn, draw by draw
            drawn[sort] += 1
            if own == 0:
                out += spelt[w] - math.log10(max(unspelt[kind], 1e-6))
            elif own == 1:
                out += math.log10(in_all[w[1:]] / others[kind])
            else:
                out += math.log10(rare[own] / seldom * weight[w] / mass[kind, own])
        return out

    return {(d, t): score(kind, words) for d, t, kind, words, _ in texts}


def check(spark, own):
    want = slow_scores(own)
    df = spark.createDataFrame(own, SCHEMA)
    got = scoring.score(clash(df).repartition(3)).collect()
    assert len(got) == len(own)
    left = Counter((d, round(s, 1)) for d, s in ((d, want[d, t]) for d, t, *_ in own))
    for r in got:
        near = min((s for d, s in left if d == r["doc_id"] and left[d, s]), key=lambda s: abs(s - r["score"]))
        assert abs(near - r["score"]) < 0.06 + 2e-3 * abs(near), (r["doc_id"], near, r["score"])
        left[r["doc_id"], near] -= 1
    return got


def test_scores_are_the_models(spark):
    check(spark, rows())


def test_scores_with_rare_words(spark, monkeypatch):
    """A larger share for frequent words, so that there are rare classes."""
    monkeypatch.setattr(scoring, "SHARE_BITS", 7)
    r = random.Random(5)
    some = [f"{a}{b}" for a in "abcdefghij" for b in ("lo", "mi", "ta", "ne")]
    own = [(i, " ".join(["the", *(r.choice(some[: 4 + i % 30]) for _ in range(30)), f"own{i}"]), "en", "s", 1) for i in range(60)]
    check(spark, own)


def test_partitions_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_ROWS", 300)  # several shards
    df = registry.documents(spark, "/root/testdata/sf0.001")
    a, b = ({r["doc_id"]: r["score"] for r in scoring.score(x).collect()} for x in (df, df.repartition(7)))
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in a)


def test_large_counts_keep_their_ratio(spark):
    """Counts beyond 16 bits, and the same of both bits."""
    rows = spark.range(300).selectExpr("id AS key", "IF(id % 3 = 0, 1, 0) AS symbol", "100000000L AS n")

    def events(b):
        symbols = b.column("symbol").to_numpy().astype(np.int64)
        yield np.zeros((2, len(symbols)), np.uint32), symbols, b.column("n").to_numpy()

    model = mixing.learn_model(rows, events, mixing.Code(np.array([2, 1])), 2, 12)
    ones = 10 ** model.log10(np.zeros((2, 1), np.uint32), np.array([1]))
    assert math.isclose(ones[0], 1 / 3, rel_tol=0.05)


@pytest.mark.parametrize("symbols", [2, 11, 256])
def test_symbols_of_a_context_are_a_distribution(symbols):
    r = np.random.default_rng(symbols)
    code = mixing.Code(r.integers(0, 1000, symbols) ** 2)
    assert math.isclose((0.5 ** code.length.astype(float)).sum(), 1)
    model = mixing.Mixer(code, r.integers(0, 50, (3, 1 << 12, 2)).astype(np.float32), weights=r.normal(0.3, 0.2, (mixing.GATES, 5)), refine=r.random((mixing.REFINED, mixing.GATES, 2)) * 90)
    contexts = np.repeat(r.integers(0, 1 << 32, (3, 1), np.uint32), symbols, 1)
    assert math.isclose((10 ** model.log10(contexts, np.arange(symbols))).sum(), 1, rel_tol=1e-4)


def test_long_words_and_runs(monkeypatch):
    """Words are cut into runs at any place without a change."""
    words = pa.array(["0" + "ab" * 500, "1x", "0", "2élan", "0" + "z" * 90])
    whole = list(scoring.spelled(words))
    monkeypatch.setattr(scoring, "PASS", 64)
    parts = list(scoring.spelled(words))
    assert len(whole) == 1 and len(parts) > 1
    assert (np.concatenate([p[1] for p in parts], 1) == whole[0][1]).all() and (np.concatenate([p[2] for p in parts]) == whole[0][2]).all()
