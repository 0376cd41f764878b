"""Which frequent word of its class comes, by the mixer: against a plain version, as a distribution, and through the query."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from marginalia.llm import mixing, registry, scoring
from tests.llm.test_scoring import M, ODD, Slow, stirred

SCHEMA = "doc_id long, text string"


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def test_each_class_is_a_distribution():
    r = np.random.default_rng(3)
    counts, groups = r.integers(1, 1000, 60), r.integers(0, 5, 60)
    groups[0] = 9  # alone in its class
    code = mixing.Code(counts, groups)
    model = mixing.Mixer(code, r.integers(0, 50, (3, 1 << 12, 2)).astype(np.float32), weights=r.normal(0.3, 0.2, (mixing.GATES, 5)), refine=r.random((mixing.REFINED, mixing.GATES, 2)) * 90)
    contexts = np.repeat(r.integers(0, 1 << 32, (3, 1), np.uint32), 60, 1)
    p = 10 ** model.log10(contexts, np.arange(60))
    assert code.length[0] == 0 and p[0] == 1
    for g in set(groups.tolist()):
        assert math.isclose(p[groups == g].sum(), 1, rel_tol=1e-4)


def test_words_are_the_mixers(spark):
    """Words that occur twice or more, so that without the mixer a word's share of its class is its count's."""
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)]
    texts = {i: [vocab[int(r.random() ** 3 * 40)] for _ in range(30)] for i in range(50)}
    for i in (j for j in texts if not held(j)):
        texts[i] += vocab
    c = Counter(w for i, t in texts.items() if not held(i) for w in t)
    total, known = sum(c.values()), sorted(vocab)
    cls = {w: 1 + min(8, int(math.log2(total / c[w]) / 2)) for w in vocab}
    mass = defaultdict(int)
    for w in vocab:
        mass[cls[w]] += c[w]

    def events(words):
        for i, w in enumerate(words):
            prev = known.index(words[i - 1]) + 1 if i else 0
            yield [stirred(stirred((x + k) * ODD & M)) for k, x in enumerate((0, prev))], known.index(w), (prev, w)

    learnt = [e for i, t in texts.items() if not held(i) for e in events(t)]
    code = mixing.Code(np.array([c[w] for w in known]), np.array([cls[w] for w in known]))
    slow = Slow(code, [(ctx, s, 1) for ctx, s, _ in learnt], 2, max(12, len({e for _, _, e in learnt}).bit_length()))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], SCHEMA)
    without, mixed = ({row["doc_id"]: row["score"] for row in scoring.score(df, mixed_words=m).collect()} for m in (False, True))
    for i, t in texts.items():
        want = sum(slow.log10(ctx, s) - math.log10(c[w] / mass[cls[w]]) for (ctx, s, _), w in zip(events(t), t, strict=True))
        assert abs(mixed[i] - without[i] - want) < 0.02, (i, mixed[i] - without[i], want)


def test_the_word_before_tells(spark, tmp_path):
    """Two held-out texts of the same words and the same classes at each place: the one whose words follow as in training is likelier."""
    r, pair = random.Random(2), lambda i, j: f"a{i} b{j}"
    ids = [i for i in range(200) if held(i)][:2]
    rows = [(i, " ".join(pair(k, k) for k in (r.randrange(6) for _ in range(30)))) for i in range(200) if not held(i)]
    rows += [(ids[0], " ".join(pair(k % 6, k % 6) for k in range(30))), (ids[1], " ".join(pair(k % 6, (k + 1) % 6) for k in range(30)))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = {row["doc_id"]: row["score"] for row in registry.op7_context_mixing(spark, str(tmp_path)).collect()}
    assert got[ids[0]] > got[ids[1]] + 30
