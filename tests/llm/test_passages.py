"""The quality classifier: what its passages hold, its gradients, its edges, and held-out accuracy."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import passages as P

SCHEMA = "doc_id long, text string, lang string, source string, score double, key string, y string, bag string"


def text(r, good, words=200):
    vocab = ["the", "of", "and", "to", "river", "stone", "window", "garden", "letter", "is", "in"]
    if good:
        return " ".join(r.choice(vocab) for _ in range(words)) + "."
    spoilt = [" ".join(r.choice(vocab) + r.choice(["###", "$$$"]) for _ in range(words)), " ".join([r.choice(vocab)] * words), " | ".join(r.choice(vocab) for _ in range(words))]
    return r.choice(spoilt)


def rows(n=300):
    r = random.Random(1)
    out, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        # The spoilt passages of a bad document lie among good ones.
        body = [text(r, True) for _ in range(r.randint(0, 3))] + [text(r, good)] + [text(r, True) for _ in range(r.randint(0, 3))]
        out.append((i, "\n".join(body)))
        labels.append((i, int(good), 0))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (None, "no id"), out[3], out[3], (4, "other text of an id"), (n + 3, "word " * 30_000), (n + 4, "東京🙂 é\x1f")]
    labels += [(3, 1, 0), (3, 0, 0), (n + 2, None, 1), (n + 3, 5, None), (None, 1, 1), (10**6, 1, 0)]
    return out, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = rows()
    return spark.createDataFrame([(i, t, "en", "s", 0.5, "x", "y", "z") for i, t in docs], SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_documents_are_told_right(spark, tables):
    docs, labels = tables
    got = P.score(docs, P.fit(docs, labels)).collect()
    told = {i: y for i, y, _ in rows()[1] if i is not None and i < 300 and i != 3}
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and 0 < r.most_weight <= 1 + 1e-6
    mine = [r for r in got if r.held_out and r.doc_id in told and r.doc_id != 4]
    assert np.mean([r.predicted == told[r.doc_id] for r in mine]) > 0.9


def test_labels_of_held_out_rows_are_not_used(spark, tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", F.when(P.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (P.sample(docs, x, "quality", 1000, 8) for x in (labels, flipped))
    assert (a[1] == b[1]).all() and all((x == y).all() for x, y in zip(a[0], b[0], strict=True))
    assert len(P.sample(docs, labels, "quality", 50, 8)[1]) == 50
    assert max(map(len, a[0])) == 8


def test_nothing_to_learn(spark, tables):
    docs, labels = tables
    none = docs.limit(0)
    assert P.score(none, P.fit(none, labels.limit(0))).collect() == []
    assert {r.score for r in P.score(docs, P.fit(docs, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in P.score(docs, P.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_rows_do_not_depend_on_their_neighbours(spark, tables, monkeypatch):
    texts = [t for _, t in rows()[0][:40]] + [None, "", " x", "x ", "\n", "a\nb", "é" * 500]
    r = np.random.default_rng(0)
    bags = P.bags_of(pa.array(texts))
    assert all(np.array_equal(x, P.features(pa.array([t], pa.string()))[0]) for x, t in zip(bags, texts, strict=True))
    assert [len(x) for x in bags] == [max(1, -(-len((t or "").split()) // P.PASSAGE)) for t in texts]
    assert all(np.isfinite(x).all() for x in bags)
    model = P.train(bags[:30], r.integers(0, 2, 30).astype(float), epochs=2)
    whole = model.scores(pa.array(texts))
    assert np.allclose(whole[0], [model.scores(pa.array([t], pa.string()))[0][0] for t in texts], atol=1e-5)
    # A sliced array and pieces of long texts
    assert np.allclose(model.scores(pa.array(texts).slice(5, 9))[0], whole[0][5:14], atol=1e-5)
    monkeypatch.setattr(P, "PIECE", 1 << 10)
    pieces = P.split_long(texts[0])
    assert "".join(pieces) == texts[0] and len(pieces) > 1
    h = [model.encoded(P.features(pa.array([p]))[0]) for p in pieces]
    e, enc = np.concatenate([x[1] for x in h]), np.concatenate([x[0] for x in h])
    a = np.exp(e - e.max())
    a /= a.sum()
    want = 1 / (1 + np.exp(-(a @ enc @ model.layers["c"] + model.layers["d"])))
    got = model.scores(pa.array([texts[0]]))
    assert abs(got[0][0] - want) < 1e-5 and got[1][0] == len(e) and abs(got[2][0] - a.max()) < 1e-5


def test_gradients(monkeypatch):
    """A step of training lowers the loss along the numeric gradient."""
    r = np.random.default_rng(2)
    bags = [r.normal(size=(r.integers(1, 5), P.WIDTH)).astype(np.float32) for _ in range(40)]
    y = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    loss = lambda m: -np.mean([np.log(np.clip(s if t else 1 - s, 1e-9, 1)) for s, t in zip(probabilities(m, bags), y, strict=True)])
    losses = [loss(P.train(bags, y, epochs=k, batch=40)) for k in (1, 10, 40, 120)]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.05


def probabilities(model, bags):
    for bag in bags:
        h, e = model.encoded(bag)
        a = np.exp(e - e.max())
        yield 1 / (1 + np.exp(-((a / a.sum()) @ h @ model.layers["c"] + model.layers["d"])))
