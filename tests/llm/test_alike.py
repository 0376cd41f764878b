"""Near copies against brute-force similarity of five-word shingles."""

import random
import re

import pytest

from marginalia.llm import alike
from tests.llm.test_operators import GAP, SCHEMA, clash, rows


def shingles(text, k=5):
    w = GAP.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def slow_kept(docs, least=0.8):
    """(doc_id, text) of the row that each group keeps, and the similarities met."""
    sets, label, met = [shingles(d[1]) for d in docs], list(range(len(docs))), []
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            alike_ = len(x & y) / len(x | y) if x | y else 1.0
            if alike_ >= least:
                met.append(alike_)
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label, met


def near(seed=4, n=6):
    """Copies of texts with words changed, so that similarities lie on both sides of 0.8; copies of copies; shared and null ids."""
    r, out = random.Random(seed), []
    for i in range(n):
        base = [f"w{r.randint(0, 5000)}" for _ in range(r.choice([60, 200, 400]))]
        out.append((100 * i, " ".join(base), "en", "s", 1))
        for k in range(1, 30):
            own = list(base if r.random() < 0.6 else out[-1][1].split())
            for _ in range(r.randint(0, max(1, len(base) // 35))):
                own[r.randrange(len(own))] = f"x{r.random()}"
            out.append((100 * i + k, " ".join(own), "en", "s", 1))
    out += [(0, "a clean text that shares the id of a kept one", "en", "s", 1), (101, "a clean text that shares the id of a copy", "en", "s", 1)]
    out += [(None, f"only null ids have this text {'x ' * 9}", "en", "s", 1)] * 3 + [(None, out[0][1], "en", "s", 1), out[0], out[40]]
    return out


@pytest.mark.parametrize("limits", [{}, {"list_limit": 2, "block": 7}])
def test_one_of_each_group_of_similar_texts_is_kept(spark, limits):
    own = near() + rows()
    label, met = slow_kept(own)
    assert sum(0.8 <= x < 0.97 for x in met) > 100
    got = alike.keep_one(clash(spark.createDataFrame(own, SCHEMA)), **limits).collect()
    kept = [next(i for i, d in enumerate(own) if (d[0], d[1]) == (r["doc_id"], r["text"])) for r in got]
    assert sorted(label[i] for i in kept) == sorted(set(label))
    for i in kept:
        ids = [own[j][0] for j in range(len(own)) if label[j] == label[i] and own[j][0] is not None]
        assert own[i][0] == min(ids, default=None)


def test_no_documents(spark):
    assert not alike.keep_one(spark.createDataFrame([], SCHEMA)).collect()
