"""The bound by letters in common lets no duplicate go, with letters of any number, and is worked out without a function for each letter of each pair."""

import difflib
import random

from marginalia.operators import matching


def test_duplicates_of_texts_with_many_equal_letters(spark):
    r = random.Random(3)
    base = "".join(r.choice("aaaaaab c1é~") for _ in range(60))
    texts = [base, *("".join(c for c in base if r.random() > k / 40) + "z" * r.randrange(6) for k in range(12)), "a" * 90, "a" * 80, "é" * 20, "é" * 16 + "b"]
    found = matching.duplicates(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, k long, text string"), ["doc_id"], "k", "text")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "zip_with" not in plan and "zipwith" not in plan and "bit_count" in plan
    low = [" ".join(t.lower().split()) for t in texts]
    want = {(j, i) for i in range(len(low)) for j in range(i + 1, len(low)) if difflib.SequenceMatcher(None, low[i], low[j]).ratio() > 0.85}
    assert {(row["id"], row["duplicate_of"]) for row in found.collect()} == want and len(want) > 5
