"""Substring repeats where rows share ids, have none, or are equal."""

from collections import Counter

from marginalia.llm import chunks
from tests.llm.test_operators import SCHEMA, slow_ends


def test_rows_of_one_id_repeat_each_other(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(60))
    rows = [(5, text), (5, text), (5, text + " and a tail of its own"), (None, text), (None, text), (9, "short and clean")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA).coalesce(1)
    found = chunks.repeated_spans(docs)
    got = found.collect()
    # All but one of the five rows of the text repeat it.
    assert sum(r["end"] - r["start"] >= 64 for r in got) == 4
    assert Counter(r["doc_id"] for r in got) == {5: 3, None: 1}
    assert all(r["end"] == len(text) for r in got if r["end"] - r["start"] > slow_ends(text.encode())[-2] and r["end"] <= len(text))
    left = [r["text"] for r in chunks.drop_spans(docs, found).collect()]
    assert left.count(text) == 1 and left.count("") == 3 and "short and clean" in left
