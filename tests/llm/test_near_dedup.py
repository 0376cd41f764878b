"""The pipeline's near_dedup has candidates from SimHash and from MinHash bands, and keeps links of shingle sets 0.8 alike."""

import random

import corpus_pipeline
from marginalia.llm import alike
from marginalia.llm.simhash import fingerprint


def bits(x, y):
    return (fingerprint(x, 5) ^ fingerprint(y, 5)).bit_count()


def test_both_ways_link(spark, small):
    r = random.Random(7)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    passage, plain, apart = words(41), words(300), words(300)
    # A passage that is most of both texts, counted with its repeats, but a small part of their sets.
    same = [" ".join([*[passage] * 200, words(30)]) for _ in range(2)]
    tail = plain.split()
    copy = " ".join([*tail[:-20], words(20)])  # a similarity above 0.8, many bits apart
    assert bits(*same) <= 4 < bits(plain, copy)
    texts = [*same, plain, copy, apart]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {row["doc_id"] for row in corpus_pipeline.near_dedup(spark, df, small).collect()} == {0, 1, 2, 4}
    each = alike.sketches(df, 5, True)
    sig = {row["doc_id"]: row["sig"] for row in each.collect()}
    found = [{row["a"], row["b"]} for row in alike.near_fingerprints(each, 4).collect()]
    assert found == [{sig[0], sig[1]}]  # which their sets then refuse
