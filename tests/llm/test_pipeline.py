"""The pipeline against brute force, stage by stage."""

import os
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import common, sampling
from tests.llm.test_alike import slow_kept
from tests.llm.test_operators import SCHEMA, rows, slow_leaks, slow_quality


def slow_lines(docs, ratio=0.1, least=5):
    from collections import Counter

    hosts, pages = Counter(d["source"] for d in docs), Counter()
    for d in docs:
        pages.update((d["source"], x) for x in {x.strip() for x in d["text"].split("\n")} - {""})
    bad = {k for k, n in pages.items() if n >= least and n > ratio * hosts[k[0]]}
    return [d | {"text": "\n".join(x for x in d["text"].split("\n") if (d["source"], x.strip()) not in bad)} for d in docs]


def slow_one(docs):
    docs = sorted(docs, key=lambda d: d["doc_id"])
    return [d for k, (d, g) in enumerate(zip(docs, slow_kept([(0, d["text"]) for d in docs])[0], strict=True)) if g == k]


def test_pipeline(spark, small):
    docs = pq.read_table(f"{small}/documents.parquet").to_pylist()
    bench = [(r["item_id"], r["text"]) for r in pq.read_table(f"{small}/benchmark.parquet").to_pylist()]
    want = slow_one(slow_lines([d for d in docs if slow_quality(d["text"])[-1]]))
    leaks = {d for d, _ in slow_leaks([(d["doc_id"], d["text"]) for d in want], bench)}
    want = {d["doc_id"]: d["text"] for d in want if d["doc_id"] not in leaks}
    model = sampling.pieces(public_tokenizers.path("piece_bpe_32k.model"), 1.0)
    got = {r["doc_id"]: sampling.decode(np.frombuffer(r["ids"], "<u2"), model).decode() for r in corpus_pipeline.run(spark, small).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
        assert not stage(spark, docs.limit(0), small).collect()


def edges(spark):
    """Documents with nulls, repeated rows, ids used twice, empty and blank texts, ties, and columns that operators use inside."""
    docs = spark.createDataFrame(rows(), SCHEMA)
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(["quality", "kept", "base_failed", "_words", "_row", "g_id", "line", "host", "root", "ids"])])


def test_stages_take_every_edge(spark, small):
    docs, bare = edges(spark), spark.createDataFrame(rows(), SCHEMA)
    key = lambda df: sorted(repr((r["doc_id"], r["text"])) for r in df.collect())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, small)
        assert got.columns == docs.columns and key(got) == key(stage(spark, bare, small))
        assert got.isEmpty() or got.first()["quality"] == 0
    encoded = corpus_pipeline.encode_pieces(spark, docs, small).collect()
    assert len(encoded) == len(rows()) and all(r["lossless"] for r in encoded)


def test_stages_leave_no_tables_behind(spark, small):
    common.clear(spark)
    corpus_pipeline.run(spark, small).collect()
    folder = common.shared_dir(spark).removeprefix("file://") + f"/marginalia-{spark.sparkContext.applicationId}"
    left = sorted(n.rsplit("-", 1)[0] for n in os.listdir(folder))
    assert left == sorted(f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES[:-1])
    common.clear(spark)
    assert not os.path.exists(folder)
