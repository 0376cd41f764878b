"""Documents whose columns are called as the operators' own are, and long texts without a blank."""

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marginalia.llm import alike, chunks, decontam, quality, sampling, tokens
from tests.llm.test_operators import PIECES, SCHEMA, WORDS, rows

NAMES = ["g_id", "G_KEY", "gone_id", "gone_key", "key", "nth", "g_copy", "g_gone", "seed", "n_pieces", "root", "sig", "row", "start", "text_key", "copy", "best"]


def clashing(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(NAMES)])


def test_clashing_columns_come_back(spark):
    df, bare = clashing(spark), spark.createDataFrame(rows(), SCHEMA)
    bench = spark.createDataFrame([(1, rows()[4][1])], "item_id long, text string")
    key = lambda d: sorted((str(r["doc_id"]), str(r["text"])) for r in d.collect())
    for f in (alike.keep_one, lambda d: decontam.drop_leaks(d, bench), lambda d: chunks.drop_spans(d, chunks.repeated_spans(bare))):
        got = f(df)
        assert got.columns == df.columns and key(got) == key(f(bare)) and got.first()["g_id"] == 0
    got = sampling.encode(df, PIECES)
    assert got.columns == [c for c in df.columns if c != "n_pieces"] + ["ids", "n_pieces", "ids_crc32", "lossless"] and got.count() == len(rows())


def test_a_long_text_without_a_blank_takes_time_in_proportion():
    model, r = sampling.pieces(PIECES, 1.0), np.random.default_rng(1)
    raw = bytes(r.integers(97, 123, 120_000).astype(np.uint8)) + "東京の天気".encode() * 2000
    began = time.time()
    (ids,) = sampling.sample([raw], np.array([7], np.uint64), model)
    assert sampling.decode(ids, model) == raw and time.time() - began < 60


def test_words_met_again_have_the_same_ids(monkeypatch):
    path, some = WORDS, ["the", "don't", "東京", "abc", "", "<|endoftext|>", "zebra9"]
    monkeypatch.setattr(tokens, "KEPT_WORDS", 5)
    monkeypatch.setattr(tokens, "_kept", {})
    for words in (some, some[::-1], ["new", *some, "newer", "the"], [], ["the"]):
        got, want = tokens.encode_again(pa.array(words, pa.string()), path), tokens.encode_words(pa.array(words, pa.string()), path)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, want, strict=True))
    assert len(tokens._kept[path][0]) == 5


def test_quality_leaves_columns_of_its_names_alone(spark):
    names = ["quality", "base_failed", "kept", "_words", "_lines", "_sorted", "_at", "quality_"]
    docs = spark.createDataFrame(rows(), SCHEMA).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    got = quality.score_quality(docs)
    assert got.columns == docs.columns + ["quality__", "base_failed_", "kept_"]
    assert {tuple(r[n] for n in names) for r in got.collect()} == {tuple(range(len(names)))}
    plain = quality.score_quality(spark.createDataFrame(rows(), SCHEMA))
    assert sorted(map(repr, got.select("doc_id", "quality__", "kept_").collect())) == sorted(repr(r).replace("quality=", "quality__=").replace("kept=", "kept_=") for r in plain.select("doc_id", "quality", "kept").collect())
