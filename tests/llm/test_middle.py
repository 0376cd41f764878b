"""Fill-in-the-middle against loops over a regular expression, and the Elias-Fano lists against the lists they hold."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, n long, part int, digest string, parts int, h string"


def slow(doc_id, text, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if text == "" or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows():
    r = random.Random(3)
    words = ["a", "the", "ßé", "東京", "🙂", "<", "<P", ">", "S>", "<<", "x" * 40]
    text = lambda k: "".join(r.choice(words) + r.choice([" ", "  ", "\n", "\t\r", " ", "\x1f"]) for _ in range(k))
    out = [(i, text(r.randint(0, 30))) for i in range(120)]
    out += [(200, None), (201, ""), (202, "  \n"), (203, "one"), (204, " one "), (205, "has <P> inside"), (206, "<M>"), (207, text(20_000)), (None, text(9)), (None, None)]
    out += [out[5], out[5], (5, "another text of the same id")]
    return out + [(1000 + i, "the same text in a third of all rows, more or less") for i in range(80)] + [(None, "the same text in a third of all rows, more or less")]


def frame(spark, own):
    return spark.createDataFrame([(i, t, 7, 7, "x", 7, "x") for i, t in own], SCHEMA).repartition(5)


def test_against_loops(spark):
    docs = frame(spark, rows())
    out = middle.transform(docs)
    back = out.select("*", middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    shown = lambda own: sorted(map(repr, own))
    assert shown(tuple(r)[:6] for r in back) == shown(slow(*r) for r in rows())
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows())
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert middle.transform(frame(spark, [])).collect() == []


def test_seed_and_shares(spark):
    docs = frame(spark, rows())
    assert sorted(map(repr, (tuple(r) for r in middle.transform(docs, seed=7).collect()))) == sorted(repr(slow(*r, seed=7)) for r in rows())
    assert {r.form for r in middle.transform(docs, plain_percent=100, spm_percent=0).where("n > 0").collect()} == {"plain", "psm"}


def test_index_has_each_text_once_and_frequent_texts_are_dealt_out(spark):
    docs = frame(spark, rows()).select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    frequent = middle._frequent(docs, share=10)
    assert frequent.count() == 1 and frequent.first().parts == 9 and frequent.first().anchor == 1000
    dealt = middle._dealt(docs, frequent)
    index = middle.text_index(dealt).collect()
    texts = {t or "" for _, t in rows()}
    assert sorted(bytes(r.digest) for r in index) == sorted(hashlib.sha256(t.encode()).digest() for t in texts)
    parts = {r.part for r in dealt.where("text LIKE 'the same%'").collect()}
    assert 0 in parts and len(parts) > 4


def test_plan_shuffles_texts_once(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/docs")
    out = middle.transform(spark.read.parquet(f"{tmp_path}/docs"))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and plan.count("REPARTITION_BY_COL") == 2, plan  # the exchange and its second use


def test_lists():
    r = np.random.default_rng(5)
    for n, top in ((1, 1), (1, 10**9), (5, 5), (300, 300), (300, 2000), (4000, 10**7), (64, 64 * 255)):
        ends = np.sort(r.choice(top, n, replace=False) + 1) if top < 10**8 else np.array([top])
        size, width, low, high = middle.EliasFano.encode(ends)
        held = middle.EliasFano(size, width, low, high)
        assert [held[i] for i in range(n)] == ends.tolist()
        assert 8 * (len(low) + len(high)) <= n * (3 + max(0, np.log2(top / n))) + 24
    assert middle.EliasFano.encode(np.zeros(0, np.int64)) == (0, 0, b"", b"")


def test_ends_of_units():
    for text in ("", " ", "a", " a", "a ", "a b\n", "\x0bé \x0c東京x\r", "   x", "a" * 1000 + " " * 1000):
        want = np.cumsum([len(u) for u in UNIT.findall(text)]).tolist()
        assert middle.unit_ends(np.frombuffer(text.encode(), np.uint8)).tolist() == want
