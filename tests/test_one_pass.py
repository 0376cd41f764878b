"""Terms and patterns found in one pass, against each pattern over the whole text; segments and lexicon places against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import highlighting as H
from marginalia.operators import lexicon, onepass, segments


def found(spark, texts, patterns, triggers):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    return sorted((r.id, r.pattern_group, r.start, r.end) for r in onepass.pattern_places(rows, ["id"], "text", patterns, triggers).collect())


def slow(texts, patterns):
    out = []
    for i, t in enumerate(texts):
        for k, p in patterns:
            out += [(i, k, m.start(), m.end()) for m in re.finditer(p, t or "", re.IGNORECASE)]
    return sorted(out)


WORDS = [*H.TRIGGERS.words, *H.METRIC, "percent", "per cent", "figure", "Table", "degree", "angle", "rays", "tend", "pinch", "chinch", "omicron", "smile", "p", "to", "per", "day", "éone", "oneé", "Σ", "µL", "𝛼x"]
SIGNS = ["=", "<", ">", "≤", "≥", "°", "°F", "%", "™", "§", "-", "--", "–", " — ", ".", "?", "(", "￿", "\n", "\t", "  ", "α", "ς"]


def random_text(r, n):
    pick = lambda: r.choice([r.choice(WORDS), r.choice(WORDS).upper(), r.choice(SIGNS), str(r.randint(0, 20_000)), f"{r.randint(0, 9)}.{r.randint(0, 9)}", "quiet", "xyzzy"])
    return "".join(pick() + r.choice(["", " ", " ", " ", "  "]) for _ in range(n))


def test_patterns_in_one_pass(spark):
    r = random.Random(4)
    texts = [random_text(r, r.randint(1, 60)) for _ in range(300)]
    texts += [" ".join(["quiet"] * 40 + ["p - ? 5"] + ["quiet"] * 40 + ["10" + " " * 30 + "to" + " " * 30 + "20"] + ["quiet"] * 12 + ["Figure" + " " * 30 + "7"]), "", None, "quiet " * 500, "%" * 300]
    assert found(spark, texts, H.PATTERNS, H.TRIGGERS) == slow(texts, H.PATTERNS)
    assert found(spark, texts, H.SIGNS, H.SIGN_TRIGGERS) == slow(texts, H.SIGNS)


def test_trie():
    assert re.fullmatch(onepass.trie(["a", "ab", "abc", "b.c"]), "abc") and re.match(onepass.trie(["a", "abc"]), "abx")[0] == "a"
    words = [w.lower() for w in H.TRIGGERS.words]
    made = re.compile(onepass.trie(words))
    assert all(made.fullmatch(w) for w in words) and not made.fullmatch("quiet")


def test_many_sentences_take_time_in_proportion(spark):
    paras = spark.createDataFrame([(1, 1, "..! Ab cd. " * 40_000 + "x")], "doc_id long, para_no long, text string")
    got = T.sentences(paras).agg(F.count("*").alias("n"), F.max("start").alias("last"), F.max("sent_no").alias("no")).first()
    assert (got.n, got.last, got.no) == (80_000, 439_999, 79_999)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000])
def test_starts(spark, n):
    r = random.Random(n)
    lengths = [r.randint(0, 9) for _ in range(n)]
    got = spark.createDataFrame([(lengths,)], "x array<int>").select(T.starts_of(F.col("x")).alias("s")).first().s
    assert got == [sum(lengths[:i]) for i in range(n)]


def lexicon_slow(rows, terms):
    out = []
    for key, sentence in rows:
        seen = {}
        for no, term in enumerate(terms):
            flags = 0 if term == term.upper() else re.IGNORECASE
            if not re.match(r"\w", term):
                continue
            for m in re.finditer(rf"\b{re.escape(term)}\b", sentence, flags):
                seen.setdefault((m.start(), m.end()), term)
        out += [(key, term, a, z) for (a, z), term in seen.items()]
    return sorted(out)


def test_lexicon_places(spark):
    r = random.Random(9)
    vocab = ["Ab", "ab", "AB", "x-ray", "x", "ray", "Ph.D.", "too thin", "too", "thin", "é", "a.b", "_", "9", "the", "of", "one two three"]
    texts = ["".join(r.choice(vocab) + r.choice([" ", " ", "  ", "-", ".", ". ", ""]) for _ in range(r.randint(0, 25))) for _ in range(200)]
    terms = ["ab", "AB", "x-ray", "x", "too thin", "thin", "Ph.D.", "Ph.D", "one two three", "é", "-x", "the", "a.b", "THE", "of the"]
    lex = spark.createDataFrame([(i, t, f"c{i}") for i, t in enumerate(terms)], "line_no int, term string, category string")
    rows = spark.createDataFrame([(i, 1, i, t) for i, t in enumerate(texts)] + [(999, 1, 1, None)], "doc_id long, para_no long, sent_no long, sentence string")
    got = sorted((x.doc_id, x.term, x.start, x.end) for x in lexicon.places(rows, lex).collect())
    assert got == lexicon_slow(list(enumerate(texts)), terms)
    assert {(x.doc_id, x.term) for x in lexicon.hits(rows, lex).collect()} >= {(a, b) for a, b, *_ in got}
    plan = lexicon.hits(rows, lex)._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.split("Join")[0]


def test_a_lexicon_of_many_terms(spark):
    terms = spark.range(100_000).select(F.col("id").cast("int").alias("line_no"), F.concat(F.lit("term"), "id").alias("term"), F.lit("c").alias("category"))
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(1).cast("long").alias("para_no"), F.lit(0).cast("long").alias("sent_no"), F.concat(F.lit("a Term"), "id", F.lit(" and term"), F.col("id") + 200_000).alias("sentence"))
    assert lexicon.hits(rows, terms).count() == 2000


def segments_slow(runs, spans, rank):
    text = "".join(t for _, t in runs)
    colours = [None] * len(text)
    for a, z, c in sorted(spans, key=lambda s: rank[s[2]]):
        for k in range(max(a, 0), min(z, len(text))):
            colours[k] = c
    out, at = [], 0
    for no, t in runs:
        k = 0
        for i in range(len(t)):
            if i and colours[at + i] != colours[at + i - 1]:
                k += 1
            if i == 0 or colours[at + i] != colours[at + i - 1]:
                out.append([no, k, "", colours[at + i]])
            out[-1][2] += t[i]
        at += len(t)
    return [tuple(x) for x in out]


def test_segments(spark):
    r = random.Random(6)
    paras = {}
    for para in range(60):
        runs = [(no * 2, "".join(r.choice("ab é🙂") for _ in range(r.choice([0, 1, 5, 12])))) for no in range(r.randint(1, 5))]
        size = sum(len(t) for _, t in runs)
        spans = [(a, a + r.randint(-2, 9), r.choice(["cyan", "yellow", "green"])) for a in (r.randint(-3, size + 2) for _ in range(r.randint(0, 8)))]
        paras[para] = runs, spans + spans[:1] + [(0, size, "cyan")] * (para % 7 == 0)
    runs = spark.createDataFrame([(1, p, no, t) for p, (rs, _) in paras.items() for no, t in rs] + [(2, 1, 0, None)], "doc_id long, para_no long, run_no long, text string")
    spans = spark.createDataFrame([(1, p, a, z, c) for p, (_, ss) in paras.items() for a, z, c in ss] + [(3, 1, 0, 5, "cyan")], "doc_id long, para_no long, start long, end long, colour string")
    got = segments.coloured(runs, spans)
    rank = {c: i for i, c in enumerate(segments.RANKED)}
    want = [(1, p, *x) for p, (rs, ss) in paras.items() for x in segments_slow(rs, [s for s in ss if s[1] > s[0]], rank)]
    assert sorted(map(repr, (tuple(x) for x in got.collect()))) == sorted(map(repr, want))
    back = got.groupBy("para_no", "run_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"]), "").alias("t")).collect()
    assert {(x.para_no, x.run_no): x.t for x in back} == {(p, no): t for p, (rs, _) in paras.items() for no, t in rs if t}
