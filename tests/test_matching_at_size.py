"""Matching that meets by equal keys, not by all pairs; each would have taken minutes or a broadcast before."""

import difflib
import random
import time

from marginalia.functions.otherstyles import loose_match
from marginalia.operators import flow, matching
from marginalia.plans import registry


def test_loose_matches_of_one_year(spark):
    """All names share a word, so lists of that word are all references."""
    n = 5000
    name = ["n" + f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) + "x" for i in range(n)]
    cites = spark.createDataFrame([(1, i, "1999", f"Group {name[i].title()}") for i in range(n)] + [(1, n, "1999", ""), (1, n + 1, "1999", None), (1, n + 2, "1999", "Lee et al."), (1, n + 3, "1999", name[7][:6])], "doc_id long, cite_id long, year string, author string")
    refs = spark.createDataFrame([(1, i, "1999", f"The Group {name[i].title()} of all") for i in range(n)] + [(1, n, "1999", "Lee, J., & Ray, M."), (1, n + 1, "1999", None)], "doc_id long, ref_pos long, year string, full_author string")
    start = time.time()
    got = {r["cite_id"]: r["ref_pos"] for r in loose_match(cites, refs).collect()}
    assert got == {**{i: i for i in range(n)}, n: 0, n + 1: None, n + 2: n, n + 3: 7}
    assert time.time() - start < 60


def test_duplicates_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, i, f"A text of words number {i}") for i in range(20)], "doc long, pos long, text string")
    found = matching.duplicates(rows, ["doc"], "pos", "text")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 190


def test_ratio_is_difflibs():
    rng = random.Random(5)
    for _ in range(3000):
        letters = "abcdefgh"[: rng.choice((2, 3, 8))]
        x = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        y = list(x)
        for _ in range(rng.randint(0, 6)):
            y.insert(rng.randint(0, len(y)), rng.choice(letters))
        y = "".join(c for c in y if rng.random() > 0.1)
        want = difflib.SequenceMatcher(None, x, y).ratio()
        assert matching.alike_by(x, y) == want
        bound = matching.alike_by(x, y, 0.85)
        assert bound == want if want > 0.85 else bound <= 0.85
    long = "x" * 250
    assert matching.alike_by(long, long) == difflib.SequenceMatcher(None, long, long).ratio()


def test_single_links_of_one_year(spark):
    n = 6000
    asks = spark.createDataFrame([(i, f"Nation{i:05d} and Nation{i:05d}q", "1999") for i in range(n)] + [(n, "nAtion00003", "1999"), (n + 1, "Nobody", "1999"), (n + 2, "Nation", "1999"), (n + 3, "and", "1999")], "cite long, names string, year string")
    refs = spark.createDataFrame([(i, f"Dr Nation{i:05d}, Nation{i:05d}Q, 1999") for i in range(n)], "ref_id long, line string")
    start = time.time()
    assert {r["cite"]: r["ref_id"] for r in flow.single_links(asks, refs).collect()} == {**{i: i for i in range(n)}, n: 3}
    assert time.time() - start < 60


def test_first_pages_take_a_text_once(spark):
    """Texts are not repeated for their words; heads of few words, of blanks, of one text's and of the next one's words as by comparing all."""
    rng = random.Random(4)
    said = ["to", "be", "or", "not", "t", "", "tobe", "."]
    line = lambda n: " ".join(rng.choices(said, k=n))
    pages = [(d, rng.randint(1, 5), line(8) if rng.random() > 0.05 else None) for d in range(4) for _ in range(12)]
    heads = [(d, p, 0, line(rng.randint(0, 4))) for d in range(5) for p in range(60)] + [(1, 99, 0, None)]
    got = flow.first_pages(spark.createDataFrame(heads, "doc_id long, para_no long, sent_no long, head string"), spark.createDataFrame(pages, "doc_id long, page long, page_text string"))
    want = {}
    for d, p, _, head in heads:
        own = [page for doc, page, text in pages if doc == d and text is not None and head is not None and head in text]
        want |= {(d, p): min(own)} if own else {}
    assert {(r["doc_id"], r["para_no"]): r["page"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "split(page_text" not in plan


def test_equal_citations_are_matched_once(spark):
    """4,000 citations of one text and 4,000 references: each reference is met once, not by every citation."""
    n = 4000
    cites = spark.range(n).selectExpr("1L AS doc_id", "id AS cite_id", "'Smyth and Browne' AS author", "'1999' AS year")
    refs = spark.range(n).selectExpr("1L AS doc_id", "id AS ref_pos", "concat('Other & Name', id) AS author", "'1999' AS year", "concat('Other, A., & Name', id) AS full_author", "cast(array() AS array<string>) AS abbreviations")
    refs = refs.union(spark.sql("SELECT 1L, 5000L, 'Smythe and Browne', '1999', 'Smythe, A., & Browne, B.', cast(array() AS array<string>)"))
    start = time.time()
    got = matching.match_citations(cites, refs).groupBy("how", "ref_pos").count().collect()
    assert [tuple(r) for r in got] == [("spelling", 5000, n)]
    assert time.time() - start < 60


def test_heavy_rows_of_one_file_are_dealt_out(spark, small):
    for name in ("fn53_ama_shapes", "fn53_apa_shapes", "fn77_pipe08_highlights", "fn82_comment_marks"):
        plan = registry.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_COL" in plan
