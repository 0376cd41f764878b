"""The best candidate of every title."""

from marginalia.plans.biblio import candidates


def test_every_title_has_its_candidate(spark, small):
    titles = {r[0] for r in spark.read.parquet(f"{small}/part.parquet").select("p_name").collect()}
    got = {r["query"] for r in candidates(spark, small).collect()}
    assert got <= titles and len(got) > 0.5 * len(titles)


def test_candidates_against_a_plain_loop(spark):
    """Both choices, on titles of two letters in all orders, ties, empty titles and queries, and items of equal numbers' order."""
    import difflib
    import itertools
    import random

    from marginalia.operators import matching

    draw, asked = random.Random(7), ["", "a b", "aab", "ab ba", "abab"]
    titles = [None, "", " A  B", "zz"] + ["".join(t) for n in (2, 3, 4) for t in itertools.product("ab", repeat=n)]
    rows = [(q, draw.choice(["crossref", "pubmed"]), i, draw.choice(titles), draw.choice([None, "", "10.1/x"])) for i, q in enumerate(asked * 12)]
    candidates = spark.createDataFrame(rows, "query string, source string, cand_no int, title string, doi string")

    def alike(q, t):
        a, b = (" ".join((x or "").split()).lower() for x in (q, t))
        return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0

    first, both = {}, {}
    for q in asked:
        items = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] != "crossref", r[2]))
        same = [r for r in items if " ".join((r[3] or "").split()).lower() == q]
        best = max(items, key=lambda r: (alike(q, r[3]), -r[2]))
        if same or alike(q, best[3]):
            first[q] = (min(r[2] for r in same), 1.0) if same else (best[2], round(alike(q, best[3]), 6))
        score = lambda r: alike(q, r[3]) + (0.06 if r[4] else 0)  # noqa: B023, E731
        won = max(items, key=score)
        cross = max((r for r in items if r[1] == "crossref"), key=lambda r: alike(q, r[3]))  # noqa: B023
        if score(won) >= 0.6:
            turns = won[1] == "pubmed" and alike(q, cross[3]) + 0.02 >= score(won) and cross[4]
            both[q] = ("crossref", cross[2], round(alike(q, cross[3]), 6)) if turns else (won[1], won[2], round(score(won), 6))
    assert {r["query"]: (r["cand_no"], r["score"]) for r in matching.by_title(candidates).collect()} == first
    assert {r["query"]: (r["source"], r["cand_no"], r["score"]) for r in matching.best_candidate(candidates).collect()} == both and len(both) >= 3
