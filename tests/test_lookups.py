"""Containment by rare runs against all pairs, journals' short names, and records of articles."""

import random

from pyspark.sql import functions as F

from marginalia.operators import matching
from marginalia.sources import pubmed


def test_containing(spark):
    r = random.Random(3)
    text = lambda k: "".join(r.choice("abcé 🙂") for _ in range(k))
    parts, wholes = [text(r.randint(0, 6)) for _ in range(150)] + [None, "", "a", "the journal of"], [text(r.randint(0, 30)) for _ in range(150)] + [None, "", "in the journal of it"]
    got = matching.containing(spark.createDataFrame([(p,) for p in parts], "part string"), spark.createDataFrame([(w,) for w in wholes], "whole string"))
    want = {(p, w) for p in parts if p for w in wholes if w and p in w}
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_short_names(spark):
    names = spark.createDataFrame([("nature", "Nat"), ("journal of nature", "J Nat"), ("the new journal of nature studies", "NJNS"), ("zz", "Z"), ("", "none")], "name string, short string")
    items = spark.createDataFrame([(1, "Nature"), (2, "A Journal of Nature"), (3, "journal"), (4, "Fizz"), (5, "Other"), (6, ""), (7, None)], "id long, journal string")
    found = matching.journal_short(items, names)
    assert {r["id"]: r["short"] for r in found.collect()} == {1: "Nat", 2: "J Nat", 3: "NJNS", 4: "Z", 5: "Other", 6: "", 7: None}
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_many_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("journal of subject "), F.lower(F.hex(F.xxhash64("id")))).alias("name"), F.col("id").cast("string").alias("short"))
    items = spark.range(1000).select("id", F.concat(F.lit("The Journal of Subject "), F.hex(F.xxhash64("id")), F.lit(" today")).alias("journal"))
    got = matching.journal_short(items, names).where(F.col("short") == F.col("id").cast("string"))
    assert got.count() == 1000


def test_records_of_articles(spark):
    article = "<PubmedArticle><MedlineCitation><Article>{}</Article></MedlineCitation><PubmedData><ArticleIdList>{}</ArticleIdList></PubmedData></PubmedArticle>"
    whole = lambda *a: "<PubmedArticleSet>" + "".join(a) + "</PubmedArticleSet>"
    rows = [
        (1, whole(article.format("<ArticleTitle> A &amp; B </ArticleTitle>", ""), article.format("<ArticleTitle>C</ArticleTitle><AuthorList><Author><LastName>X</LastName></Author></AuthorList>", '<ArticleId IdType="doi">10.1/c</ArticleId><ArticleId IdType="doi">10.1/d</ArticleId>'))),
        (2, whole(article.format("<Journal><JournalIssue><PubDate><Year>19x</Year></PubDate></JournalIssue></Journal><ArticleTitle>D</ArticleTitle>", ""))),
        (3, "no xml <"), (4, ""), (5, None), (6, "<PubmedArticleSet/>"), (7, whole(article.format("<Pagination/>", ""))),
    ]
    got = pubmed.records(spark.createDataFrame(rows, "id long, xml string"), ["id"], "xml").orderBy("id", "article_no").collect()
    assert [(r.id, r.article_no, r.title, r.doi, r.year) for r in got] == [
        (1, 0, "A & B", "", None), (1, 1, "C", "10.1/c", None), (2, 0, "D", "", None), *[(i, None, None, None, None) for i in (3, 4, 5, 6, 7)]
    ]
    assert [tuple(a) for a in got[1].author] == [("", "X")] and got[0].author == [] and got[0].volume == "" and got[3].author is None


def test_findings_on_documents(spark):
    refs = spark.createDataFrame(
        [(1, 0, "Smith", "2001", "Smith, J.", []), (1, 1, "Lee et al.", "2002", "Lee, K., Ray, P., & Fox, M.", []), (1, 2, "Group", "2003", "Group", ["GRP"]), (1, 3, "Unread", "1999", None, []), (2, 0, "Only", "2000", "Only, O.", [])],
        "doc_id long, ref_pos long, author string, year string, full_author string, abbreviations array<string>",
    )
    cites = spark.createDataFrame(
        [(1, 1, "Smith et al.", "2001"), (1, 2, "Lee et al.", "2002"), (1, 3, "GRP", "2003"), (1, 4, "Smith", "1990"), (1, 5, "Nobody", "2001"), (3, 6, "Alone", "2001")],
        "doc_id long, cite_id long, author string, year string",
    )
    got = {(r.doc_id, r.finding, r.cite_id, r.ref_pos) for r in matching.validation(cites, refs).collect()}
    assert got == {
        (1, "valid", 1, 0), (1, "et al error", 1, 0), (1, "valid", 2, 1), (1, "valid", 3, 2), (1, "year mismatch", 4, 0),
        (1, "missing", 5, None), (1, "unused", None, 3), (2, "unused", None, 0), (3, "missing", 6, None),
    }
    assert not matching.validation(cites.limit(0), refs.limit(0)).collect()
