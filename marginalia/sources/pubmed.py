"""Records of articles from PubMed's XML, a text of XML a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import settled

SCHEMA = """
PubmedArticle array<struct<
  MedlineCitation: struct<Article: struct<
    ArticleTitle: string,
    Journal: struct<Title: string, ISOAbbreviation: string, JournalIssue: struct<Volume: string, Issue: string, PubDate: struct<Year: string, MedlineDate: string>>>,
    Pagination: struct<MedlinePgn: string>,
    AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, Initials: string>>>,
    ArticleDate: array<struct<Year: string>>>>,
  PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_IdType: string, _VALUE: string>>>>>>
"""


def records(rows: DataFrame, keep: list[str], xml: str) -> DataFrame:
    """(keep, article_no, author, title, container, iso_abbrev, volume, issue, page, doi, year): a row for each article with a title.

    Markup within a title is taken off. The year is that of the issue, else of the article's own date, else the first from 1900 to 2099 in the
    issue's date as it is written. The given name is the fore name, else the initials; authors without a last name (groups) are left
    out. What is missing is an empty text, a missing year null. XML that can't be read, or without such an article, gives a row of nulls.
    """
    parsed = F.from_xml(xml, SCHEMA, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})
    found = settled(rows, keep, x=parsed)
    articles = F.filter("x.PubmedArticle", lambda a: a["MedlineCitation"]["Article"]["ArticleTitle"].isNotNull())
    each = found.select(*keep, F.posexplode_outer(articles).alias("n", "a"))
    article, ids = F.col("a.MedlineCitation.Article"), F.col("a.PubmedData.ArticleIdList.ArticleId")
    journal, there = article["Journal"], F.col("a").isNotNull()
    clean = lambda c: F.coalesce(F.btrim(c, F.lit(" \t\r\n")), F.lit(""))
    said = lambda c: F.nullif(clean(c), F.lit(""))
    year = F.coalesce(
        said(journal["JournalIssue"]["PubDate"]["Year"]),
        said(F.get(article["ArticleDate"], F.lit(0))["Year"]),
        F.nullif(F.regexp_extract(journal["JournalIssue"]["PubDate"]["MedlineDate"], r"\b(?:19|20)\d{2}\b", 0), F.lit("")),
    )
    named = F.filter(F.coalesce(article["AuthorList"]["Author"], F.array()), lambda a: a["LastName"].isNotNull())
    authors = F.transform(named, lambda a: F.struct(F.coalesce(said(a["ForeName"]), clean(a["Initials"])).alias("given"), clean(a["LastName"]).alias("family")))
    doi = F.get(F.filter(ids, lambda i: (F.lower(i["_IdType"]) == "doi") & (clean(i["_VALUE"]) != "")), F.lit(0))["_VALUE"]
    title = F.regexp_replace(article["ArticleTitle"], "<[^>]*>", "")
    texts = {
        "title": title, "container": journal["Title"], "iso_abbrev": journal["ISOAbbreviation"], "volume": journal["JournalIssue"]["Volume"],
        "issue": journal["JournalIssue"]["Issue"], "page": article["Pagination"]["MedlinePgn"], "doi": doi,
    }
    shown = [F.when(there, clean(c)).alias(n) for n, c in texts.items()]
    return each.select(*keep, F.col("n").cast("long").alias("article_no"), F.when(there, authors).alias("author"), *shown, F.when(year.rlike(r"^\d{1,9}$"), year).cast("int").alias("year"))
