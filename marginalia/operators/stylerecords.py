"""Bibliographic records from the character styles of a reference's runs.

Copy editors mark the parts of a reference by styles; a record gathers the runs of each part. One shuffle, on the
paragraph's key: names, parts and records all group within it.

Runs without text or with no style of a part are passed over, a null style too. A paragraph without any styled run has no
record. Parts that stay blank are null. Runs that share a number stand in the order of their texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The part that a run belongs to, by what its style's name holds; the first that fits.
PARTS = [
    ("family", ["bib_surname", "bib_ed-surname"]),
    ("given", ["bib_fname", "bib_ed-fname"]),
    ("etal", ["bib_etal", "bib_ed-etal"]),
    ("year", ["bib_year", "bib_confdate"]),
    ("title", ["bib_title", "bib_chaptertitle", "bib_article", "bib_confpaper"]),
    ("container", ["bib_journal", "bib_confproceedings", "bib_conference"]),
    ("volume", ["bib_volume", "bib_volcount"]),
    ("issue", ["bib_issue", "bib_number"]),
    ("page", ["bib_pages", "bib_fpage", "bib_lpage", "bib_pagecount"]),
    ("doi", ["bib_doi"]),
    ("url", ["bib_url", "bib_extlink"]),
    ("publisher", ["bib_publisher", "bib_institution", "bib_organization", "bib_school"]),
    ("book", ["bib_book"]),
]
#: "et al." stands for authors enough that every style shortens them.
AT_LEAST_WITH_ET_AL = 4


def part_of(style: Column) -> Column:
    """The part that a style marks, or null."""
    name = F.lower(style)
    return F.coalesce(*[F.when(name.rlike("|".join(marks)), part) for part, marks in PARTS])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def records(runs: DataFrame, key: list[str]) -> DataFrame:
    """A record for each paragraph `key` of runs (run_no, style, text): an item as the formatters take it, and has_etal.

    A name ends where the next family name follows a given name, and at any run of another part. The title of a book counts as
    title; a publisher too makes a journal article a book.
    """
    in_order = Window.partitionBy(*key).orderBy("run_no", "text")
    marked = runs.select(*key, "run_no", "text", part_of(F.col("style")).alias("part")).where("text != '' AND part IS NOT NULL")
    before, is_name = F.coalesce(F.lag("part").over(in_order), F.lit("")), F.col("part").isin("family", "given")
    opens = is_name & (~before.isin("family", "given") | ((F.col("part") == "family") & (before == "given")))
    named = marked.withColumn("name_no", F.sum(opens.cast("int")).over(in_order)).withColumn("name_no", F.when(is_name, F.col("name_no")))

    spot = F.struct("run_no", "text")
    text_of = lambda *parts: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part").isin(*parts), spot))), lambda r: r["text"]), "")
    whole = F.when(F.col("part") == "book", "title").when(~is_name, F.col("part"))
    pieces = named.groupBy(*key, "name_no", whole.alias("whole")).agg(
        text_of("given").alias("given"), text_of("family").alias("family"), F.array_join(F.transform(F.sort_array(F.collect_list(spot)), lambda r: r["text"]), "").alias("value"), F.max(F.col("part") == "book").alias("is_book")
    )
    value = lambda part: F.max(F.when(F.col("whole") == part, F.col("value")))
    name = F.when(F.col("name_no").isNotNull(), F.struct("name_no", stripped(F.col("given")).alias("given"), stripped(F.col("family")).alias("family")))
    rows = pieces.groupBy(*key).agg(
        F.transform(F.sort_array(F.collect_list(name)), lambda a: F.struct(a["given"].alias("given"), a["family"].alias("family"))).alias("author"),
        *[value(p).alias(p) for p in ("year", "title", "container", "volume", "issue", "page", "doi", "url", "publisher")],
        F.max(F.coalesce(F.col("whole") == "etal", F.lit(False))).alias("has_etal"), F.max("is_book").alias("is_book"),
    )
    blank = F.struct(F.lit("").alias("given"), F.lit("").alias("family"))
    padded = F.when(F.col("has_etal"), F.concat("author", F.array_repeat(blank, F.greatest(F.lit(0), AT_LEAST_WITH_ET_AL - F.size("author"))))).otherwise(F.col("author"))
    tidy = {p: filled(stripped(F.col(p))) for p in ("title", "container", "volume", "page", "doi", "url", "publisher")}
    tidy |= {"year": filled(F.regexp_replace("year", r"[^0-9]", "")), "issue": filled(F.regexp_replace(stripped(F.col("issue")), "[()]", ""))}
    kind = F.when(F.col("is_book") | tidy["publisher"].isNotNull(), "book").otherwise("journal-article")
    return rows.select(*key, kind.alias("type"), padded.alias("author"), *[tidy[p].alias(p) for p in ("title", "container", "volume", "issue", "page", "publisher", "doi", "url", "year")], "has_etal")
