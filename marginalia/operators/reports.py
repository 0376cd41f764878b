"""Reports and job rows as DataFrames, ready for any writer, and the two that write more than a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What endings of style names stand for.
STYLE_ENDINGS = {"surname": "bib_surname", "fname": "bib_fname", "year": "bib_year", "title": "bib_article", "journal": "bib_journal", "number": "bib_number", "doi": "bib_doi"}


def file_and_result(files: DataFrame, results: DataFrame, first_id: Column) -> tuple[DataFrame, DataFrame]:
    """Rows to append for files and their results: `first_id` and the file's place give the key, which the result refers to.

    `files` and `results` both have `no`, the place of the file in its batch.
    """
    keyed = files.withColumn("id", first_id + F.col("no"))
    return keyed.drop("no"), results.join(keyed.select("no", F.col("id").alias("file_id")), "no").drop("no")


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """A table with rows at its end, columns met by name; what a row lacks is null."""
    return table.unionByName(rows, allowMissingColumns=True)


def bias_report(findings: DataFrame, filename: Column) -> DataFrame:
    """The five columns of the findings' report, in its order of pages, categories and terms."""
    rows = findings.select(filename.alias("filename"), F.col("page").alias("page_number"), "category", "term", "sentence")
    return rows.orderBy("filename", "page_number", "category", "term", "sentence")


def text_report(issues: DataFrame, by: str = "doc_id") -> DataFrame:
    """(by, report): issues (section, detail) of each document as text, sections in order with their number, then details."""
    each = issues.groupBy(by, "section").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("detail")), lambda d: F.concat(F.lit("  - "), d)), "\n").alias("lines"))
    block = F.concat(F.col("section"), F.lit(" ("), F.col("n"), F.lit(")\n"), F.col("lines"))
    blocks = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", block.alias("block")))), lambda b: b["block"]), "\n\n")
    return each.groupBy(by).agg(blocks.alias("report"))


def cache_lines(items: DataFrame, key: str, value: str) -> DataFrame:
    """A lookup cache as lines of JSON, one for each key; the greatest value of a key stays."""
    return items.groupBy(key).agg(F.max(value).alias(value)).select(F.to_json(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))).alias("line"))


def segment_runs(rows: DataFrame, keys: list[str], segments: str) -> DataFrame:
    """(keys, run_no, text, style): styled segments as runs; a style's ending names the character style, others are plain."""
    each = rows.select(*keys, F.posexplode(segments).alias("run_no", "s")).where("s.text <> ''")
    ending = F.lower(F.regexp_extract(F.coalesce("s.style", F.lit("")), r"([A-Za-z]+)$", 1))
    names = F.create_map(*[F.lit(x) for pair in STYLE_ENDINGS.items() for x in pair])
    return each.select(*keys, "run_no", "s.text", F.try_element_at(names, ending).alias("style"))
