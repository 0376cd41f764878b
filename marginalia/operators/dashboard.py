"""The manuscript dashboard: what each document has of captions, citations, media, notes, comments and odd characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import escape_html
from marginalia.operators import captions, highlighting

# Styles of captions, what a caption begins with, its most lines; paragraphs of a page.
CAPTION_STYLES = ["fig-leg", "fgc", "t1", "tt", "figurelegend", "tablecaption", "cs-ttl", "nbx1-num", "nbx1-ttl", "nbx2-num", "nbx2-ttl", "exhibitcaption"]
CAPTION_STARTS = ["figure", "fig.", "table", "tab.", "box", "exhibit", "appendix", "case study"]
MOST_LINES, PARAS_A_PAGE = 7, 40
KINDS = ["Figure", "Table"]


def is_caption(text: Column, style: Column) -> Column:
    """A paragraph in a caption's style, or one of up to seven lines that begins as captions do."""
    low = F.lower(F.btrim(captions.plain_dashes(text), F.lit(" \t\r\n")))
    starts = F.lit(False)
    for s in CAPTION_STARTS:
        starts = starts | low.startswith(s)
    styled = F.coalesce(F.lower(F.btrim(style)).isin(CAPTION_STYLES), F.lit(False))
    return styled | (starts & (F.size(F.split(low, r"\n|\r\n?")) <= MOST_LINES))


def page_of(para_no: Column) -> Column:
    """A page by position: forty paragraphs, counted from 1; what is numbered below 1 is on the first."""
    return (F.floor(F.greatest(para_no - 1, F.lit(0)) / PARAS_A_PAGE) + 1).cast("long")


def extracted(paras: DataFrame) -> DataFrame:
    """(doc_id, para_no, text, page, is_caption, is_highlighted) of paragraphs with text; `paras` has style and highlighted."""
    text = F.btrim("text", F.lit(" \t\r\n"))
    rows = paras.where(text != "")
    return rows.select("doc_id", "para_no", text.alias("text"), page_of(F.col("para_no")).alias("page"), is_caption(F.col("text"), F.col("style")).alias("is_caption"), F.coalesce("highlighted", F.lit(False)).alias("is_highlighted"))


def summary(items: DataFrame) -> DataFrame:
    """(doc_id, item_type, captions, citations, missing_captions, missing_citations, complete) of figures and tables.

    Numbers are compared in lower case with points for dashes, each once.
    """
    number = F.lower(F.btrim(F.replace("item_no", F.lit("-"), F.lit("."))))
    each = items.where(F.col("item_type").isin(KINDS)).groupBy("doc_id", "item_type", number.alias("no")).agg(F.max(F.col("is_caption").cast("int")).alias("cap"), F.max((~F.col("is_caption")).cast("int")).alias("cit"))
    long_sum = lambda c: F.sum(c).cast("long")
    out = each.groupBy("doc_id", "item_type").agg(
        long_sum("cap").alias("captions"), long_sum("cit").alias("citations"), long_sum(F.col("cit") * (1 - F.col("cap"))).alias("missing_captions"), long_sum(F.col("cap") * (1 - F.col("cit"))).alias("missing_citations")
    )
    total = F.greatest("captions", "citations")
    return out.withColumn("complete", F.round((total - F.col("missing_captions") - F.col("missing_citations")) / total * 100, 1))


def dashboard(paras: DataFrame, comments: DataFrame, media: DataFrame) -> DataFrame:
    """One row for each document of `paras`: its figures and tables as the summary has them, paragraphs, pages, highlighted
    paragraphs, instructions, script pages, comments (doc_id rows), and images, footnotes, endnotes (one `media` row each)."""
    rows = extracted(paras)
    base = rows.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max("page").alias("pages"), F.count_if("is_highlighted").alias("highlighted"), F.sum(F.regexp_count("text", F.lit(highlighting.INSTRUCTION))).cast("long").alias("instructions"))
    long_or_0 = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    names = ("captions", "citations", "missing_captions", "missing_citations")
    wide = summary(captions.items(rows)).groupBy("doc_id").pivot("item_type", KINDS).agg(*[F.first(n).alias(n) for n in names])
    said = comments.groupBy("doc_id").agg(F.count("*").alias("comments"))
    joined = base.join(wide, "doc_id", "left").join(said, "doc_id", "left").join(media, "doc_id", "left")
    return joined.select("doc_id", "paragraphs", "pages", "highlighted", "instructions", *[long_or_0(f"{k}_{n}") for k in KINDS for n in names], *[long_or_0(c) for c in ("comments", "images", "footnotes", "endnotes")])


def formatting_audit(marks: DataFrame, media: DataFrame) -> DataFrame:
    """(doc_id, page, category, detail): struck and hidden runs by their first fifty characters, and a document's sections.

    `marks` has doc_id, para_no, text, struck, hidden; `media` doc_id and sections. A section has no page.
    """
    head = F.substring("text", 1, 50).alias("detail")
    runs = lambda name, c: marks.where(c).select("doc_id", page_of(F.col("para_no")).alias("page"), F.lit(name).alias("category"), head)
    parts = media.where("sections > 0").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("sections").cast("long"))).alias("n"))
    breaks = parts.select("doc_id", F.lit(None).cast("long").alias("page"), F.lit("Section Break").alias("category"), F.concat(F.lit("Section "), "n").alias("detail"))
    return runs("Strikethrough", "struck").unionByName(runs("Hidden", "hidden")).unionByName(breaks)


def html_table(rows: DataFrame, columns: list[str], by: str, order: list[str]) -> DataFrame:
    """(by, html): the rows of each `by` as an HTML table in order, cells escaped."""
    cell = lambda c: F.concat(F.lit("<td>"), escape_html(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))
    line = F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>"))
    head = "<table><thead><tr>" + "".join(f"<th>{c}</th>" for c in columns) + "</tr></thead><tbody>"
    body = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda r: r["line"])
    return rows.groupBy(by).agg(F.concat(F.lit(head), F.array_join(body, ""), F.lit("</tbody></table>")).alias("html"))
