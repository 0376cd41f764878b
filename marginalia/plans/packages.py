"""Word packages: documents written as packages, by Spark's strings, and read again as paragraphs, comments, notes and breaks.

A document's lines are paragraphs, some in tables and in tables of their cells, with notes, breaks and comments by their places. The
twins are made of the lines and read no package. A null text is no package, so a row with an error and no parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.assembly import escaped
from marginalia.sources import docx
from marginalia.sources.shipping import ship
from marginalia.sources.tables import table

NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def run(inner: Column | str) -> Column:
    return F.concat(F.lit("<w:r>"), F.lit(inner) if isinstance(inner, str) else inner, F.lit("</w:r>"))


def words(text: Column) -> Column:
    return F.concat(F.lit('<w:t xml:space="preserve">'), text, F.lit("</w:t>"))


def paragraph(line: Column, k: Column) -> Column:
    """Line number k: its text with notes and breaks, below one table if k % 7 is 3 and two if it is 5."""
    when = lambda test, inner: F.when(test, run(inner)).otherwise("")
    p = F.concat(
        F.lit("<w:p>"), F.when(k == 0, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>').otherwise(""), run(words(escaped(line))),
        when(k % 6 == 2, '<w:footnoteReference w:id="1"/>'), when(k % 9 == 4, '<w:endnoteReference w:id="1"/>'),
        when(k % 4 == 1, "<w:lastRenderedPageBreak/>"), when(k % 5 == 0, '<w:br w:type="page"/>'), F.lit("</w:p>"),
    )
    cell = lambda inner: F.concat(F.lit("<w:tbl><w:tr><w:tc>"), inner, F.lit("</w:tc></w:tr></w:tbl>"))
    return F.when(k % 7 == 3, cell(p)).when(k % 7 == 5, cell(cell(p))).otherwise(p)


def written(docs: DataFrame) -> DataFrame:
    """(path, content): the package of each of the documents (doc_id, source, text), with a comment on every tenth line."""
    lines = F.split("text", "\n")
    body = F.array_join(F.transform(lines, paragraph), "")
    author = lambda k: F.when((F.col("doc_id") + k) % 3 == 0, "").otherwise(F.concat(F.lit(' w:author="'), F.col("source"), F.lit('"')))
    comment = lambda line, k: F.when(k % 10 == 0, F.concat(F.lit("<w:comment"), author(k), F.lit("><w:p>"), run(words(escaped(line))), F.lit("</w:p></w:comment>"))).otherwise("")
    document = F.concat(F.lit(f"<w:document {NAMESPACE}><w:body>"), body, F.lit("<w:sectPr/></w:body></w:document>"))
    notes = F.concat(F.lit(f"<w:comments {NAMESPACE}>"), F.array_join(F.transform(lines, comment), ""), F.lit("</w:comments>"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), docx.packed(document, notes).alias("content"))


def read(rows, *columns: str):
    """A query: `rows` of the packages of all documents, named by document."""

    def ask(spark: SparkSession, d: str) -> DataFrame:
        found = docx.packages(written(table(ship(spark), d, "documents")), with_runs=False)
        return rows(found).select(F.col("path").cast("long").alias("doc_id"), *columns)

    return ask


LINES = "SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents WHERE text IS NOT NULL"
SAID = "line || CASE WHEN k % 5 = 0 THEN chr(10) ELSE '' END AS text"
DEPTH = "CASE k % 7 WHEN 3 THEN 1 WHEN 5 THEN 2 ELSE 0 END"

QUERIES = {
    "src02_body_paragraphs": read(docx.body_texts, "para_no", "text"),
    "src04_table_paragraphs": read(docx.table_texts, "para_no", "in_table", "text"),
    "src05_nested_blocks": read(docx.paragraphs, "para_no", "depth", "style"),
    "src08_comments": read(docx.comments, "comment_no", "author", "text", "page"),
    "src09_notes": read(docx.media, "footnotes", "endnotes", "sections"),
    "src22_page_breaks": read(lambda found: docx.paragraphs(found).where("page_breaks > 0"), "para_no", "page_breaks"),
}
ORACLES = {
    "src02_body_paragraphs": f"SELECT doc_id, k + 1 AS para_no, {SAID} FROM ({LINES}) WHERE {DEPTH} = 0",
    "src04_table_paragraphs": f"SELECT doc_id, k + 1 AS para_no, {DEPTH} = 1 AS in_table, {SAID} FROM ({LINES}) WHERE {DEPTH} < 2",
    "src05_nested_blocks": f"SELECT doc_id, k + 1 AS para_no, {DEPTH} AS depth, CASE WHEN k = 0 THEN 'Heading1' ELSE 'Normal' END AS style FROM ({LINES})",
    "src08_comments": f"SELECT doc_id, k // 10 + 1 AS comment_no, CASE WHEN (doc_id + k) % 3 = 0 THEN 'Unknown' ELSE source END AS author, line AS text, 'See Context' AS page FROM ({LINES}) WHERE k % 10 = 0",
    "src09_notes": f"SELECT doc_id, count(*) FILTER (k % 6 = 2) AS footnotes, count(*) FILTER (k % 9 = 4) AS endnotes, 1::BIGINT AS sections FROM ({LINES}) GROUP BY doc_id",
    "src22_page_breaks": f"SELECT * FROM (SELECT doc_id, k + 1 AS para_no, (k % 4 = 1)::BIGINT + (k % 5 = 0)::BIGINT AS page_breaks FROM ({LINES})) WHERE page_breaks > 0",
}
