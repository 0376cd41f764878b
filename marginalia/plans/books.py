"""Documents as books of XML: sections of ten lines, tables in tables, figures after the first line that cites them, as one text each."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marginalia.operators import assembly
from marginalia.plans.sqlquery import run_sql
from marginalia.sources.shipping import ship

#: A node's columns but for its document.
NODES = """SELECT doc_id, n.* FROM (SELECT doc_id, line, k FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS k, line) LATERAL VIEW explode(filter(array(
  named_struct('node_id', CASE WHEN k = 0 THEN 'd' END, 'parent_id', cast(NULL AS string), 'depth', 0, 'place', 0L, 'sub', 0L, 'tag', 'book', 'attributes', '', 'text', ''),
  named_struct('node_id', CASE WHEN k % 10 = 0 THEN concat('s', k div 10) END, 'parent_id', 'd', 'depth', 1, 'place', cast(k AS bigint), 'sub', 0L, 'tag', 'sec', 'attributes', concat(' id="s', k div 10, '"'), 'text', ''),
  named_struct('node_id', CASE WHEN k % 7 IN (3, 5) THEN concat('t', k) END, 'parent_id', concat('s', k div 10), 'depth', 2, 'place', cast(k AS bigint), 'sub', 0L, 'tag', 'table', 'attributes', '', 'text', ''),
  named_struct('node_id', CASE WHEN k % 7 = 5 THEN concat('u', k) END, 'parent_id', concat('t', k), 'depth', 3, 'place', cast(k AS bigint), 'sub', 0L, 'tag', 'table', 'attributes', '', 'text', ''),
  named_struct('node_id', concat('p', k), 'parent_id', concat(CASE k % 7 WHEN 3 THEN 't' WHEN 5 THEN 'u' ELSE 's' END, CASE WHEN k % 7 IN (3, 5) THEN k ELSE k div 10 END), 'depth', CASE k % 7 WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE 2 END,
    'place', cast(k AS bigint), 'sub', 0L, 'tag', 'p', 'attributes', concat(' id="p', k, '"'), 'text', line)), n -> n.node_id IS NOT NULL)) u AS n"""

#: The depth of lines in tables of tables; figures stand beside lines.
DEEPEST = 4

FIGURES = """SELECT doc_id, concat('f', k) AS node_id, 'fig' AS tag, concat(' id="f', k, '"') AS attributes, line AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS k, line WHERE k % 9 = 4"""
CITES = """SELECT doc_id, concat('f', k - back) AS float_id, concat('p', k) AS node_id FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) t AS k, line LATERAL VIEW explode(array(3, 5)) b AS back WHERE k >= back AND (k - back) % 9 = 4"""


def books(spark: SparkSession, d: str) -> DataFrame:
    nodes, figures, cites = (run_sql(spark, d, text) for text in (NODES, FIGURES, CITES))
    return assembly.assembled(assembly.floated(nodes, figures, cites), DEEPEST)


FOUND = ["paras", "tables", "sections", "figures"]


@F.pandas_udf(StructType([StructField(name, LongType()) for name in FOUND]))
def found(xml: pd.Series) -> pd.DataFrame:
    """What a reader of XML finds in each text, which is read once."""

    def one(text: str) -> tuple[int, int, int, int]:
        top = ElementTree.fromstring(text)
        paras, tables, figures = (sum(1 for _ in top.iter(tag)) for tag in ("p", "table", "fig"))
        return paras, tables, len(top.findall("sec")), figures

    return pd.DataFrame([one(text) for text in xml], columns=FOUND)


def counted(spark: SparkSession, d: str) -> DataFrame:
    """What a reader of XML finds in the books."""
    return books(ship(spark), d).select("doc_id", found("xml").alias("n")).select("doc_id", "n.*")


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL"
QUERIES = {"pipe09_books": books, "pipe09_book_counts": counted}
ORACLES = {
    "pipe09_books": f"""WITH l AS (SELECT doc_id, k, n, replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#13;') AS x FROM ({LINES})),
f AS (SELECT doc_id, k, n, '<fig id="f' || k || '">' || x || '</fig>' AS fig FROM l WHERE k % 9 = 4),
e AS (SELECT l.doc_id, l.k, '<p id="p' || l.k || '">' || x || '</p>' || coalesce(fig, '') AS p FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.k = l.k - 3),
s AS (SELECT doc_id, k // 10 AS s, '<sec id="s' || (k // 10) || '">' || string_agg(CASE k % 7 WHEN 3 THEN '<table>' || p || '</table>' WHEN 5 THEN '<table><table>' || p || '</table></table>' ELSE p END, '' ORDER BY k) || '</sec>' AS sec FROM e GROUP BY doc_id, k // 10),
t AS (SELECT doc_id, string_agg(fig, '' ORDER BY 'f' || k) AS rest FROM f WHERE k + 3 >= n GROUP BY doc_id)
SELECT s.doc_id, '<book>' || string_agg(sec, '' ORDER BY s) || coalesce(any_value(rest), '') || '</book>' AS xml FROM s LEFT JOIN t ON s.doc_id = t.doc_id GROUP BY s.doc_id""",
    "pipe09_book_counts": f"SELECT doc_id, count(*) AS paras, (count(*) FILTER (k % 7 = 3) + 2 * count(*) FILTER (k % 7 = 5))::BIGINT AS tables, max(k) // 10 + 1 AS sections, count(*) FILTER (k % 9 = 4) AS figures FROM ({LINES}) GROUP BY doc_id",
}
