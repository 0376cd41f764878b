"""Numeric citations: audit, numbering, ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marginalia.functions.numbers import BRACKETED, CARET, LEADING_NUMBER, NUMERIC_RUN, format_numbers, id_rows
from marginalia.plans.sqlquery import run_sql
from marginalia.sources.tables import table

#: Citations of a document (customer) in text order, built from its order lines.
CITES = """
cites AS (
  SELECT o_custkey AS doc_id, l_suppkey % 10 + 1 AS cited_id,
         row_number() OVER (PARTITION BY o_custkey
           ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
bib AS (SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 10 + 1 AS ref_id FROM orders)"""


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, cited_id, pos): one row for each citation, in text order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    order = W.partitionBy("o_custkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("doc_id"), (F.col("l_suppkey") % 10 + 1).alias("cited_id"), F.row_number().over(order).cast("long").alias("pos")
    )


def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ref_id): the numbered references of each document."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 10 + 1).alias("ref_id")).distinct()


def appearance(cites: DataFrame) -> DataFrame:
    """(doc_id, cited_id, first_pos, new_id): each cited id once, numbered by first appearance."""
    first = cites.groupBy("doc_id", "cited_id").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("new_id", F.row_number().over(W.partitionBy("doc_id").orderBy("first_pos")).cast("long"))


def numeric_audit(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Missing, unused and out-of-sequence counts of each document."""
    ranked = appearance(cites)
    keys = ranked.join(bib.withColumn("in_bib", F.lit(1)), (ranked.doc_id == bib.doc_id) & (ranked.cited_id == bib.ref_id), "full_outer")
    doc = F.coalesce(ranked.doc_id, bib.doc_id).alias("doc_id")
    return keys.groupBy(doc).agg(
        F.sum(F.when(F.col("in_bib").isNull(), 1).otherwise(0)).cast("long").alias("missing"),
        F.sum(F.when(F.col("cited_id").isNull(), 1).otherwise(0)).cast("long").alias("unused"),
        F.sum(F.when(F.col("cited_id") != F.col("new_id"), 1).otherwise(0)).cast("long").alias("seq_issues"),
    )


def missing_ids(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """Cited, not in the bibliography."""
    ids = cites.select("doc_id", F.col("cited_id").alias("ref_id")).distinct()
    return ids.join(bib, ["doc_id", "ref_id"], "left_anti")


def unused_ids(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """In the bibliography, not cited."""
    return bib.join(cites.select("doc_id", F.col("cited_id").alias("ref_id")), ["doc_id", "ref_id"], "left_anti")


def sequence_issues(cites: DataFrame) -> DataFrame:
    """Ids whose rank of first appearance is another number."""
    return appearance(cites).where("cited_id <> new_id").select("doc_id", F.col("new_id").alias("position"), F.col("cited_id").alias("current"), F.col("new_id").alias("expected"))


def renumbered(cites: DataFrame) -> DataFrame:
    """Every citation with its number by first appearance."""
    return cites.join(appearance(cites).drop("first_pos"), ["doc_id", "cited_id"], "left").select("doc_id", "pos", F.coalesce("new_id", "cited_id").alias("cited_id"))


def reordered(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """The bibliography in order of citation, uncited references after in their own order."""
    new = appearance(cites).select("doc_id", F.col("cited_id").alias("ref_id"), "new_id")
    order = W.partitionBy("doc_id").orderBy(F.col("new_id").isNull(), "new_id", "ref_id")
    return bib.join(new, ["doc_id", "ref_id"], "left").select("doc_id", "ref_id", F.row_number().over(order).cast("long").alias("place"))


def decision(cites: DataFrame, bib: DataFrame) -> DataFrame:
    """What the validation of each document comes to."""
    a = numeric_audit(cites, bib)
    status = F.when(F.col("unused") > 0, "Aborted: unused references").when((F.col("missing") == 0) & (F.col("seq_issues") == 0), "Perfect").when(F.col("missing") > 0, "Aborted: missing references").otherwise("Renumbered")
    return a.select("doc_id", status.alias("status"), ((F.col("missing") + F.col("unused") + F.col("seq_issues")) == 0).alias("is_perfect"))


NUMBER_TEXT = "SELECT p_partkey AS id, concat(cast(p_size AS string), '-', cast(p_size + p_partkey % 5 - 1 AS string), ', ', cast(p_partkey % 9 AS string)) AS text FROM {part}"


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_sql(spark, sf_dir, NUMBER_TEXT)
    return id_rows(rows, ["id"], "text")


def citation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caret and bracket citations, numeric runs and stripped numbering, on texts built around numbers."""
    text = F.concat(F.lit("See ^"), F.col("text"), F.lit("^ and ["), F.col("id"), F.lit("]."))
    rows = run_sql(spark, sf_dir, NUMBER_TEXT)
    return rows.select(
        "id", F.regexp_extract(text, CARET, 1).alias("caret"), F.regexp_extract(F.substring_index(text, "^", -1), BRACKETED, 1).alias("bracket"), F.col("text").rlike(NUMERIC_RUN).alias("is_run"),
        F.regexp_replace(F.concat(F.lit("["), F.col("id"), F.lit("]. Title")), LEADING_NUMBER, "").alias("bare"),
    )


def both(f):
    return lambda spark, d: f(citations(spark, d), bibliography(spark, d))


def cited(f):
    return lambda spark, d: f(citations(spark, d))


RANKED = f"WITH {CITES}, ranked AS (SELECT doc_id, cited_id, min(pos) AS first_pos, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS new_id FROM cites GROUP BY doc_id, cited_id)"
AUDIT = f"""{RANKED}, audit AS (
SELECT doc_id, count(*) FILTER (WHERE ref_id IS NULL) AS missing, count(*) FILTER (WHERE cited_id IS NULL) AS unused, count(*) FILTER (WHERE cited_id <> new_id) AS seq_issues
FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, cited_id, ref_id, new_id FROM ranked a FULL JOIN bib b ON a.doc_id = b.doc_id AND a.cited_id = b.ref_id) GROUP BY doc_id)"""

QUERIES = {
    "win03_jn05_jn06_numeric_audit": both(numeric_audit),
    "jn05_missing_ids": both(missing_ids),
    "jn06_unused_ids": both(unused_ids),
    "set05_both_differences": both(lambda c, b: missing_ids(c, b).withColumn("side", F.lit("missing")).unionByName(unused_ids(c, b).withColumn("side", F.lit("unused")))),
    "win01_first_appearance": cited(lambda c: appearance(c).select("doc_id", "cited_id", "first_pos", "new_id")),
    "win02_renumber_map": cited(lambda c: appearance(c).where("cited_id <> new_id").select("doc_id", "cited_id", "new_id")),
    "win03_sequence_issues": cited(sequence_issues),
    "win04_range_collapse": cited(lambda c: format_numbers(c, "doc_id", "cited_id")),
    "jn21_renumbered_citations": cited(renumbered),
    "srt06_bibliography_order": both(reordered),
    "srt07_sorted_missing": both(lambda c, b: missing_ids(c, b).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("ref_id")), ",").alias("missing"))),
    "agg10_unique_cited": cited(lambda c: c.groupBy("doc_id").agg(F.countDistinct("cited_id").alias("unique_cited"), F.count("*").alias("citations"))),
    "pipe01_numeric_decision": both(decision),
    "fn01_get_numbers": parsed_numbers,
    "fn03_fn06_citation_marks": citation_marks,
}
ORACLES = {
    "win03_jn05_jn06_numeric_audit": AUDIT + " SELECT * FROM audit",
    "jn05_missing_ids": f"WITH {CITES} SELECT DISTINCT doc_id, cited_id AS ref_id FROM cites c WHERE NOT EXISTS (SELECT 1 FROM bib b WHERE b.doc_id = c.doc_id AND b.ref_id = c.cited_id)",
    "jn06_unused_ids": f"WITH {CITES} SELECT doc_id, ref_id FROM bib b WHERE NOT EXISTS (SELECT 1 FROM cites c WHERE b.doc_id = c.doc_id AND b.ref_id = c.cited_id)",
    "set05_both_differences": f"WITH {CITES} SELECT doc_id, cited_id AS ref_id, 'missing' AS side FROM (SELECT doc_id, cited_id FROM cites EXCEPT SELECT * FROM bib) UNION ALL SELECT doc_id, ref_id, 'unused' FROM (SELECT * FROM bib EXCEPT SELECT doc_id, cited_id FROM cites)",
    "win01_first_appearance": RANKED + " SELECT * FROM ranked",
    "win02_renumber_map": RANKED + " SELECT doc_id, cited_id, new_id FROM ranked WHERE cited_id <> new_id",
    "win03_sequence_issues": RANKED + " SELECT doc_id, new_id AS position, cited_id AS current, new_id AS expected FROM ranked WHERE cited_id <> new_id",
    "win04_range_collapse": f"""WITH {CITES}, n AS (SELECT DISTINCT doc_id, cited_id AS n FROM cites), i AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS g FROM n),
r AS (SELECT doc_id, min(n) AS a, max(n) AS z FROM i GROUP BY doc_id, g)
SELECT doc_id, string_agg(CASE WHEN a = z THEN a::VARCHAR WHEN z = a + 1 THEN a || ',' || z ELSE a || '-' || z END, ', ' ORDER BY a) AS shown FROM r GROUP BY doc_id""",
    "jn21_renumbered_citations": RANKED + " SELECT c.doc_id, c.pos, r.new_id AS cited_id FROM cites c JOIN ranked r USING (doc_id, cited_id)",
    "srt06_bibliography_order": RANKED + " SELECT b.doc_id, b.ref_id, row_number() OVER (PARTITION BY b.doc_id ORDER BY new_id IS NULL, new_id, ref_id) AS place FROM bib b LEFT JOIN ranked r ON r.doc_id = b.doc_id AND r.cited_id = b.ref_id",
    "srt07_sorted_missing": f"WITH {CITES}, m AS (SELECT doc_id, cited_id FROM cites EXCEPT SELECT * FROM bib) SELECT doc_id, string_agg(cited_id::VARCHAR, ',' ORDER BY cited_id) AS missing FROM m GROUP BY doc_id",
    "agg10_unique_cited": f"WITH {CITES} SELECT doc_id, count(DISTINCT cited_id) AS unique_cited, count(*) AS citations FROM cites GROUP BY doc_id",
    "pipe01_numeric_decision": AUDIT + """ SELECT doc_id, CASE WHEN unused > 0 THEN 'Aborted: unused references' WHEN missing = 0 AND seq_issues = 0 THEN 'Perfect' WHEN missing > 0 THEN 'Aborted: missing references' ELSE 'Renumbered' END AS status,
missing + unused + seq_issues = 0 AS is_perfect FROM audit""",
    "fn01_get_numbers": """WITH r AS (SELECT p_partkey AS id, list_concat(range(p_size, p_size + p_partkey % 5), [p_partkey % 9]) AS ns FROM part)
SELECT id, unnest(range(len(ns))) AS seq, unnest(ns)::BIGINT AS n FROM r""",
    "fn03_fn06_citation_marks": "SELECT p_partkey AS id, p_size || '-' || (p_size + p_partkey % 5 - 1) || ', ' || (p_partkey % 9) AS caret, p_partkey::VARCHAR AS bracket, true AS is_run, 'Title' AS bare FROM part",
}
