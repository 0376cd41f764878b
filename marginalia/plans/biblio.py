"""Author-year citations, references, fuzzy matching and formatting, on texts built from orders and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import authoryear as A
from marginalia.functions import formatters
from marginalia.operators import matching, stylerecords
from marginalia.plans.sqlquery import run_sql

NAME = "concat(substring(c_mktsegment, 1, 1), lower(substring(c_mktsegment, 2, 20)))"
CITE_TEXT = f"""
SELECT o_custkey AS doc_id, o_orderkey AS para_no,
       CASE o_orderkey % 5 WHEN 0 THEN concat('Shown (', {NAME}, ', ', cast(year(o_orderdate) AS string), ') here.')
         WHEN 1 THEN concat('Shown (', {NAME}, ' ', cast(year(o_orderdate) AS string), ').')
         WHEN 2 THEN concat('Shown (', {NAME}, ' and Other, ', cast(year(o_orderdate) AS string), '; see Third, 2001).')
         WHEN 3 THEN concat({NAME}, ' (', cast(year(o_orderdate) AS string), ') said.')
         ELSE '(p. 12) and (January 2020)' END AS text
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey"""

REF_TEXT = """
SELECT p_partkey AS id, CASE p_partkey % 4
  WHEN 0 THEN concat('Smith, J. (', 1990 + p_size, '). ', p_name, '. Journal, 3(2): 10-19.')
  WHEN 1 THEN concat('Smith, J., & Jones, M. (', 1990 + p_size, '). ', p_name, '. New York: Springer.')
  WHEN 2 THEN concat('Smith, J., Jones, M., & Brown, K. (', 1990 + p_size, '). ', p_name, '. https://doi.org/10.1234/ab.', p_partkey)
  ELSE concat('National Health Group (', 1990 + p_size, '). ', p_name, '. Retrieved from www.example.org') END AS line
FROM {part}"""


def in_text(spark: SparkSession, d: str) -> DataFrame:
    found = A.in_text(run_sql(spark, d, CITE_TEXT))
    return found.select("doc_id", "para_no", "author", "year", "type", F.array_join("warnings", ";").alias("warnings"))


def references(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, REF_TEXT).select("id", A.parsed_reference(F.col("line")).alias("r"))
    return rows.select("id", "r.author", "r.year", "r.full_author", F.array_join("r.abbreviations", ";").alias("abbreviations"))


def match_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A document for each customer of part lines: citations of six kinds, and a bibliography of four."""
    cites = run_sql(spark, d, """
SELECT p_partkey % 200 AS doc_id, p_partkey AS cite_id, cast(2000 + p_partkey % 200 % 7 AS string) AS year,
       CASE p_size % 6 WHEN 0 THEN 'Smith' WHEN 1 THEN 'NHG' WHEN 2 THEN 'Jones et al.' WHEN 3 THEN 'Smyth and Browne' WHEN 4 THEN 'Nobody' ELSE 'The Green & Brown' END AS author
FROM {part}""")
    refs = spark.range(200).select(F.col("id").alias("doc_id"), F.posexplode(F.array(
        *[F.struct(F.lit(a).alias("author"), (2000 + F.col("id") % 7 + dy).cast("string").alias("year"), F.lit(f).alias("full_author"), (F.array(F.lit(b)) if b else F.array().cast("array<string>")).alias("abbreviations"))
          for a, dy, f, b in (("Smith", 0, "Smith, J.", ""), ("National Health Group", 0, "National Health Group", "NHG"), ("Jones et al.", 0, "Jones, M., Lee, K., & Ray, P.", ""), ("Smythe & Browne", 0, "Smythe, A., & Browne, B.", ""), ("Green & Brown", 1, "Green, C., & Brown, D.", ""))]
    )).alias("i", "r")).select("doc_id", F.col("i").cast("long").alias("ref_pos"), "r.*")
    return cites, refs


ITEM = """
SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'book' ELSE 'journal-article' END AS type,
       slice(array(named_struct('given', 'Ann Beth', 'family', 'Smith'), named_struct('given', 'Carl', 'family', 'Jones'), named_struct('given', 'Dee-Eve', 'family', 'Brown')), 1, p_partkey % 4) AS author,
       p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS container, cast(p_size AS string) AS volume, CASE WHEN p_partkey % 2 = 0 THEN '2' END AS issue, '10-19' AS page,
       CASE WHEN p_partkey % 3 = 0 THEN p_type END AS publisher, CASE WHEN p_partkey % 5 = 0 THEN '10.1/x' END AS doi, cast(NULL AS string) AS url, CASE WHEN p_partkey % 7 > 0 THEN '1999' END AS year
FROM {part}"""


def formatted(style):
    def run(spark: SparkSession, d: str) -> DataFrame:
        item = F.struct("type", "author", "title", "container", "volume", "issue", "page", "publisher", "doi", "url", "year")
        rows = run_sql(spark, d, ITEM).withColumn("item", item)
        return rows.select("id", formatters.plain(style(F.col("item"))).alias("citation"))

    return run


def html_shown(spark: SparkSession, d: str) -> DataFrame:
    segments = F.array(F.struct(F.col("p_name").alias("text"), F.lit("bib_article").alias("style")), F.struct(F.concat(F.lit(" <"), "p_brand", F.lit(">")).alias("text"), F.lit("bib_journal").alias("style")))
    return run_sql(spark, d, "SELECT p_partkey AS id, p_name, p_brand FROM {part}").select("id", formatters.html(segments).alias("html"))


def missing(spark: SparkSession, d: str) -> DataFrame:
    item = F.struct("type", "author", "publisher", "doi", "url", "year")
    rows = run_sql(spark, d, ITEM).withColumn("year", F.when(F.col("id") % 7 > 0, F.col("year"))).withColumn("item", item)
    return rows.select("id", F.array_join(formatters.missing_elements(F.col("item")), ", ").alias("missing"))


def how_counts(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_citations(*match_inputs(spark, d)).select("doc_id", "cite_id", "ref_pos", "how")


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings on the same citations, every other Smith of which is cited with et al."""
    cites, refs = match_inputs(spark, d)
    others = F.when((F.col("author") == "Smith") & (F.col("cite_id") % 2 == 1), "Smith et al.").otherwise(F.col("author"))
    return matching.validation(cites.withColumn("author", others), refs)


def part_duplicates(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT p_partkey div 40 AS doc_id, p_partkey, concat(p_name, ' ', p_type, ' ', p_brand) AS text FROM {part}")
    return matching.duplicates(rows, ["doc_id"], "p_partkey", "text")


def candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, """
SELECT p_name AS query, CASE WHEN k % 2 = 0 THEN 'crossref' ELSE 'pubmed' END AS source, p_partkey * 4 + k AS cand_no,
       substring(concat(p_name, ' extra words'), 1 + k, 14) AS title, CASE WHEN (p_partkey + k) % 3 = 0 THEN '10.1/x' END AS doi
FROM {part} LATERAL VIEW explode(sequence(0, 3)) t AS k""")
    return matching.best_candidate(rows)


#: Texts of a document that begin alike and end ever earlier, so that a pair's ratio is known by their lengths, and one of other signs.
SHORTENED = """SELECT p_partkey AS doc_id, k, CASE WHEN k < 6 THEN substring(concat(p_name, ' ', p_type, ' ', p_brand), 1, length(concat(p_name, ' ', p_type, ' ', p_brand)) - 4 * (k * 5 % 6)) ELSE '~~~~ ~~~~' END AS text
FROM {part} LATERAL VIEW explode(sequence(0L, 6L)) t AS k"""

#: Titles that are what a query begins with, of two sources, some with a DOI.
BEGUN = """SELECT p_name AS query, CASE WHEN k % 2 = 0 THEN 'crossref' ELSE 'pubmed' END AS source, p_partkey * 4 + k AS cand_no,
  upper(substring(p_name, 1, length(p_name) - length(p_name) * ((p_partkey + 3 * k) % 6) div 6)) AS title, CASE WHEN (p_partkey + k) % 3 = 0 THEN '10.1/x' END AS doi
FROM {part} LATERAL VIEW explode(sequence(0, 3)) t AS k"""


def shortened_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return matching.duplicates(run_sql(spark, d, SHORTENED), ["doc_id"], "k", "text")


RUNS = """
SELECT p_partkey AS id, run_no, r.style, r.text FROM {part} LATERAL VIEW posexplode(array(
  named_struct('style', 'bib_number', 'text', concat(p_partkey, '.')), named_struct('style', 'bib_surname', 'text', 'Smith'), named_struct('style', CAST(NULL AS string), 'text', ', '),
  named_struct('style', 'bib_fname', 'text', 'J. '), named_struct('style', 'bib_surname', 'text', 'Van '), named_struct('style', 'bib_surname', 'text', 'Dyk'),
  named_struct('style', 'bib_fname', 'text', CASE WHEN p_partkey % 3 > 0 THEN 'A.' ELSE '' END), named_struct('style', CASE WHEN p_partkey % 4 = 0 THEN 'BIB_etal' END, 'text', ' et al.'),
  named_struct('style', 'bib_year', 'text', concat('(', 1990 + p_size, ')')), named_struct('style', CASE WHEN p_partkey % 5 = 0 THEN 'bib_book' ELSE 'bib_title' END, 'text', p_name), named_struct('style', 'bib_title', 'text', ' again '),
  named_struct('style', 'bib_journal', 'text', CASE WHEN p_partkey % 5 > 0 THEN p_brand ELSE ' ' END), named_struct('style', 'bib_fpage', 'text', '10'), named_struct('style', 'bib_lpage', 'text', '-19'),
  named_struct('style', CASE WHEN p_partkey % 7 = 0 THEN 'bib_publisher' ELSE 'x' END, 'text', p_type))) t AS run_no, r"""


def style_records(spark: SparkSession, d: str) -> DataFrame:
    names = F.array_join(F.transform("author", lambda a: F.concat(a["family"], F.lit("/"), a["given"])), "; ").alias("authors")
    return stylerecords.records(run_sql(spark, d, RUNS), ["id"]).select("id", "type", names, "title", "container", "volume", "issue", "page", "publisher", "year", "has_etal")


SQL_YEAR = "year(o_orderdate)::VARCHAR"
PAIRS = f"FROM orders JOIN customer ON o_custkey = c_custkey"
PERSON = "list_slice([{'i': 'A. B.', 'n': 'AB', 'f': 'Smith', 'g': 'Ann Beth'}, {'i': 'C.', 'n': 'C', 'f': 'Jones', 'g': 'Carl'}, {'i': 'D. E.', 'n': 'DE', 'f': 'Brown', 'g': 'Dee-Eve'}], 1, p_partkey % 4) AS a"
YEAR_OR = "CASE WHEN p_partkey % 7 > 0 THEN '1999' ELSE '{}' END"
NONE = "CASE WHEN len(a) = 0 THEN 'Unknown authors' ELSE {} END"

QUERIES = {
    "fn30_fn31_in_text": in_text,
    "fn32_references": references,
    "fn11_doi": lambda s, d: run_sql(s, d, REF_TEXT).select("id", A.doi(F.col("line")).alias("doi")),
    "fn40_reference_type": lambda s, d: run_sql(s, d, REF_TEXT).select("id", A.reference_type(F.col("line")).alias("type")),
    "fn38_et_al": lambda s, d: references(s, d).select("id", A.author_count(F.col("full_author")).alias("n_authors"), A.et_al_issue(F.lit("Smith et al."), F.col("full_author")).alias("with_et_al"), A.et_al_issue(F.lit("Smith"), F.col("full_author")).alias("without")),
    "fn10_first_surname": lambda s, d: references(s, d).select("id", A.first_surname(F.col("full_author")).alias("surname")),
    "fn09_normalized": lambda s, d: references(s, d).select("id", A.normalized(F.col("full_author")).alias("name")),
    "fn41_style_records": style_records,
    "fn43_missing_elements": missing,
    "fn50_apa": formatted(formatters.apa),
    "fn51_ama": formatted(formatters.ama),
    "fn58_html": html_shown,
    "fn52_chicago": formatted(formatters.chicago),
    "jn07_jn08_jn10_jn11_matches": how_counts,
    "pipe02_match_summary": lambda s, d: how_counts(s, d).groupBy("how").agg(F.count("*").alias("n")),
    "pipe02_findings": findings,
    "jn12_duplicate_references": part_duplicates,
    "agg12_jn18_best_candidate": candidates,
    "jn12_fn13_shortened": shortened_duplicates,
    "agg12_jn18_begun_titles": lambda s, d: matching.best_candidate(run_sql(s, d, BEGUN)),
    "agg12_by_title": lambda s, d: matching.by_title(run_sql(s, d, BEGUN).where("source = 'crossref'")),
}

TWIN_BEGUN = """SELECT p_name AS query, CASE WHEN k % 2 = 0 THEN 'crossref' ELSE 'pubmed' END AS source, p_partkey * 4 + k AS cand_no, len(trim(p_name)) AS n,
  len(trim(substring(p_name, 1, len(p_name) - len(p_name) * ((p_partkey + 3 * k) % 6) // 6))) AS m, (p_partkey + k) % 3 = 0 AS has_doi FROM part, range(4) r(k)"""
TWIN_SCORED = f"SELECT *, 2::DOUBLE * m / (m + n) AS alike, 2::DOUBLE * m / (m + n) + CASE WHEN has_doi THEN 0.06::DOUBLE ELSE 0::DOUBLE END AS score FROM ({TWIN_BEGUN})"
ORACLES = {
    "fn30_fn31_in_text": f"""WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS para_no, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) AS s, {SQL_YEAR} AS y, o_orderkey % 5 AS k {PAIRS})
SELECT doc_id, para_no, s AS author, y AS year, 'parenthetical' AS type, CASE k WHEN 1 THEN 'missing comma' ELSE '' END AS warnings FROM t WHERE k IN (0, 1)
UNION ALL SELECT doc_id, para_no, s || ' and Other', y, 'parenthetical', 'and in parentheses' FROM t WHERE k = 2
UNION ALL SELECT doc_id, para_no, 'Third', '2001', 'parenthetical', '' FROM t WHERE k = 2
UNION ALL SELECT doc_id, para_no, s, y, 'narrative', '' FROM t WHERE k = 3""",
    "fn32_references": "SELECT p_partkey AS id, (['Smith', 'Smith & Jones', 'Smith et al.', 'National Health Group'])[p_partkey % 4 + 1] AS author, (1990 + p_size)::VARCHAR AS year, (['Smith, J.', 'Smith, J., & Jones, M.', 'Smith, J., Jones, M., & Brown, K.', 'National Health Group'])[p_partkey % 4 + 1] AS full_author, CASE WHEN p_partkey % 4 = 3 THEN 'NHG' ELSE '' END AS abbreviations FROM part",
    "fn11_doi": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 2 THEN '10.1234/ab.' || p_partkey ELSE '' END AS doi FROM part",
    "fn40_reference_type": "SELECT p_partkey AS id, ([NULL, 'book', NULL, 'web'])[p_partkey % 4 + 1] AS type FROM part",
    "fn38_et_al": "SELECT p_partkey AS id, (CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END)::BIGINT AS n_authors, CASE WHEN p_partkey % 4 = 2 THEN NULL ELSE 'error' END AS with_et_al, CASE WHEN p_partkey % 4 = 2 THEN 'warning' END AS without FROM part",
    "fn10_first_surname": "SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 3 THEN 'National Health Group' ELSE 'Smith' END AS surname FROM part",
    "fn09_normalized": "SELECT p_partkey AS id, (['smith j', 'smith j & jones m', 'smith j jones m & brown k', 'national health group'])[p_partkey % 4 + 1] AS name FROM part",
    "fn41_style_records": """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 'book' ELSE 'journal-article' END AS type,
'Smith/J.; Van Dyk/' || CASE WHEN p_partkey % 3 > 0 THEN 'A.' ELSE '' END || CASE WHEN p_partkey % 4 = 0 THEN '; /; /' ELSE '' END AS authors, p_name || ' again' AS title,
CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS container, NULL::VARCHAR AS volume, p_partkey || '.' AS issue, '10-19' AS page, CASE WHEN p_partkey % 7 = 0 THEN p_type END AS publisher,
(1990 + p_size)::VARCHAR AS year, p_partkey % 4 = 0 AS has_etal FROM part""",
    "fn43_missing_elements": "SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN p_partkey % 3 = 0 AND p_partkey % 7 = 0 THEN 'Year missing' END, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 4 = 0 THEN 'Author/Editor missing' END], lambda x: x IS NOT NULL), ', ') AS missing FROM part",
    "fn50_apa": f"""WITH p AS (SELECT *, {PERSON} FROM part) SELECT p_partkey AS id, {NONE.format("array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 THEN '' WHEN i = len(a) THEN ', & ' ELSE ', ' END || x.f || ', ' || x.i), '')")}
|| ' (' || {YEAR_OR.format('n.d.')} || '). ' || p_name || '.' || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type || '.' ELSE ' ' || p_brand || ', ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '(2)' ELSE '' END || ', 10-19.' END
|| CASE WHEN p_partkey % 5 = 0 THEN ' https://doi.org/10.1/x' ELSE '' END AS citation FROM p""",
    "fn51_ama": f"""WITH p AS (SELECT *, {PERSON} FROM part) SELECT p_partkey AS id, {NONE.format("array_to_string(list_transform(a, lambda x: x.f || ' ' || x.n), ', ')")}
|| '. ' || p_name || '. ' || CASE WHEN p_partkey % 3 = 0 THEN p_type || '; ' || {YEAR_OR.format('n.d')} || '.' ELSE p_brand || '. ' || {YEAR_OR.format('n.d')} || ';' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '(2)' ELSE '' END || ':10-19.' END
|| CASE WHEN p_partkey % 5 = 0 THEN ' doi:10.1/x' ELSE '' END AS citation FROM p""",
    "fn58_html": "SELECT p_partkey AS id, p_name || '<i> <' || p_brand || '></i>' AS html FROM part",
    "fn52_chicago": f"""WITH p AS (SELECT *, {PERSON} FROM part) SELECT p_partkey AS id, {NONE.format("array_to_string(list_transform(a, lambda x, i: CASE WHEN i = 1 THEN x.f || ', ' || x.g ELSE CASE WHEN i = len(a) THEN ', and ' ELSE ', ' END || x.g || ' ' || x.f END), '')")}
|| '. ' || CASE WHEN p_partkey % 3 = 0 THEN p_name || '. ' || p_type || ', ' || {YEAR_OR.format('n.d.')} || '.' ELSE '"' || p_name || '." ' || p_brand || ' ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ', no. 2' ELSE '' END || ' (' || {YEAR_OR.format('n.d.')} || '): 10-19.' END
|| CASE WHEN p_partkey % 5 = 0 THEN ' https://doi.org/10.1/x' ELSE '' END AS citation FROM p""",
    "jn07_jn08_jn10_jn11_matches": "SELECT p_partkey % 200 AS doc_id, p_partkey AS cite_id, (CASE p_size % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN NULL ELSE 4 END)::BIGINT AS ref_pos, (['exact', 'abbreviation', 'exact', 'spelling', 'missing', 'year mismatch'])[p_size % 6 + 1] AS how FROM part",
    "pipe02_match_summary": "SELECT (['exact', 'abbreviation', 'exact', 'spelling', 'missing', 'year mismatch'])[p_size % 6 + 1] AS how, count(*) AS n FROM part GROUP BY how",
    "pipe02_findings": """WITH c AS (SELECT p_partkey % 200 AS doc_id, p_partkey AS cite_id, p_size % 6 AS k, (CASE p_size % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN NULL ELSE 4 END)::BIGINT AS ref_pos FROM part)
SELECT doc_id, (['valid', 'valid', 'valid', 'spelling', 'missing', 'year mismatch'])[k + 1] AS finding, cite_id, ref_pos FROM c UNION ALL SELECT doc_id, 'et al error', cite_id, ref_pos FROM c WHERE k = 0 AND cite_id % 2 = 1
UNION ALL SELECT d.doc_id, 'unused', NULL, r.ref_pos FROM range(200) d(doc_id), range(5) r(ref_pos) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = d.doc_id AND c.ref_pos = r.ref_pos)""",
    "jn12_fn13_shortened": """WITH t AS (SELECT p_partkey AS doc_id, k, len(trim(substring(s, 1, len(s) - 4 * (k * 5 % 6)))) AS n FROM (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS s FROM part), range(6) r(k))
SELECT doc_id, b.k AS id, a.k AS duplicate_of, round(2::DOUBLE * least(a.n, b.n) / (a.n + b.n) * 100, 1) AS score FROM t a JOIN t b USING (doc_id) WHERE a.k < b.k AND 2::DOUBLE * least(a.n, b.n) / (a.n + b.n) > 0.85""",
    "agg12_jn18_begun_titles": f"""WITH s AS ({TWIN_SCORED}), b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, source, cand_no) AS r FROM s),
c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY alike DESC, cand_no) AS r FROM s WHERE source = 'crossref'),
w AS (SELECT b.query, b.score >= 0.6 AS enough, b.source = 'pubmed' AND c.alike + 0.02::DOUBLE >= b.score AND c.has_doi AS yields, b.cand_no AS b_no, c.cand_no AS c_no, b.score AS b_score, c.alike AS c_score, b.source AS b_source FROM b JOIN c ON b.query = c.query AND b.r = 1 AND c.r = 1)
SELECT query, CASE WHEN yields THEN 'crossref' ELSE b_source END AS source, CASE WHEN yields THEN c_no ELSE b_no END AS cand_no, round(CASE WHEN yields THEN c_score ELSE b_score END, 6) AS score FROM w WHERE enough""",
    "agg12_by_title": f"SELECT query, cand_no, round(alike, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY alike DESC, cand_no) AS r FROM ({TWIN_SCORED}) WHERE source = 'crossref') WHERE r = 1",
}
