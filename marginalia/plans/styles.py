"""Citation styles other than author-year with commas, and reference structuring, on texts built from parts.

Texts vary by name, year and shape of sentence; the twins are made of the same ingredients and parse nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import authoryear as A
from marginalia.functions import formatters
from marginalia.functions import otherstyles as O
from marginalia.operators import structuring as S
from marginalia.plans.sqlquery import run_sql, twin
from marginalia.sources.tables import table

NAMES = "Smith,Jones,Brown,Garcia,Miller,Davis,Wilson,Moore,Taylor,Lee,Harris,Clark,Lewis,Young,Walker"


def name(number: str) -> str:
    return f"split_part('{NAMES}', ',', cast(({number}) % 15 + 1 AS int))"


#: Three names, two years and a shape for each part.
PARTS = f"""SELECT p_partkey % 40 AS doc_id, p_partkey AS para_no, p_size % 7 AS k, p_name, p_brand,
  {name('p_partkey')} AS a, {name('p_partkey * 7 + 3')} AS b, {name('p_partkey * 11 + 5')} AS c,
  cast(1950 + p_partkey % 75 AS string) AS y, cast(1960 + p_size AS string) AS z FROM {{part}}"""

VANCOUVER_TEXT = f"""SELECT doc_id, para_no, CASE k
  WHEN 0 THEN concat('The ', p_name, ' (', a, ' ', y, ') is known.')
  WHEN 1 THEN concat('Two wrote of it (', a, ' and ', b, ' ', y, ').')
  WHEN 2 THEN concat('Some (see ', a, ' ', y, ', ', z, ') and others (cf. ', c, ' ', z, 'b) differ.')
  WHEN 3 THEN concat('Quoted (', a, ' ', y, ', p. 12).')
  WHEN 4 THEN concat('Seen in spring (March ', y, ').')
  WHEN 5 THEN concat('Long (although a wide variety of terms was used ', y, ').')
  ELSE concat('As all say (', a, ' et al ', y, ' [sic]).') END AS text FROM ({PARTS})"""

#: Sentences that name instruments, labels, acronyms, long phrases and sources behind sources, and some that cite.
VETOED_TEXT = f"""SELECT doc_id, para_no, CASE p_brand
  WHEN 'Brand#1' THEN concat('The ', a, ' Anxiety Scale (', y, ') was used.') WHEN 'Brand#2' THEN concat('Table (', y, ') lists it.')
  WHEN 'Brand#3' THEN concat('Many NPs (', y, ') agree.') WHEN 'Brand#4' THEN concat('It is known (', a, ' in ', b, ', ', y, ').')
  WHEN 'Brand#5' THEN concat('An odd outcome of ', a, '’s (', y, ', ', z, ') work.') WHEN 'Brand#6' THEN concat('University of ', a, ' (n.d.) holds it.')
  WHEN 'Brand#7' THEN concat('See Chapter (', a, ' ', y, ') and (Chapter 3, ', z, ').') WHEN 'Brand#8' THEN concat('Once (', y, ') more.')
  WHEN 'Brand#9' THEN concat(a, ' & ', b, ' (', y, ') and (see, for example, ', a, ' & ', b, ', ', y, ', pp. 3-9).')
  WHEN 'Brand#10' THEN concat('One Two Three Four Five Six ', a, ' (', y, ').') WHEN 'Brand#11' THEN concat(a, ' et al. (in press) say so.')
  ELSE concat('As cited by ', a, ' (', y, 'b) it (p. 3; May ', z, ') holds.') END AS text FROM ({PARTS})"""

VANCOUVER_LINE = f"""SELECT para_no AS id, CASE k
  WHEN 0 THEN concat(a, ' J. ', p_name, '. Journal. ', y, ';10(2):1-5.')
  WHEN 1 THEN concat(a, ' J, ', b, ' M. ', p_name, '. Journal. ', y, ';10:1-5.')
  WHEN 2 THEN concat(a, ' J, ', b, ' M, ', c, ' K. ', p_name, '. Journal. ', y, '.')
  WHEN 3 THEN concat('lower ', a, '. ', p_name, '. ', y, '.')
  WHEN 4 THEN concat(a, ' J. No year here. Journal.')
  ELSE concat(a, ' Group. ', p_name, '. Press; ', y, '.') END AS line FROM ({PARTS})"""

CHICAGO_LINE = f"""SELECT para_no AS id, CASE k
  WHEN 0 THEN concat(a, ', John. ', y, '. ', p_name, '. Press.')
  WHEN 1 THEN concat(a, ', John, and Mary ', b, '. ', y, '. ', p_name, '. Press.')
  WHEN 2 THEN concat(a, ' Group. ', y, '. ', p_name, '.')
  WHEN 3 THEN concat(a, ', John. ', p_name, '. Press, ', y, '.')
  ELSE concat(a, ', John, Mary ', b, ', and Ann ', c, '. ', y, '. ', p_name, '.') END AS line FROM ({PARTS})"""

#: Documents of two styles by turns, and of none.
MIXED_TEXT = f"""SELECT doc_id, para_no % 40 + 1 AS para_no, CASE doc_id % 3
  WHEN 0 THEN concat('It holds (', a, ', ', y, ').') WHEN 1 THEN concat('It holds (', a, ' ', y, ').') ELSE concat(p_name, '.') END AS text
FROM ({PARTS})"""

SINGLE = f"""SELECT para_no AS id, CASE k WHEN 0 THEN concat(a, ', ', y) WHEN 1 THEN concat('see ', a, ' & ', b, ', ', y, ', ', z)
  WHEN 2 THEN concat(a, ', ', y, ', p. 3') WHEN 3 THEN concat('May ', y) WHEN 4 THEN y WHEN 5 THEN a ELSE concat('12, ', a, ' [note] ', y, 'a') END AS cite
FROM ({PARTS})"""

LOOSE_CITES = f"""SELECT doc_id, para_no AS cite_id, y AS year, CASE k WHEN 0 THEN a WHEN 1 THEN concat(a, ' et al.') WHEN 2 THEN concat(b, ', ', a)
  WHEN 3 THEN 'nobody' WHEN 4 THEN lower(b) ELSE concat('Group of ', a) END AS author FROM ({PARTS})"""
LOOSE_REFS = f"SELECT doc_id, para_no AS ref_pos, y AS year, concat(a, ', J., & ', b, ', M.') AS full_author FROM ({PARTS})"

REF_PARAS = f"""SELECT doc_id, para_no, CASE WHEN para_no % 11 = 4 THEN 'Heading 1' WHEN k = 6 THEN 'REF-N' ELSE 'Normal' END AS style,
  CASE WHEN para_no % 13 = 0 THEN '<ref-open>' WHEN para_no % 17 = 0 THEN '<ref-close>' WHEN para_no % 11 = 4 THEN 'Next chapter'
       WHEN para_no % 19 = 5 THEN 'Appendix' WHEN k = 0 THEN concat('https://doi.org/10.1/x ', a, ', J. (', y, '). The ', p_name, '. Journal, 3.')
       WHEN k = 1 THEN concat('[', z, '] ', a, ', J., & ', b, ', M. (', y, '). On ', p_name, '. Journal, 3.')
       WHEN k = 2 THEN concat(z, '. ', a, ', J. (', y, '). Made of ', p_name, '. New York: Springer.')
       WHEN k = 3 THEN concat(a, ' (', y, '). Page of ', p_name, '. Site. Retrieved from www.example.org/', para_no)
       ELSE concat(z, '. ', a, ', J. (', y, '). ', p_name, '. Journal, 3.') END AS text FROM ({PARTS})"""
LOOKUP = """SELECT DISTINCT concat('The ', p_name) AS title, named_struct('type', 'journal-article',
  'author', array(named_struct('given', 'Ann', 'family', 'Known')), 'title', concat('The ', p_name), 'container', 'Found Journal', 'volume', '9', 'issue', '1',
  'page', '1-2', 'publisher', cast(NULL AS string), 'doi', '10.1/x', 'url', cast(NULL AS string), 'year', '1999') AS item FROM {part}"""

RUNS = f"""SELECT doc_id, para_no, CASE WHEN k = 6 THEN 'Normal' ELSE 'REF-N' END AS para_style, run_no, r.style, r.text FROM ({PARTS}) LATERAL VIEW posexplode(array(
  named_struct('style', CASE WHEN k < 2 THEN 'bib_number' ELSE 'x' END, 'text', CASE WHEN k = 4 THEN 'no number' ELSE concat('[', z, ']') END),
  named_struct('style', 'bib_surname', 'text', a), named_struct('style', CASE WHEN k = 3 THEN 'bib_number' ELSE 'y' END, 'text', concat(' ', y)))) t AS run_no, r"""

WORD_RUNS = "SELECT p_partkey AS id, run_no, text FROM {part} LATERAL VIEW posexplode(array(substring(p_name, 1, 3), substring(p_name, 4, 2), substring(p_name, 6, 20))) t AS run_no, text"


def parsed(text: str, line):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return run_sql(spark, d, text).select("id", line(F.col("line")).alias("r")).where("r IS NOT NULL").select("id", "r.author", "r.year", "r.full_author")

    return run


def mixed_styles(spark: SparkSession, d: str) -> DataFrame:
    paras = run_sql(spark, d, MIXED_TEXT)
    found = O.by_style(paras, O.document_styles(paras))
    return found.groupBy("doc_id", "author", "year").agg(F.count("*").alias("n"))


def single(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, d, SINGLE).select("id", F.explode(O.single_citation(F.col("cite"))).alias("c")).select("id", "c.author", "c.year")


def loose(spark: SparkSession, d: str) -> DataFrame:
    return O.loose_match(run_sql(spark, d, LOOSE_CITES), run_sql(spark, d, LOOSE_REFS))


def found_runs(spark: SparkSession, d: str) -> DataFrame:
    wanted = run_sql(spark, d, "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN substring(p_name, 3, 4) ELSE upper(substring(p_name, 5, 2)) END AS find FROM {part}")
    return O.text_in_runs(run_sql(spark, d, WORD_RUNS), wanted, ["id"]).select("id", F.col("run_no").cast("long").alias("run_no"))


def raw_parts(read):
    def run(spark: SparkSession, d: str) -> DataFrame:
        lines = run_sql(spark, d, f"""SELECT para_no AS id, CASE k % 2 WHEN 0 THEN concat(z, '. ', a, ' J, ', b, ' M. The ', p_name, '. Some Journal. ', y, ';3:1-9.')
  ELSE concat(a, ', J. (', y, '). The  ', p_name, '. Some Journal, 3(2), 1-9.') END AS line FROM ({PARTS})""")  # fmt: skip
        return lines.select("id", read(F.col("line")).alias("p")).select("id", "p.authors", "p.title", "p.journal", "p.year")

    return run


def initials(spark: SparkSession, d: str) -> DataFrame:
    people = run_sql(spark, d, f"""SELECT para_no AS id, slice(array(named_struct('given', 'Ann Beth', 'family', a), named_struct('given', '', 'family', b),
  named_struct('given', 'Carl', 'family', c)), 1, cast(k % 4 AS int)) AS author FROM ({PARTS})""")  # fmt: skip
    return people.select("id", S.single_initials(F.col("author")).alias("shown"))


def pubmed(spark: SparkSession, d: str) -> DataFrame:
    items = run_sql(spark, d, """SELECT p_partkey AS id, named_struct('author', array(p_brand), 'title', array(p_name), 'iso_abbrev', CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END,
  'volume', CASE WHEN p_size % 3 = 0 THEN cast(p_size AS string) END, 'issue', '1', 'page', '2', 'doi', CASE WHEN p_size % 5 = 0 THEN '' ELSE '10.1/x' END) AS item FROM {part}""")  # fmt: skip
    got = items.select("id", S.from_pubmed(F.col("item")).alias("i"))
    return got.select("id", F.array_join("i.short_container_title", ";").alias("short"), "i.volume", "i.doi")


def structured(spark: SparkSession, d: str) -> DataFrame:
    return S.structured(run_sql(spark, d, REF_PARAS), run_sql(spark, d, LOOKUP))


def ids(spark: SparkSession, d: str) -> DataFrame:
    return S.bibliography_ids(run_sql(spark, d, RUNS)).select("doc_id", "para_no", "ref_id")


def urls(spark: SparkSession, d: str) -> DataFrame:
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:", "")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "://[^/]*", "://")).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", O.is_url(url).alias("is_url"))


P = twin(PARTS)
SECTION = f"""p AS ({P}), t AS (SELECT *, CASE WHEN para_no % 13 = 0 THEN 1 WHEN para_no % 17 = 0 OR para_no % 11 = 4 OR para_no % 19 = 5 THEN 0 END AS mark FROM p),
s AS (SELECT *, (SELECT q.mark FROM t q WHERE q.doc_id = t.doc_id AND q.para_no <= t.para_no AND q.mark IS NOT NULL ORDER BY q.para_no DESC LIMIT 1) AS inside FROM t),
refs AS (SELECT * FROM s WHERE inside = 1 AND mark IS NULL)"""

def style_votes(spark: SparkSession, d: str) -> DataFrame:
    n = lambda shape: F.sum(F.regexp_count("text", F.lit(shape))).cast("long")
    votes = run_sql(spark, d, MIXED_TEXT).groupBy("doc_id").agg(n(O.APA_SHAPE).alias("apa"), n(O.VANCOUVER_SHAPE).alias("vancouver"))
    return votes.withColumn("style", O.detected_style(F.col("apa"), F.col("vancouver")))


QUERIES = {
    "agg22_style_vote": style_votes,
    "prj13_set07_in_text_vetoes": lambda s, d: A.in_text(run_sql(s, d, VETOED_TEXT)).select("doc_id", "para_no", "author", "year", "type", F.array_join("warnings", ";").alias("warnings")),
    "fn33_vancouver_in_text": lambda s, d: O.vancouver_in_text(run_sql(s, d, VANCOUVER_TEXT)).select("doc_id", "para_no", "author", "year", "type", "raw"),
    "fn34_vancouver_references": parsed(VANCOUVER_LINE, O.vancouver_reference),
    "fn35_chicago_references": parsed(CHICAGO_LINE, O.chicago_reference),
    "fn36_detected_styles": lambda s, d: O.document_styles(run_sql(s, d, MIXED_TEXT)),
    "fn44_pipe03_multi_style": mixed_styles,
    "fn37_single_citations": single,
    "jn09_loose_matches": loose,
    "fn81_text_in_runs": found_runs,
    "fn12_is_url": urls,
    "win16_section_paragraphs": lambda s, d: S.section_paragraphs(run_sql(s, d, REF_PARAS)).select("doc_id", "para_no"),
    "fn39_ama_parts": raw_parts(S.ama_parts),
    "fn39_apa_parts": raw_parts(S.apa_parts),
    "fn54_single_initials": initials,
    "fn57_from_pubmed": pubmed,
    "fn53_fn59_pipe04_structured": structured,
    "src21_bibliography_ids": ids,
}
ORACLES = {
    "agg22_style_vote": f"""SELECT doc_id, count(*) FILTER (doc_id % 3 = 0) AS apa, count(*) FILTER (doc_id % 3 = 1) AS vancouver, CASE doc_id % 3 WHEN 1 THEN 'vancouver' ELSE 'apa' END AS style
FROM ({P}) GROUP BY doc_id""",
    "prj13_set07_in_text_vetoes": f"""WITH p AS (SELECT *, substr(p_brand, 7)::INT AS n FROM ({P})), r AS (
SELECT doc_id, para_no, b AS author, y AS year, 'parenthetical' AS type, '' AS warnings FROM p WHERE n = 4
UNION ALL SELECT doc_id, para_no, a, unnest([y, z]), 'narrative', '' FROM p WHERE n = 5
UNION ALL SELECT doc_id, para_no, 'University of ' || a, 'n.d.', 'narrative', '' FROM p WHERE n = 6
UNION ALL SELECT doc_id, para_no, a, y, 'parenthetical', 'missing comma' FROM p WHERE n = 7
UNION ALL SELECT doc_id, para_no, 'Once', y, 'narrative', '' FROM p WHERE n = 8
UNION ALL SELECT doc_id, para_no, a || ' & ' || b, y, 'parenthetical', '' FROM p WHERE n = 9
UNION ALL SELECT doc_id, para_no, a || ' et al.', 'in press', 'narrative', '' FROM p WHERE n = 11
UNION ALL SELECT doc_id, para_no, a, y || 'b', 'narrative', '' FROM p WHERE n > 11)
SELECT * FROM r""",
    "fn33_vancouver_in_text": f"""WITH p AS ({P}), r AS (
SELECT doc_id, para_no, a AS author, y AS year, a || ' ' || y AS raw FROM p WHERE k = 0
UNION ALL SELECT doc_id, para_no, a || ' and ' || b, y, a || ' and ' || b || ' ' || y FROM p WHERE k = 1
UNION ALL SELECT doc_id, para_no, a, unnest([y, z]), a || ' ' || y || ', ' || z FROM p WHERE k = 2
UNION ALL SELECT doc_id, para_no, c, z, c || ' ' || z || 'b' FROM p WHERE k = 2
UNION ALL SELECT doc_id, para_no, a || ' et al', y, a || ' et al ' || y FROM p WHERE k = 6)
SELECT doc_id, para_no, author, year, 'parenthetical' AS type, '(' || raw || ')' AS raw FROM r""",
    "fn34_vancouver_references": f"""SELECT para_no AS id, CASE k WHEN 0 THEN a || ' J' WHEN 1 THEN a || ' J and ' || b || ' M' WHEN 2 THEN a || ' J et al' ELSE a || ' Group' END AS author,
y AS year, CASE k WHEN 0 THEN a || ' J' WHEN 1 THEN a || ' J, ' || b || ' M' WHEN 2 THEN a || ' J, ' || b || ' M, ' || c || ' K' ELSE a || ' Group' END AS full_author
FROM ({P}) WHERE k NOT IN (3, 4)""",
    "fn35_chicago_references": f"""SELECT para_no AS id, CASE k WHEN 0 THEN a WHEN 2 THEN a || ' Group' ELSE a || ' et al.' END AS author, y AS year,
CASE k WHEN 0 THEN a || ', John' WHEN 1 THEN a || ', John, and Mary ' || b WHEN 2 THEN a || ' Group' ELSE a || ', John, Mary ' || b || ', and Ann ' || c END AS full_author
FROM ({P}) WHERE k <> 3""",
    "fn36_detected_styles": f"SELECT DISTINCT doc_id, CASE doc_id % 3 WHEN 1 THEN 'vancouver' ELSE 'apa' END AS style FROM ({P})",
    "fn44_pipe03_multi_style": f"SELECT doc_id, a AS author, y AS year, count(*) AS n FROM ({P}) WHERE doc_id % 3 < 2 GROUP BY ALL",
    "fn37_single_citations": f"""WITH p AS ({P}) SELECT para_no AS id, a AS author, y AS year FROM p WHERE k IN (0, 6)
UNION ALL SELECT para_no, a || ' & ' || b, unnest([y, z]) FROM p WHERE k = 1""",
    "jn09_loose_matches": f"""WITH p AS ({P}),
c AS (SELECT doc_id, para_no AS cite_id, y, k, a, b, CASE k WHEN 0 THEN [a] WHEN 1 THEN [a] WHEN 2 THEN [b, a] WHEN 3 THEN ['nobody'] WHEN 4 THEN [b] ELSE ['group', 'of', a] END AS words FROM p),
m AS (SELECT c.doc_id, c.cite_id, min(p.para_no) AS ref_pos FROM c JOIN p ON p.doc_id = c.doc_id AND p.y = c.y
      AND ((c.k IN (0, 1) AND c.a = p.a) OR (c.k = 2 AND c.b = p.a) OR (c.k IN (0, 4) AND (c.words[1] = p.a OR c.words[1] = p.b)) OR len(list_filter(c.words, lambda w: w NOT IN (p.a, p.b))) = 0)
      GROUP BY ALL)
SELECT c.doc_id, c.cite_id, m.ref_pos FROM c LEFT JOIN m USING (doc_id, cite_id)""",
    "fn81_text_in_runs": """WITH w AS (SELECT p_partkey AS id, lower(p_name) AS n, CASE WHEN p_partkey % 2 = 0 THEN substr(p_name, 3, 4) ELSE substr(p_name, 5, 2) END AS find FROM part),
sp AS (SELECT id, strpos(n, find) - 1 AS s, strpos(n, find) - 1 + length(find) AS e, length(n) AS len FROM w)
SELECT id, unnest(list_filter([0, 1, 2], lambda i: [0, 3, 5][i + 1] < e AND least([3, 5, 25][i + 1], len) > s))::BIGINT AS run_no FROM sp""",
    "fn12_is_url": "SELECT page_id, page_id % 3 = 2 AS is_url FROM pages",
    "win16_section_paragraphs": f"WITH {SECTION} SELECT doc_id, para_no FROM refs",
    "fn39_ama_parts": f"""SELECT para_no AS id, CASE k % 2 WHEN 0 THEN a || ' J, ' || b || ' M' ELSE a || ', J' END AS authors,
CASE k % 2 WHEN 0 THEN 'The ' || p_name ELSE '(' || y || ')' END AS title, CASE k % 2 WHEN 0 THEN 'Some Journal' ELSE 'The ' || p_name END AS journal,
CASE k % 2 WHEN 0 THEN CASE WHEN z::INT BETWEEN 1900 AND 2099 THEN z END ELSE y END AS year FROM ({P})""",
    "fn39_apa_parts": f"""SELECT para_no AS id, CASE k % 2 WHEN 0 THEN z ELSE a || ', J.' END AS authors, CASE k % 2 WHEN 0 THEN a || ' J, ' || b || ' M' ELSE 'The ' || p_name END AS title,
CASE k % 2 WHEN 0 THEN 'The ' || p_name ELSE 'Some Journal' END AS journal, CASE k % 2 WHEN 0 THEN z ELSE y END AS year FROM ({P})""",
    "fn54_single_initials": f"""SELECT para_no AS id, CASE k % 4 WHEN 0 THEN 'Unknown authors' WHEN 1 THEN a || ', A.' WHEN 2 THEN a || ', A., & ' || b || ','
ELSE a || ', A., ' || b || ',, & ' || c || ', C.' END AS shown FROM ({P})""",
    "fn57_from_pubmed": """SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS short, CASE WHEN p_size % 3 = 0 THEN p_size::VARCHAR ELSE '' END AS volume,
CASE WHEN p_size % 5 > 0 THEN '10.1/x' END AS doi FROM part""",
    "fn53_fn59_pipe04_structured": f"""WITH {SECTION}
SELECT doc_id, para_no, CASE WHEN k = 6 THEN 'REF-N' WHEN k IN (0, 3) THEN 'REF-U' ELSE 'REF-N' END AS ref_style, CASE WHEN k NOT IN (0, 3) THEN z END AS number,
CASE k WHEN 2 THEN 'book' WHEN 3 THEN 'web' ELSE 'article' END AS kind, CASE k WHEN 0 THEN 'lookup' ELSE 'text' END AS source,
CASE k WHEN 0 THEN 'Known, A. (1999). The ' || p_name || '. Found Journal, 9(1), 1-2. https://doi.org/10.1/x'
WHEN 1 THEN z || '.' || chr(9) || a || ', J., & ' || b || ', M (' || y || '). On ' || p_name || '. Journal.'
WHEN 2 THEN z || '.' || chr(9) || a || ', J (' || y || '). Made of ' || p_name || '. New York: Springer.'
WHEN 3 THEN a || ' (' || y || '). Page of ' || p_name || '. Site. www.example.org/' || para_no
ELSE z || '.' || chr(9) || a || ', J (' || y || '). ' || p_name || '. Journal.' END AS formatted FROM refs""",
    "src21_bibliography_ids": f"SELECT doc_id, para_no, CASE WHEN k = 3 THEN y ELSE z END::BIGINT AS ref_id FROM ({P}) WHERE k NOT IN (4, 6)",
}
