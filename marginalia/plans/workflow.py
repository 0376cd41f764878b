"""Remaining loops of the manuscript workflow as windows, joins and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import flow as L
from marginalia.operators import matching
from marginalia.plans.numeric import bibliography, citations
from marginalia.plans.sqlquery import query, run_sql, twin
from marginalia.sources import pubmed
from marginalia.sources.tables import table

# Journal names and their short forms.
JOURNALS = [("journal", "J"), ("journal of psychology", "J Psychol"), ("new england journal of medicine", "N Engl J Med"), ("psychology", "Psychol")]

SQL = {
    "snk01_job_rows": "SELECT event_id AS id, user_id, concat('[', '\"', event_type, '\"', ']') AS original_filenames, ts AS processing_date, 'general' AS route_type FROM {events} WHERE event_type = 'purchase'",
}


def journal_short(spark: SparkSession, d: str) -> DataFrame:
    """Journals by exact name, by a longer and by a shorter one, and one of no list; brands are named after their numbers."""
    fixed = spark.createDataFrame(JOURNALS, "name string, short string")
    brands = run_sql(spark, d, "SELECT DISTINCT lower(p_brand) AS name, concat('Br', substring(p_brand, 7, 3)) AS short FROM {part}")
    items = run_sql(spark, d, """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'Journal of Psychology' WHEN 1 THEN 'Applied Psychology Letters' WHEN 2 THEN 'New England Journal'
  WHEN 3 THEN upper(p_brand) WHEN 4 THEN concat('Reports of ', p_brand, ' today') ELSE 'Nature' END AS journal FROM {part}""")
    return matching.journal_short(items, fixed.unionByName(brands)).select("id", "short")


#: XML of an article for each part: years in three places or none, markup, groups, several ids, no title, broken XML.
PUBMED = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 6 THEN concat('<PubmedArticleSet><PubmedArticle><MedlineCitation><Article><ArticleTitle>', p_name)
  WHEN 7 THEN '<PubmedArticleSet><PubmedArticle><MedlineCitation><Article><Journal><Title>x</Title></Journal></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>'
  ELSE concat('<?xml version="1.0"?><PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">', p_partkey, '</PMID><Article><Journal><ISSN>1</ISSN><JournalIssue CitedMedium="Internet"><Volume>', p_size, '</Volume>',
    CASE WHEN p_partkey % 8 = 1 THEN '' ELSE '<Issue> 2 </Issue>' END, '<PubDate>', CASE p_partkey % 8 WHEN 0 THEN concat('<Year>', 1990 + p_size % 30, '</Year><Month>May</Month>') WHEN 2 THEN concat('<MedlineDate>', 1970 + p_size % 30, ' Nov-Dec</MedlineDate>') WHEN 3 THEN '<MedlineDate>Winter</MedlineDate>' ELSE '' END,
    '</PubDate></JournalIssue><Title> Journal of ', p_brand, '</Title><ISOAbbreviation>J ', p_brand, '</ISOAbbreviation></Journal><ArticleTitle>', CASE WHEN p_partkey % 8 = 4 THEN concat('On <i>', p_name, '</i>, <b>again</b>') ELSE p_name END, '</ArticleTitle>',
    '<Pagination><MedlinePgn>10-19</MedlinePgn></Pagination><AuthorList CompleteYN="Y"><Author><LastName>Smith</LastName><ForeName>Ann Beth</ForeName><Initials>AB</Initials></Author>',
    CASE WHEN p_partkey % 8 < 3 THEN '<Author><CollectiveName>Group</CollectiveName></Author><Author><LastName>Jones</LastName><Initials>C</Initials></Author>' ELSE '' END, '</AuthorList>',
    CASE WHEN p_partkey % 8 IN (1, 2) THEN concat('<ArticleDate DateType="Electronic"><Year>', 2000 + p_size % 20, '</Year></ArticleDate>') ELSE '' END, '</Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">', p_partkey, '</ArticleId>',
    CASE WHEN p_partkey % 8 = 5 THEN '' ELSE concat('<ArticleId IdType="DOI"> 10.1/', p_partkey, '</ArticleId>') END, '</ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>') END AS xml FROM {part}"""


def pubmed_records(spark: SparkSession, d: str) -> DataFrame:
    found = pubmed.records(run_sql(spark, d, PUBMED), ["id"], "xml")
    return found.withColumn("author", F.array_join(F.transform("author", lambda a: F.concat_ws(", ", a["family"], a["given"])), "; "))


def continuation(spark: SparkSession, d: str) -> DataFrame:
    """Credit blocks: up to four following lines that begin with a capital, none after one that doesn't."""
    paras = T.paragraphs(table(spark, d, "documents").select("doc_id", "text"))
    w = W.partitionBy("doc_id").orderBy("para_no")
    ahead = w.rowsBetween(1, 4)
    starts = F.substring("text", 1, 1).between("A", "Z")
    line = F.struct("para_no", starts.alias("ok"))
    rows = paras.select("doc_id", "para_no", (F.length("text") % 13 == 0).alias("opens"), F.collect_list(line).over(ahead).alias("next"))
    taken = F.aggregate("next", F.struct(F.lit(True).alias("go"), F.lit(0).alias("n")), lambda a, x: F.struct((a["go"] & x["ok"]).alias("go"), (a["n"] + (a["go"] & x["ok"]).cast("int")).alias("n")))
    return rows.where("opens").select("doc_id", "para_no", taken["n"].cast("long").alias("lines"))


def subset_words(spark: SparkSession, d: str) -> DataFrame:
    """Whether all words of a name, small ones aside, are in another's."""
    rows = run_sql(spark, d, """SELECT p_partkey AS id, concat('the ', p_name, ' and ', lower(p_type), ' et al') AS a,
  concat(p_name, CASE WHEN p_size % 2 = 0 THEN concat(' of ', lower(p_type)) ELSE ' in the' END) AS b FROM {part}""")
    a, b = (matching.words(F.col(c)) for c in "ab")
    return rows.select("id", (F.size(F.array_except(a, b)) == 0).alias("inside"), F.size(F.array_union(a, b)).cast("long").alias("n"))


def sentence_pages(spark: SparkSession, d: str) -> DataFrame:
    """The first page whose text holds a sentence's first sixty characters, within a document."""
    paras = T.paragraphs(table(spark, d, "documents").select("doc_id", "text"))
    each = T.sentences(paras).where("trim(sentence) <> ''").select("doc_id", "para_no", "sent_no", F.substring("sentence", 1, 60).alias("head"))
    pages = T.pages_by_words(paras, "text").select("doc_id", "page", F.col("text").alias("page_text"))
    return L.first_pages(each, pages)


LABELLED = "SELECT p_partkey AS id, concat('Fig ', p_size) AS label, p_partkey % 500 AS doc_id FROM {part} WHERE p_size % 2 = 0"
CITED = "SELECT p_partkey AS ref, p_partkey % 500 AS doc_id, concat('fig ', p_size, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE '' END) AS label FROM {part}"
REFERENCES = "SELECT s_suppkey AS ref_id, concat('Dr ', s_name, ' and Nation ', s_nationkey, ', 19', 50 + s_suppkey % 40) AS line FROM {supplier}"
CALLS = """SELECT c_custkey AS cite, CASE c_custkey % 3 WHEN 0 THEN concat('Supplier#', lpad(cast(c_custkey % 1200 AS string), 9, '0'), ' and Nation') WHEN 1 THEN concat('Nation ', c_nationkey) ELSE 'Nobody' END AS names,
  concat('19', 50 + c_custkey % 1200 % 40) AS year FROM {customer}"""


def labels(spark: SparkSession, d: str) -> DataFrame:
    return L.resolved_labels(run_sql(spark, d, CITED), run_sql(spark, d, LABELLED)).select("ref", "id")


def single_links(spark: SparkSession, d: str) -> DataFrame:
    return L.single_links(run_sql(spark, d, CALLS), run_sql(spark, d, REFERENCES))


def colour_places(spark: SparkSession, d: str) -> DataFrame:
    """Marks of order lines: where they stand, when they were made, their colour."""
    marks = run_sql(spark, d, """SELECT l_orderkey AS doc_id, l_linenumber AS place, struct(l_partkey, l_suppkey, l_extendedprice) AS made,
  CASE WHEN l_returnflag = 'R' THEN 'yellow' WHEN l_returnflag = 'A' THEN 'cyan' ELSE 'green' END AS colour FROM {lineitem}""")  # fmt: skip
    return L.standing_colours(marks, ["doc_id", "place"], "made", "colour")


LINES = "SELECT l_orderkey AS doc_id, l_partkey AS para, struct(l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, CASE WHEN l_partkey % 3 = 0 THEN l_partkey END AS chapter FROM {lineitem}"


def chapters(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, LINES)
    return rows.select("doc_id", "para", L.carried("chapter", ["doc_id"], "place").alias("chapter"))


def abbreviations(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT l_partkey AS ref_id, l_orderkey AS place, l_linenumber AS line, struct(l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS made FROM {lineitem}")
    return rows.select("ref_id", "place", "line", L.abbreviation_advice(["ref_id"], "made").alias("advice"))


def spans_once(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT l_orderkey AS doc_id, l_linenumber AS start, l_linenumber + 5 AS stop, l_partkey AS term, struct(l_partkey, l_suppkey, l_extendedprice) AS made FROM {lineitem}")
    return L.first_of(rows, ["doc_id", "start"], "made").select("doc_id", "start", "stop", "term")


def comment_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Runs inside comment ranges: clicks open the range of their value's kind, views close it."""
    marks = run_sql(spark, d, """SELECT user_id AS doc_id, event_id AS run, struct(ts, event_id) AS place, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS step,
  cast(value AS int) % 3 AS comment FROM {events}""")  # fmt: skip
    return L.open_ranges(marks, ["doc_id"], "comment", "place", "step").select("run", "open")


def closes(spark: SparkSession, d: str) -> DataFrame:
    heads = run_sql(spark, d, "SELECT o_custkey AS doc_id, o_orderkey AS para, cast(o_orderkey % 4 + 1 AS bigint) AS level FROM {orders}")
    return heads.select("doc_id", "para", L.closing_levels(["doc_id"], "para", "level").alias("closes"))


def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand")
    return rows.select("id", L.numbered(["p_brand"], "id").alias("seq"))


def numbered_comments(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT o_custkey AS doc_id, o_orderkey AS comment_id, struct(o_orderdate, o_orderkey) AS place FROM {orders}")
    return rows.select("doc_id", "comment_id", L.numbered(["doc_id"], "place").alias("no"))


def merged_citations(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT l_partkey AS cite, l_orderkey AS place, CASE WHEN l_returnflag <> 'N' THEN array(l_returnflag, l_linestatus) ELSE cast(array() AS array<string>) END AS warnings FROM {lineitem}")
    merged = L.merged_citations(rows, "cite", "place", "warnings")
    return merged.select("cite", F.array_join("warnings", ",").alias("warnings"), F.array_join("places", ",").alias("places"))


def issue_totals(spark: SparkSession, d: str) -> DataFrame:
    """Seven lists of issues for each customer, most of them empty."""
    n = lambda c: F.collect_list(F.when(c, F.col("o_orderkey")))
    lists = [n(F.col("o_orderstatus") == x) for x in "FOP"] + [n(F.col("o_orderpriority").startswith(x)) for x in "123"] + [n(F.lit(False))]
    each = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(*[x.alias(f"l{i}") for i, x in enumerate(lists)])
    return each.select("doc_id", L.total_size(*[F.col(f"l{i}") for i in range(7)]).alias("issues"))


def acceptance(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT p_partkey AS id, p_size / 50.0D AS score, p_partkey % 2 = 0 AS has_doi, p_retailprice % 100 / 100.0D AS title_sim, p_partkey % 3 = 0 AS author_ok FROM {part}")
    return rows.select("id", L.accepted(*map(F.col, ("score", "has_doi", "title_sim", "author_ok"))).alias("accepted"))


def zip_members(spark: SparkSession, d: str) -> DataFrame:
    files = run_sql(spark, d, "SELECT p_partkey AS id, concat(p_name, CASE p_size % 4 WHEN 0 THEN '_processed.docx' WHEN 1 THEN '_log.txt' WHEN 2 THEN '.TMP' ELSE '.docx' END) AS member, cast(p_partkey * 1000003 % 90000000 AS bigint) AS size FROM {part}")
    return L.zip_members(files, "member", "size").select("id", "member")


def cache_lookups(spark: SparkSession, d: str) -> DataFrame:
    cache = run_sql(spark, d, "SELECT p_name AS title, p_partkey AS item FROM {part} WHERE p_partkey % 3 = 0 AND p_size > 10")
    asked = run_sql(spark, d, "SELECT p_partkey AS id, concat(' ', upper(p_name), '  ') AS title FROM {part}")
    return L.cached(asked, cache, "title", "item").select("id", "item")


def short_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of up to four letters A to Z in each document; letters and digits of any script, and the underscore, go on with a word. Null has none."""
    word = r"(?<![\p{L}\p{N}_])[A-Za-z]{1,4}(?![\p{L}\p{N}_])"
    return table(spark, d, "documents").select("doc_id", F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(word), F.lit(0))).cast("long").alias("n"))


def uncited_last(spark: SparkSession, d: str) -> DataFrame:
    """Floats after their first citing paragraph, uncited ones at the end."""
    first = citations(spark, d).groupBy("doc_id", F.col("cited_id").alias("ref_id")).agg(F.min("pos").alias("after"))
    return bibliography(spark, d).join(first, ["doc_id", "ref_id"], "left").select("doc_id", "ref_id", F.coalesce("after", F.lit(-1)).alias("after"))


PARAS = "paras AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS para_no, unnest(string_split(text, chr(10))) AS text FROM documents)"
QUERIES = {k: query(v) for k, v in SQL.items()} | {
    "fn56_srt08_journal_short": journal_short,
    "src13_pubmed_records": pubmed_records,
    "win14_credit_lines": continuation,
    "set06_word_subset": subset_words,
    "jn17_sentence_pages": sentence_pages,
    "jn19_label_to_id": labels,
    "jn20_single_link": single_links,
    "win13_colour_priority": colour_places,
    "win15_chapter_carry": chapters,
    "win06_abbreviation_use": abbreviations,
    "win12_span_dedupe": spans_once,
    "win17_open_comments": comment_ranges,
    "win18_section_closes": closes,
    "win19_sequence_ids": numbered_ids,
    "jn24_numbered_comments": numbered_comments,
    "agg11_citation_merge": merged_citations,
    "agg20_issue_total": issue_totals,
    "fn42_acceptance": acceptance,
    "snk07_zip_members": zip_members,
    "src15_src16_lookup_cache": cache_lookups,
    "fn78_short_words": short_words,
    "fn97_float_places": uncited_last,
}
ORACLES = {k: twin(v) for k, v in SQL.items()} | {
    "fn56_srt08_journal_short": """SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'J Psychol' WHEN 1 THEN 'Psychol' WHEN 2 THEN 'N Engl J Med' WHEN 5 THEN 'Nature'
ELSE 'Br' || substr(p_brand, 7, 3) END AS short FROM part""",
    "src13_pubmed_records": """WITH p AS (SELECT *, p_partkey % 8 AS k FROM part)
SELECT p_partkey AS id, 0::BIGINT AS article_no, 'Smith, Ann Beth' || CASE WHEN k < 3 THEN '; Jones, C' ELSE '' END AS author, CASE WHEN k = 4 THEN 'On ' || p_name || ', again' ELSE p_name END AS title, 'Journal of ' || p_brand AS container,
'J ' || p_brand AS iso_abbrev, p_size::VARCHAR AS volume, CASE WHEN k = 1 THEN '' ELSE '2' END AS issue, '10-19' AS page, CASE WHEN k = 5 THEN '' ELSE '10.1/' || p_partkey END AS doi,
CASE k WHEN 0 THEN 1990 + p_size % 30 WHEN 1 THEN 2000 + p_size % 20 WHEN 2 THEN 2000 + p_size % 20 END::INT AS year FROM p WHERE k < 6
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE k >= 6""",
    "win14_credit_lines": f"""WITH {PARAS}, s AS (SELECT *, (text[1:1] BETWEEN 'A' AND 'Z') AS ok FROM paras)
SELECT a.doc_id, a.para_no, (SELECT count(*) FROM s b WHERE b.doc_id = a.doc_id AND b.para_no BETWEEN a.para_no + 1 AND a.para_no + 4 AND NOT EXISTS (SELECT 1 FROM s c WHERE c.doc_id = a.doc_id AND c.para_no BETWEEN a.para_no + 1 AND b.para_no AND NOT c.ok)) AS lines FROM s a WHERE length(a.text) % 13 = 0""",
    "set06_word_subset": """SELECT p_partkey AS id, p_size % 2 = 0 OR contains(p_name, lower(p_type)) AS inside,
len(list_distinct([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'of' ELSE 'in' END]))::BIGINT AS n FROM part""",
    "jn17_sentence_pages": f"""WITH {PARAS}, q AS (SELECT * FROM paras), g AS (SELECT doc_id, para_no, text, greatest(1, ceil(coalesce(sum(len(regexp_extract_all(text, '[^ \\t\\n]+'))) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160))::BIGINT AS page FROM q),
s AS (SELECT doc_id, para_no, unnest(range(len(regexp_extract_all(text, '[^.!?]+[.!?]*')))) AS sent_no, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS sentence FROM q)
SELECT s.doc_id, s.para_no, s.sent_no, min(g.page) AS page FROM s JOIN g ON g.doc_id = s.doc_id AND contains(g.text, substr(sentence, 1, 60)) WHERE trim(sentence) <> '' GROUP BY ALL""",
    "jn19_label_to_id": """WITH ids AS (SELECT p_partkey AS id, p_size, p_partkey % 500 AS doc_id FROM part WHERE p_size % 2 = 0)
SELECT p.p_partkey AS ref, (SELECT min(i.id) FROM ids i WHERE i.p_size = p.p_size AND i.doc_id = p.p_partkey % 500) AS id FROM part p""",
    "jn20_single_link": """WITH r AS (SELECT s_suppkey AS ref_id, s_name, s_nationkey, 50 + s_suppkey % 40 AS y FROM supplier),
m AS (SELECT c_custkey AS cite, r.ref_id, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN r ON r.y = 50 + c_custkey % 1200 % 40
      AND ((c_custkey % 3 = 0 AND r.s_name = 'Supplier#' || lpad((c_custkey % 1200)::VARCHAR, 9, '0')) OR (c_custkey % 3 = 1 AND contains(r.s_nationkey::VARCHAR, c_nationkey::VARCHAR))))
SELECT cite, ref_id FROM m WHERE n = 1""",
    "win13_colour_priority": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (l_returnflag = 'R')::INT DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, l_linenumber AS place, CASE l_returnflag WHEN 'R' THEN 'yellow' WHEN 'A' THEN 'cyan' ELSE 'green' END AS colour FROM s WHERE n = 1""",
    "win15_chapter_carry": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)
SELECT l_orderkey AS doc_id, l_partkey AS para, (SELECT arg_max(q.l_partkey, q.n) FROM s q WHERE q.l_orderkey = s.l_orderkey AND q.n <= s.n AND q.l_partkey % 3 = 0) AS chapter FROM s""",
    "win06_abbreviation_use": """WITH f AS (SELECT l_partkey, min((l_orderkey, l_linenumber, l_suppkey, l_extendedprice)) AS first FROM lineitem GROUP BY l_partkey)
SELECT l_partkey AS ref_id, l_orderkey AS place, l_linenumber AS line, CASE WHEN (l_orderkey, l_linenumber, l_suppkey, l_extendedprice) = f.first THEN 'define' ELSE 'use' END AS advice FROM lineitem JOIN f USING (l_partkey)""",
    "win12_span_dedupe": """SELECT l_orderkey AS doc_id, l_linenumber AS start, l_linenumber + 5 AS stop, (min((l_partkey, l_suppkey, l_extendedprice)))[1] AS term FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "win17_open_comments": """WITH m AS (SELECT event_id AS run, user_id, ts, event_id, trunc(value)::INT % 3 AS comment, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN -1 ELSE 0 END AS step FROM events),
c AS (SELECT run, user_id, ts, event_id, k, sum(CASE WHEN comment = k THEN step ELSE 0 END) OVER (PARTITION BY user_id, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS depth FROM m, (VALUES (-2), (-1), (0), (1), (2)) t(k))
SELECT run, count(*) FILTER (depth > 0)::BIGINT AS open FROM c GROUP BY run""",
    "win18_section_closes": """WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS para, o_orderkey % 4 + 1 AS level FROM orders)
SELECT h.doc_id, h.para, coalesce((SELECT greatest(arg_max(q.level, q.para) - h.level + 1, 0) FROM h q WHERE q.doc_id = h.doc_id AND q.para < h.para), 0)::BIGINT AS closes FROM h""",
    "win19_sequence_ids": "SELECT p.p_partkey AS id, (SELECT count(*) FROM part q WHERE q.p_brand = p.p_brand AND q.p_partkey <= p.p_partkey) AS seq FROM part p",
    "jn24_numbered_comments": "SELECT a.o_custkey AS doc_id, a.o_orderkey AS comment_id, count(*) AS no FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND (b.o_orderdate < a.o_orderdate OR (b.o_orderdate = a.o_orderdate AND b.o_orderkey <= a.o_orderkey)) GROUP BY ALL",
    "agg11_citation_merge": """WITH w AS (SELECT l_partkey AS cite, string_agg(DISTINCT x, ',' ORDER BY x) AS warnings FROM (SELECT l_partkey, unnest(CASE WHEN l_returnflag <> 'N' THEN [l_returnflag, l_linestatus] ELSE [] END) AS x FROM lineitem) GROUP BY l_partkey),
p AS (SELECT l_partkey AS cite, string_agg(o::VARCHAR, ',' ORDER BY o) AS places FROM (SELECT DISTINCT l_partkey, l_orderkey AS o FROM lineitem) GROUP BY l_partkey)
SELECT cite, coalesce(warnings, '') AS warnings, places FROM p LEFT JOIN w USING (cite)""",
    "agg20_issue_total": "SELECT o_custkey AS doc_id, (count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) + count(*) FILTER (o_orderpriority[1] IN ('1', '2', '3')))::BIGINT AS issues FROM orders GROUP BY o_custkey",
    "fn42_acceptance": """SELECT p_partkey AS id, CASE WHEN p_size / 50.0::DOUBLE < (CASE WHEN p_partkey % 2 = 0 THEN 0.6 ELSE 0.75 END)::DOUBLE THEN FALSE WHEN p_retailprice % 100 / 100.0::DOUBLE < 0.4::DOUBLE THEN FALSE
WHEN p_partkey % 3 = 0 THEN TRUE ELSE p_retailprice % 100 / 100.0::DOUBLE >= 0.8::DOUBLE AND p_size / 50.0::DOUBLE >= 0.9::DOUBLE END AS accepted FROM part""",
    "snk07_zip_members": "SELECT p_partkey AS id, p_name || CASE p_size % 4 WHEN 0 THEN '_processed.docx' WHEN 1 THEN '_log.txt' ELSE '.docx' END AS member FROM part WHERE p_size % 4 <> 2 AND p_partkey * 1000003 % 90000000 < 50 * 1024 * 1024",
    "src15_src16_lookup_cache": "SELECT p.p_partkey AS id, (SELECT min(c.p_partkey) FROM part c WHERE c.p_name = p.p_name AND c.p_partkey % 3 = 0 AND c.p_size > 10) AS item FROM part p",
    "fn78_short_words": r"SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[A-Za-z]{1,4}')))::BIGINT AS n FROM documents",
    "fn97_float_places": "WITH c AS (SELECT o_custkey AS doc_id, l_suppkey % 10 + 1 AS ref_id, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT doc_id, ref_id, min(pos) AS after FROM c GROUP BY ALL) SELECT b.doc_id, b.ref_id, coalesce(after, -1) AS after FROM (SELECT DISTINCT o_custkey AS doc_id, o_orderkey % 10 + 1 AS ref_id FROM orders) b LEFT JOIN f USING (doc_id, ref_id)",
}
