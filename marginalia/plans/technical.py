"""Credits, highlighting, the dashboard, tagged book text and reports, on texts built from parts and on documents.

The twins are made of the ingredients of the texts, or count in another way than the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import bookxml as B
from marginalia.functions import credits as C
from marginalia.functions import numbers as N
from marginalia.functions import text as T
from marginalia.operators import captions, dashboard, lexicon, reports, segments, store
from marginalia.operators import highlighting as H
from marginalia.plans import manuscript as M
from marginalia.plans.sqlquery import run_sql, twin
from marginalia.plans.styles import PARTS
from marginalia.sources.tables import dealt, table

P = twin(PARTS)

CREDITED = f"""SELECT para_no AS id, CASE k
  WHEN 0 THEN concat('Drawn by us. Adapted from  ', a, ' (', y, '). Please advise if wrong.')
  WHEN 1 THEN concat('Sources: ', a, ' ', y, '; ', b, ' ', z, '. Either redraw or keep.')
  WHEN 2 THEN concat('Note: courtesy of ', a)
  WHEN 3 THEN concat('Shown with permission. https://doi.org/10.1/', z, ' https://doi.org/10.1/', z)
  WHEN 4 THEN concat('Photo credit: ', a, ' please advise and courtesy of ', b)
  WHEN 5 THEN concat('Illustration by ', a) ELSE concat('Plain text of ', p_name) END AS text, p_name FROM ({PARTS})"""

MARKED = f"""SELECT doc_id, para_no, CASE WHEN p_brand LIKE '%1' THEN 'REF-N' ELSE 'Normal' END AS style, CASE k
  WHEN 0 THEN 'took five per day of it' WHEN 1 THEN concat('in ', y) WHEN 2 THEN 'dose alpha versus none' WHEN 3 THEN 'see § and 5 °F here'
  WHEN 4 THEN 'a century of Жизнь' WHEN 5 THEN 'no mark at all' ELSE 'x < z in vitro' END AS text FROM ({PARTS})"""

ITALIC = f"""SELECT para_no AS id, run_no, r.italic, r.text FROM ({PARTS}) LATERAL VIEW posexplode(array(
  named_struct('italic', true, 'text', concat(a, ', ', b, '.')), named_struct('italic', false, 'text', 'x, y.'),
  named_struct('italic', true, 'text', CASE WHEN k < 3 THEN ';' ELSE concat(c, ':', y) END))) t AS run_no, r"""

MARKS = f"""SELECT para_no AS id, cast(1 AS int) AS run_no, 1 AS step FROM ({PARTS}) WHERE k < 4
UNION ALL SELECT para_no, cast(k AS int), -1 FROM ({PARTS}) WHERE k > 0 AND k < 4"""
PLAIN_RUNS = f"SELECT para_no AS id, run_no FROM ({PARTS}) LATERAL VIEW explode(sequence(0, 4)) t AS run_no"

TOLD = f"""SELECT doc_id, para_no, CASE k WHEN 0 THEN concat('refer ', a, ' and Insert ', b) WHEN 1 THEN concat('Pick-up ', p_name)
  WHEN 2 THEN concat('seen ', a) WHEN 3 THEN concat('AQ: ', a) WHEN 4 THEN concat('VIDEO ', y, ' see ', z) ELSE p_name END AS text FROM ({PARTS})"""

SHEETS = f"""SELECT doc_id, para_no, CASE k WHEN 4 THEN 'TT' WHEN 5 THEN NULL ELSE 'Normal' END AS style, k = 6 OR k = 0 AS highlighted, CASE k
  WHEN 0 THEN concat('Figure ', z, '-1 ', p_name) WHEN 1 THEN concat('As Table ', z, '.1 and Figure ', z, '.1 show') WHEN 2 THEN concat('Table ', z, '.2 ', p_name)
  WHEN 3 THEN '   ' WHEN 4 THEN concat('Styled ', p_name) WHEN 5 THEN concat('Insert Table ', z, '.2 here') ELSE concat('Text of ', a) END AS text FROM ({PARTS})"""

CHAPTERS = f"""SELECT para_no AS id, concat('<p class="ChapterNumber"><strong>Chapter ', z, '</strong></p>\\n<p class="ChapterTitle"> <strong>The ', p_name, '</strong></p>',
  CASE WHEN k < 4 THEN concat('<p class="ChapterAuthor">Ann ', a, ', Bo Lee ', b, ' and ', c, '</p>') ELSE '' END,
  CASE WHEN k % 2 = 0 THEN concat('<p class="H1"><strong>Abstract</strong></p> <p class="Para">About ', p_name, '</p>') ELSE '' END,
  '<p class="H1">Keywords</p><p class="Para">', a, CASE WHEN k % 3 = 0 THEN ', ' ELSE '; ' END, b, '</p>') AS html FROM ({PARTS})"""

LISTS = f"""SELECT para_no AS id, CASE k % 3 WHEN 0 THEN concat('<OL1>', a, '</OL1><BL2>', b, '</BL2><BL2>', c, '</BL2><OL1>', y, '</OL1>')
  WHEN 1 THEN concat('<UL1>', a, '</UL1>') ELSE concat('<AL1>', a, '</AL1><RU2>', b, '</RU2><OL3>', c, '</OL3>') END AS text FROM ({PARTS})"""

REFS = f"""SELECT para_no AS id, concat('<p class="Reference-Alphabetical"><bibsurname>', a, '</bibsurname>, <bibfname>J.</bibfname> (<bibyear>', y, CASE WHEN k = 1 THEN 'b' ELSE '' END, '</bibyear>) ',
  CASE k WHEN 0 THEN concat('<bibarticle>', p_name, '</bibarticle> <bibvolume><italic>', z, '</italic></bibvolume>') WHEN 1 THEN concat('<bibtitle>', p_name, '</bibtitle>')
         WHEN 2 THEN concat('<bibtitle>', p_name, '</bibtitle> <bibpublisher>P</bibpublisher>') WHEN 3 THEN concat('<biburl>http://x.y/', z, '</biburl> <bibissue>1</bibissue>')
         ELSE concat('<bibdoi>10.1/', z, '</bibdoi>') END, '</p>') AS text FROM ({PARTS})"""

TAGGED_RUNS = f"""SELECT para_no AS id, run_no, 'Body' AS para_style, r.* FROM ({PARTS}) LATERAL VIEW posexplode(array(
  named_struct('text', concat('a<', a), 'style', CAST(NULL AS string), 'smallcaps', k = 1, 'struck', false, 'superscript', false, 'subscript', false, 'bold', true, 'italic', k = 2, 'underlined', false),
  named_struct('text', b, 'style', 'cite', 'smallcaps', k = 1, 'struck', k = 3, 'superscript', k = 4, 'subscript', k = 5, 'bold', false, 'italic', false, 'underlined', true))) t AS run_no, r"""
CELLS = f"""SELECT doc_id, para_no AS row_no, col_no, concat(a, col_no) AS html, CASE WHEN k = 1 AND col_no = 0 THEN 2 ELSE 1 END AS colspan, CASE WHEN k = 2 THEN 'right' END AS align,
  CASE WHEN col_no = 1 AND k > 4 THEN 'continue' WHEN col_no = 1 THEN 'restart' END AS merge FROM ({PARTS}) LATERAL VIEW explode(array(0, 1)) t AS col_no"""

DATES = f"SELECT para_no AS id, CASE k WHEN 0 THEN concat('12 May ', y) WHEN 1 THEN concat(y, 'a') WHEN 2 THEN concat('March 3, ', y) ELSE concat(y, ', ', z) END AS text FROM ({PARTS})"

ENTITIES = "SELECT p_partkey AS id, concat('a&#', p_partkey + 160, ';b & c&#', p_size, ';') AS text FROM {part}"


def credited(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, d, CREDITED).select("id", "p_name", C.credit_sentence(F.col("text")).alias("credit"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The first `the` of each sentence with the words around it."""
    rows = T.sentences(M.paras(spark, d)).withColumn("start", F.length(F.regexp_extract("sentence", r"(?s)^(.*?)(?<![\p{L}\p{N}_])the(?![\p{L}\p{N}_])", 1)))
    hit = rows.where(F.col("sentence").rlike(r"(?<![\p{L}\p{N}_])the(?![\p{L}\p{N}_])"))
    return hit.select("doc_id", "para_no", "sent_no", H.around(F.col("sentence"), F.col("start"), F.col("start") + 3).alias("context"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    return run_sql(spark, d, SHEETS)


def whole_dashboard(spark: SparkSession, d: str) -> DataFrame:
    comments = run_sql(spark, d, f"SELECT doc_id FROM ({PARTS}) WHERE k = 1")
    media = run_sql(spark, d, f"SELECT doc_id, count(*) AS images, max(para_no) AS footnotes, min(para_no) AS endnotes FROM ({PARTS}) WHERE doc_id % 2 = 0 GROUP BY doc_id")
    return dashboard.dashboard(sheets(spark, d), comments, media)


def audit(spark: SparkSession, d: str) -> DataFrame:
    marks = run_sql(spark, d, f"SELECT doc_id, para_no, concat(p_name, ' of ', a, ', ', b, ' and ', c, ' in the years ', y, ' and ', z, ' or later') AS text, k = 1 AS struck, k > 5 OR k = 1 AS hidden FROM ({PARTS})")
    media = run_sql(spark, d, f"SELECT doc_id, max(k) AS sections FROM ({PARTS}) GROUP BY doc_id")
    return dashboard.formatting_audit(marks, media)


def chapters(spark: SparkSession, d: str) -> DataFrame:
    got = run_sql(spark, d, CHAPTERS).select("id", B.chapter_data(F.col("html")).alias("c"))
    names = F.array_join(F.transform("c.authors", lambda a: F.concat_ws("/", a["surname"], a["given"])), ";")
    return got.select("id", "c.label", "c.number", "c.title", names.alias("authors"), "c.abstract", F.array_join("c.keywords", ";").alias("keywords"))


def addresses(spark: SparkSession, d: str) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    href = F.when(F.col("page_id") % 3 == 0, bare).when(F.col("page_id") % 3 == 1, F.concat(F.lit("me@"), F.regexp_extract(bare, "^[^/]*", 0))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", B.schemed(href).alias("href"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Files and results appended with keys after the greatest there is."""
    files = run_sql(spark, d, "SELECT p_partkey AS no, p_name AS filename FROM {part}")
    results = run_sql(spark, d, "SELECT p_partkey AS no, p_size AS total_references FROM {part}")
    new_files, new_results = reports.file_and_result(files, results, F.lit(1000))
    old = run_sql(spark, d, "SELECT s_suppkey AS file_id, cast(s_nationkey AS int) AS total_references FROM {supplier}")
    return reports.appended(old, new_results.join(new_files.select(F.col("id").alias("file_id")), "file_id", "left_semi"))


def bias_rows(spark: SparkSession, d: str) -> DataFrame:
    found = lexicon.report(M.paras(spark, d), lexicon.load(M.lexicon_terms(spark, d)))
    rows = reports.bias_report(found, F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".docx")))
    return rows.groupBy("filename", "page_number", "category", "term").agg(F.count("*").alias("n"))


def text_reports(spark: SparkSession, d: str) -> DataFrame:
    issues = run_sql(spark, d, f"SELECT doc_id, CASE WHEN k < 3 THEN 'Missing references' ELSE 'Unused references' END AS section, concat(a, ', ', y, ' #', para_no) AS detail FROM ({PARTS})")
    return reports.text_report(issues)


def runs_of_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, f"""SELECT para_no AS id, array(named_struct('text', a, 'style', 'ref-surname'), named_struct('text', '', 'style', 'x'), named_struct('text', ' (', 'style', CAST(NULL AS string)),
  named_struct('text', y, 'style', 'bib_Year'), named_struct('text', ')', 'style', 'other')) AS segments FROM ({PARTS})""")  # fmt: skip
    return reports.segment_runs(rows, ["id"], "segments").select("id", F.col("run_no").cast("long").alias("run_no"), "text", "style")


def marked(spark: SparkSession, d: str) -> DataFrame:
    return dealt(run_sql(spark, d, MARKED), "doc_id", "para_no")


def comment_marks(spark: SparkSession, d: str) -> DataFrame:
    """What is marked in the bodies of comments, which have no style to leave alone."""
    return H.highlights(marked(spark, d).withColumn("style", F.lit(None).cast("string")))


def united_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = run_sql(spark, d, "SELECT l_partkey AS id, collect_list(l_suppkey) AS a, collect_list(l_orderkey % 50) AS b FROM {lineitem} GROUP BY l_partkey")
    return rows.select("id", F.array_join(F.sort_array(F.array_union("a", "b")), ",").alias("ids"))


NAMED_COLOURS = [*H.WORD_COLOURS, "mauve", "Yellow"]


def colours(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMED_COLOURS)), (F.col("p_partkey") % len(NAMED_COLOURS) + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), H.word_colour(name).alias("colour"))


#: Paragraphs of documents as runs of 23 characters, and spans in them that overlap, touch, lie in each other and beyond the end.
CUT_RUNS = "SELECT doc_id, para_no, run_no, substring(text, cast(run_no * 23 + 1 AS int), 23) AS text FROM {paras} LATERAL VIEW explode(sequence(0L, greatest(length(text) - 1, 0) div 23)) t AS run_no"
CUT_SPANS = """SELECT doc_id, para_no, k * 31 % (length(text) + 5) AS start, k * 31 % (length(text) + 5) + (doc_id + para_no * k) % 40 - 2 AS end,
  element_at(array('cyan', 'yellow', 'green', 'cyan'), cast((doc_id + k) % 4 + 1 AS int)) AS colour FROM {paras} LATERAL VIEW explode(sequence(0L, 5L)) t AS k"""


def cut_runs(spark: SparkSession, d: str) -> DataFrame:
    paras = M.paras(spark, d)
    return segments.coloured(*(spark.sql(q, paras=paras) for q in (CUT_RUNS, CUT_SPANS)))


def pattern_spans(spark: SparkSession, d: str) -> DataFrame:
    """Where the patterns of each group stand in documents, overlapping places of a group joined."""
    return T.merged_spans(H.onepass.pattern_places(M.docs(spark, d), ["doc_id"], "text", H.PATTERNS, H.TRIGGERS), ["doc_id", "pattern_group"])


NOTED = f"""SELECT doc_id, para_no, CASE k WHEN 0 THEN concat('as ', a, ' [1-3, 5] and (7) has') WHEN 1 THEN concat('see ^2^, (', a, ') and [x]') WHEN 2 THEN '[9, 8, 7]' ELSE concat('no mark (', b, ' 2000) ^') END AS text FROM ({PARTS})"""


def renoted(spark: SparkSession, d: str) -> DataFrame:
    """Citation marks of documents renumbered backwards in odd documents; the others keep theirs."""
    mapping = run_sql(spark, d, f"SELECT doc_id, n AS old, 20 - n AS new FROM (SELECT DISTINCT doc_id FROM ({PARTS}) WHERE doc_id % 2 = 1) LATERAL VIEW explode(sequence(1, 9)) t AS n")
    return N.renumbered_text(run_sql(spark, d, NOTED), mapping)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of jobs: some in memory, some of jobs with errors or without a route, some with a folder, one of none."""
    jobs = run_sql(spark, d, """SELECT concat('t', event_id) AS token, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS route_type,
  CASE WHEN event_id % 5 = 0 THEN '[1]' WHEN event_id % 3 = 0 THEN '' END AS errors FROM {events}""")  # fmt: skip
    memory = run_sql(spark, d, "SELECT concat('t', event_id) AS token, 'memory' AS route_type FROM {events} WHERE event_id % 4 = 0")
    folders = run_sql(spark, d, "SELECT concat('t', event_id) AS token FROM {events} WHERE event_id % 10 = 5")
    asked = run_sql(spark, d, "SELECT concat('t', event_id) AS token FROM {events} UNION ALL SELECT 'none'")
    return store.resolved_tokens(asked, memory, jobs, folders)


def one(text: str, f, name: str):
    return lambda spark, d: run_sql(spark, d, text).select("id", f(F.col("text")).alias(name))


GROUPS = [*H.PATTERNS, *H.SIGNS]
ASCII_WORDS = "regexp_replace(text, '[ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ]', 'Q', 'g')"

QUERIES = {
    "fn64_set08_credits": lambda s, d: credited(s, d).select("id", "credit"),
    "fn65_needs_permission": lambda s, d: credited(s, d).select("id", C.needs_permission(F.col("p_name"), F.col("credit")).alias("needs")),
    "fn74_pattern_counts": lambda s, d: H.group_counts(M.docs(s, d), H.PATTERNS, H.TRIGGERS),
    "fn74_pattern_spans": pattern_spans,
    "snk10_coloured_segments": cut_runs,
    "fn75_sign_counts": lambda s, d: H.group_counts(M.docs(s, d), H.SIGNS, H.SIGN_TRIGGERS),
    "fn76_italic_segments": lambda s, d: H.italic_segments(run_sql(s, d, ITALIC), ["id"]).select("id", *[F.col(c).cast("long").alias(c) for c in ("run_no", "part_no")], "text", "colour"),
    "prj11_plain_paragraphs": lambda s, d: H.not_skipped(run_sql(s, d, MARKED)).select("doc_id", "para_no"),
    "prj14_free_runs": lambda s, d: H.free_runs(run_sql(s, d, PLAIN_RUNS), run_sql(s, d, MARKS), ["id"]).select("id", F.col("run_no").cast("long").alias("run_no")),
    "fn77_pipe08_highlights": lambda s, d: H.highlights(marked(s, d)),
    "fn72_contexts": contexts,
    "fn82_comment_marks": comment_marks,
    "set09_united_ids": united_ids,
    "fn83_colours": colours,
    "jn21_renumbered_text": renoted,
    "jn23_token_cascade": tokens,
    "fn79_instructions": lambda s, d: H.instructions(run_sql(s, d, TOLD)),
    "src07_fn63_extracted": lambda s, d: dashboard.extracted(sheets(s, d)).select("doc_id", "para_no", "page", "is_caption", "is_highlighted"),
    "prj15_highlighted": lambda s, d: dashboard.extracted(sheets(s, d)).where("is_highlighted").select("doc_id", "para_no", "text"),
    "jn14_caption_summary": lambda s, d: dashboard.summary(captions.items(sheets(s, d))),
    "pipe07_dashboard": whole_dashboard,
    "fn80_formatting_audit": audit,
    "snk20_html_tables": lambda s, d: dashboard.html_table(run_sql(s, d, f"SELECT doc_id, para_no, concat('<', a, '>') AS name FROM ({PARTS})"), ["para_no", "name"], "doc_id", ["para_no"]),
    "fn90_tagged_runs": lambda s, d: B.paragraph_html(run_sql(s, d, TAGGED_RUNS), ["id"]),
    "fn91_pipe09_tables": lambda s, d: B.table_html(run_sql(s, d, CELLS), ["doc_id"]),
    "fn92_addresses": addresses,
    "fn93_chapter_data": chapters,
    "fn94_nested_lists": one(LISTS, B.nested_lists, "xml"),
    "fn95_tagged_references": lambda s, d: run_sql(s, d, REFS).select("id", B.tagged_reference(F.col("text"), F.concat(F.lit("bid_"), F.col("id"))).alias("xml")),
    "fn96_date_tags": one(DATES, B.date_tags, "xml"),
    "fn20_entities": one(ENTITIES, T.hex_entities, "text"),
    "snk02_appended_results": jobs,
    "snk05_bias_report": bias_rows,
    "snk09_text_reports": text_reports,
    "snk18_cache_lines": lambda s, d: reports.cache_lines(run_sql(s, d, "SELECT p_name AS title, p_partkey AS item FROM {part}"), "title", "item"),
    "snk19_segment_runs": runs_of_segments,
}

STYLED = "CASE WHEN p_brand LIKE '%1' THEN 'REF-N' ELSE 'Normal' END"
COUNTED = "SELECT pattern_group, sum(len(regexp_extract_all(" + ASCII_WORDS + ", '(?i)' || pattern)))::BIGINT AS n FROM documents, p GROUP BY pattern_group HAVING n > 0"


def values(groups) -> str:
    return "p(pattern_group, pattern) AS (VALUES " + ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in groups) + ")"


SHEET_ITEMS = f"""p AS ({P}), items AS (
SELECT doc_id, 'Figure' AS item_type, z || '.1' AS no, 1 AS cap FROM p WHERE k = 0 UNION ALL SELECT doc_id, 'Table', z || '.1', 0 FROM p WHERE k = 1
UNION ALL SELECT doc_id, 'Figure', z || '.1', 0 FROM p WHERE k = 1 UNION ALL SELECT doc_id, 'Table', z || '.2', 1 FROM p WHERE k = 2 UNION ALL SELECT doc_id, 'Table', z || '.2', 0 FROM p WHERE k = 5),
e AS (SELECT doc_id, item_type, no, max(cap) AS cap, max(1 - cap) AS cit FROM items GROUP BY ALL),
summary AS (SELECT doc_id, item_type, sum(cap)::BIGINT AS captions, sum(cit)::BIGINT AS citations, count(*) FILTER (cap = 0) AS missing_captions, count(*) FILTER (cit = 0) AS missing_citations FROM e GROUP BY ALL)"""
REF = "<ref id=\"bid_' || para_no || '\"><mixed-citation publication-type=\""

ORACLES = {
    "fn64_set08_credits": f"""SELECT para_no AS id, CASE k WHEN 0 THEN 'Adapted from ' || a || ' (' || y || ').' WHEN 1 THEN 'Sources: ' || a || ' ' || y || '; ' || b || ' ' || z || '.'
WHEN 3 THEN 'with permission. https://doi.org/10.1/' || z WHEN 4 THEN 'Photo credit: ' || a || ' courtesy of ' || b WHEN 5 THEN 'Illustration by ' || a END AS credit FROM ({P})""",
    "fn65_needs_permission": f"SELECT para_no AS id, CASE WHEN k IN (0, 1, 3, 4) THEN 'YES' ELSE 'NO' END AS needs FROM ({P})",
    "fn74_pattern_counts": f"WITH {values(H.PATTERNS)} {COUNTED}",
    "fn74_pattern_spans": f"""WITH {values(H.PATTERNS)}, t AS (SELECT doc_id, {ASCII_WORDS} AS text FROM documents),
m AS (SELECT doc_id, pattern_group, regexp_extract_all(text, '(?i)' || pattern) AS hits, string_split_regex(text, '(?i)' || pattern) AS gaps FROM t, p WHERE regexp_matches(text, '(?i)' || pattern)),
c AS (SELECT *, list_transform(hits, lambda h: length(h)) AS hn, list_transform(gaps, lambda g: length(g)) AS gn FROM m),
s AS (SELECT doc_id, pattern_group, unnest(list_transform(range(len(hits)), lambda i: {{'a': list_sum(gn[1:i + 1]) + coalesce(list_sum(hn[1:i]), 0), 'n': hn[i + 1]}})) AS x FROM c),
o AS (SELECT DISTINCT doc_id, pattern_group, x.a::BIGINT AS start, (x.a + x.n)::BIGINT AS "end" FROM s),
r AS (SELECT *, max("end") OVER (PARTITION BY doc_id, pattern_group ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum((reach IS NULL OR start >= reach)::INT) OVER (PARTITION BY doc_id, pattern_group ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT doc_id, pattern_group, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, pattern_group, island""",
    "snk10_coloured_segments": f"""WITH {M.PARAS}, ch AS (SELECT doc_id, para_no, unnest(range(length(text))) AS i, text FROM paras),
sp AS (SELECT doc_id, para_no, k * 31 % (length(text) + 5) AS a, k * 31 % (length(text) + 5) + (doc_id + para_no * k) % 40 - 2 AS z, (['cyan', 'yellow', 'green', 'cyan'])[(doc_id + k) % 4 + 1] AS colour FROM paras, range(6) t(k)),
co AS (SELECT ch.doc_id, ch.para_no, ch.i, max(CASE colour WHEN 'yellow' THEN 3 WHEN 'cyan' THEN 2 WHEN 'green' THEN 1 END) AS top FROM ch JOIN sp ON sp.doc_id = ch.doc_id AND sp.para_no = ch.para_no AND ch.i >= a AND ch.i < z GROUP BY ALL),
f AS (SELECT ch.doc_id, ch.para_no, ch.i, ch.i // 23 AS run_no, substr(ch.text, ch.i + 1, 1) AS c, top FROM ch LEFT JOIN co USING (doc_id, para_no, i)),
g AS (SELECT *, coalesce((lag(coalesce(top, 0)) OVER w <> coalesce(top, 0))::INT, 0) AS new FROM f WINDOW w AS (PARTITION BY doc_id, para_no, run_no ORDER BY i)),
n AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, para_no, run_no ORDER BY i)::BIGINT AS seg_no FROM g)
SELECT doc_id, para_no, run_no, seg_no, string_agg(c, '' ORDER BY i) AS text, any_value((['green', 'cyan', 'yellow'])[top]) AS colour FROM n GROUP BY doc_id, para_no, run_no, seg_no""",
    "fn75_sign_counts": f"WITH {values(H.SIGNS)} {COUNTED}",
    "fn76_italic_segments": f"""WITH p AS ({P}) SELECT para_no AS id, 0 AS run_no, unnest(range(4)) AS part_no, unnest([a, ',', ' ' || b, '.']) AS text, unnest([NULL, 'cyan', NULL, 'cyan']) AS colour FROM p
UNION ALL SELECT para_no, 2, unnest(range(3)), unnest([c, ':', y]), unnest([NULL, 'cyan', NULL]) FROM p WHERE k >= 3""",
    "prj11_plain_paragraphs": f"SELECT doc_id, para_no FROM ({P}) WHERE p_brand NOT LIKE '%1'",
    "prj14_free_runs": f"""SELECT para_no AS id, run_no FROM ({P}), range(5) t(run_no)
WHERE run_no = 0 OR k >= 4 OR (k IN (2, 3) AND run_no >= k) OR (k = 1 AND run_no > 1)""",
    "fn77_pipe08_highlights": f"""WITH p AS (SELECT *, {STYLED} AS style FROM ({P}))
SELECT doc_id, para_no, 'cyan' AS colour, CASE k WHEN 0 THEN 'number_words' WHEN 1 THEN 'numbers_1000' WHEN 2 THEN 'greek,versus' WHEN 3 THEN 'degrees,numbers_0_99,special'
WHEN 4 THEN 'time_period' ELSE 'comparison,latin' END AS groups FROM p WHERE style <> 'REF-N' AND k <> 5
UNION ALL SELECT doc_id, para_no, 'magenta', 'Cyrillic' FROM p WHERE k = 4""",
    "fn82_comment_marks": f"""WITH p AS ({P}) SELECT doc_id, para_no, 'cyan' AS colour, ['number_words', 'numbers_1000', 'greek,versus', 'degrees,numbers_0_99,special', 'time_period', '', 'comparison,latin'][k + 1] AS groups FROM p WHERE k <> 5
UNION ALL SELECT doc_id, para_no, 'magenta', 'Cyrillic' FROM p WHERE k = 4""",
    "fn83_colours": f"SELECT p_partkey AS id, ([{', '.join('NULL' if v is None else repr(v) for v in H.WORD_COLOURS.values())}, 'yellow', 'yellow'])[p_partkey % {len(NAMED_COLOURS)} + 1] AS colour FROM part",
    "jn21_renumbered_text": f"""SELECT doc_id, para_no, CASE k WHEN 0 THEN 'as ' || a || CASE WHEN doc_id % 2 = 1 THEN ' 15, 17-19 and 13 has' ELSE ' 1-3, 5 and 7 has' END
WHEN 1 THEN 'see ' || CASE WHEN doc_id % 2 = 1 THEN '18' ELSE '2' END || ', (' || a || ') and [x]' WHEN 2 THEN CASE WHEN doc_id % 2 = 1 THEN '11-13' ELSE '7-9' END ELSE 'no mark (' || b || ' 2000) ^' END AS text FROM ({P})""",
    "jn23_token_cascade": """SELECT 't' || event_id AS token, CASE WHEN event_id % 4 = 0 THEN 'memory' WHEN event_id % 5 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 'general' ELSE event_type END
WHEN event_id % 10 = 5 THEN 'recovered' END AS route_type FROM events UNION ALL SELECT 'none', NULL""",
    "set09_united_ids": "SELECT id, string_agg(x::VARCHAR, ',' ORDER BY x) AS ids FROM (SELECT l_partkey AS id, l_suppkey AS x FROM lineitem UNION SELECT l_partkey, l_orderkey % 50 FROM lineitem) GROUP BY id",
    "fn79_instructions": f"""WITH p AS ({P}) SELECT doc_id, para_no, 'refer ' || a AS instruction FROM p WHERE k = 0 UNION ALL SELECT doc_id, para_no, 'Insert ' || b FROM p WHERE k = 0
UNION ALL SELECT doc_id, para_no, 'Pick-up ' || split_part(p_name, ' ', 1) FROM p WHERE k = 1
UNION ALL SELECT doc_id, para_no, unnest(['VIDEO ' || y, 'see ' || z]) FROM p WHERE k = 4""",
    "fn72_contexts": f"""WITH {M.SENTS}, h AS (SELECT doc_id, para_no, sent_no, sentence, regexp_extract(sentence, '(?s)^(.*?)(?:^|[^A-Za-z0-9_À-ÖØ-öø-ÿ])the(?:$|[^A-Za-z0-9_À-ÖØ-öø-ÿ])', 1) AS lead,
regexp_matches(sentence, '(?:^|[^A-Za-z0-9_À-ÖØ-öø-ÿ])the(?:$|[^A-Za-z0-9_À-ÖØ-öø-ÿ])') AS hit FROM sents),
s AS (SELECT *, length(lead) + (sentence[length(lead) + 1:length(lead) + 3] <> 'the' OR length(lead) > 0)::INT AS sp FROM h WHERE hit),
w AS (SELECT *, substr(sentence, 1, sp) AS before, substr(sentence, sp + 4) AS after FROM s)
SELECT doc_id, para_no, sent_no, regexp_extract(before, '(?:\\S+\\s+){{0,4}}\\S*$') || 'the' || regexp_extract(after, '^\\S*(?:\\s+\\S+){{0,4}}\\s?') AS context FROM w""",
    "src07_fn63_extracted": f"SELECT doc_id, para_no, (para_no - 1) // 40 + 1 AS page, k IN (0, 2, 4) AS is_caption, k IN (0, 6) AS is_highlighted FROM ({P}) WHERE k <> 3",
    "prj15_highlighted": f"SELECT doc_id, para_no, CASE k WHEN 0 THEN 'Figure ' || z || '-1 ' || p_name ELSE 'Text of ' || a END AS text FROM ({P}) WHERE k IN (0, 6)",
    "jn14_caption_summary": f"WITH {SHEET_ITEMS} SELECT *, round((greatest(captions, citations) - missing_captions - missing_citations) / greatest(captions, citations) * 100, 1) AS complete FROM summary",
    "pipe07_dashboard": f"""WITH {SHEET_ITEMS}, f AS (SELECT * FROM summary WHERE item_type = 'Figure'), t AS (SELECT * FROM summary WHERE item_type = 'Table'),
b AS (SELECT doc_id, count(*) AS paragraphs, max((para_no - 1) // 40 + 1) AS pages, count(*) FILTER (k IN (0, 6)) AS highlighted, count(*) FILTER (k = 5) AS instructions FROM p WHERE k <> 3 GROUP BY doc_id),
m AS (SELECT doc_id, count(*) FILTER (k = 1) AS comments, CASE WHEN doc_id % 2 = 0 THEN count(*) ELSE 0 END AS images, CASE WHEN doc_id % 2 = 0 THEN max(para_no) ELSE 0 END AS footnotes, CASE WHEN doc_id % 2 = 0 THEN min(para_no) ELSE 0 END AS endnotes FROM p GROUP BY doc_id)
SELECT b.*, {", ".join(f"coalesce({k[0].lower()}.{n}, 0) AS {k}_{n}" for k in ("Figure", "Table") for n in ("captions", "citations", "missing_captions", "missing_citations"))}, comments, images, footnotes, endnotes
FROM b LEFT JOIN f USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "fn80_formatting_audit": f"""WITH p AS ({P}), t AS (SELECT *, substr(p_name || ' of ' || a || ', ' || b || ' and ' || c || ' in the years ' || y || ' and ' || z || ' or later', 1, 50) AS detail FROM p)
SELECT doc_id, (para_no - 1) // 40 + 1 AS page, 'Strikethrough' AS category, detail FROM t WHERE k = 1 UNION ALL SELECT doc_id, (para_no - 1) // 40 + 1, 'Hidden', detail FROM t WHERE k IN (1, 6)
UNION ALL SELECT doc_id, NULL, 'Section Break', 'Section ' || unnest(range(1, max(k) + 1)) FROM p GROUP BY doc_id""",
    "snk20_html_tables": f"""SELECT doc_id, '<table><thead><tr><th>para_no</th><th>name</th></tr></thead><tbody>' || string_agg('<tr><td>' || para_no || '</td><td>&lt;' || a || '&gt;</td></tr>', '' ORDER BY para_no) || '</tbody></table>' AS html
FROM ({P}) GROUP BY doc_id""",
    "fn90_tagged_runs": f"""SELECT para_no AS id, '<p class="Body">' || CASE k WHEN 1 THEN '<smallcaps><strong>a&lt;' || a || '</strong></smallcaps>' WHEN 2 THEN '<strong><em>a&lt;' || a || '</em></strong>' ELSE '<strong>a&lt;' || a || '</strong>' END
|| CASE k WHEN 1 THEN '<smallcaps><cite><u>' || b || '</u></cite></smallcaps>' WHEN 3 THEN '<strikethrough><cite><u>' || b || '</u></cite></strikethrough>' WHEN 4 THEN '<cite><sup><u>' || b || '</u></sup></cite>'
WHEN 5 THEN '<cite><sub><u>' || b || '</u></sub></cite>' ELSE '<cite><u>' || b || '</u></cite>' END || '</p>' AS html FROM ({P})""",
    "fn91_pipe09_tables": f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS i FROM ({P})),
n AS (SELECT *, (SELECT min(q.i) FROM p q WHERE q.doc_id = p.doc_id AND q.i > p.i AND q.k <= 4) AS stop, max(i) OVER (PARTITION BY doc_id) AS last FROM p),
c AS (SELECT doc_id, para_no, CASE WHEN k = 2 THEN ' align="right"' ELSE '' END AS al, k, a, CASE WHEN k > 4 AND i > 1 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.doc_id = n.doc_id AND q.i < n.i AND q.k <= 4) THEN 0 ELSE 1 END AS seen, coalesce(stop, last + 1) - i AS span FROM n),
l AS (SELECT doc_id, para_no, '<tr><td' || CASE WHEN k = 1 THEN ' colspan="2"' ELSE '' END || al || '>' || a || '0</td>' || CASE WHEN k > 4 THEN '' ELSE '<td' || CASE WHEN span > 1 THEN ' rowspan="' || span || '"' ELSE '' END || al || '>' || a || '1</td>' END || '</tr>' AS line FROM c)
SELECT doc_id, '<table>' || string_agg(line, '' ORDER BY para_no) || '</table>' AS html FROM l GROUP BY doc_id""",
    "fn92_addresses": """WITH b AS (SELECT page_id, url, replace(replace(url, 'https://', ''), 'http://', '') AS bare FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'http://' || bare WHEN 1 THEN 'mailto:me@' || split_part(bare, '/', 1) ELSE url END AS href FROM b""",
    "fn93_chapter_data": f"""SELECT para_no AS id, 'Chapter ' || z AS label, z AS number, 'The ' || p_name AS title, CASE WHEN k < 4 THEN a || '/Ann;' || b || '/Bo Lee;' || c || '/' ELSE '' END AS authors,
CASE WHEN k % 2 = 0 THEN 'About ' || p_name END AS abstract, a || ';' || b AS keywords FROM ({P})""",
    "fn94_nested_lists": f"""SELECT para_no AS id, CASE k % 3
WHEN 0 THEN '<list list-type="order"><list-item>' || a || '<list list-type="bullet"><list-item>' || b || '</list-item><list-item>' || c || '</list-item></list></list-item><list-item>' || y || '</list-item></list>'
WHEN 1 THEN '<list list-type="none"><list-item>' || a || '</list-item></list>'
ELSE '<list list-type="lower-alpha"><list-item>' || a || '<list list-type="upper-roman"><list-item>' || b || '<list list-type="order"><list-item>' || c || '</list-item></list></list-item></list></list-item></list>' END AS xml FROM ({P})""",
    "fn95_tagged_references": f"""WITH r AS (SELECT para_no, k, '<surname>' || a || '</surname>, <given-names>J.</given-names> (<year>' || y || CASE k WHEN 1 THEN 'b' ELSE '' END || '</year>) ' AS who, p_name, z FROM ({P}))
SELECT para_no AS id, '{REF}' || CASE k WHEN 0 THEN 'article">' || who || '<article-title>' || p_name || '</article-title> <volume>' || z || '</volume>' WHEN 1 THEN 'other">' || who || '<source>' || p_name || '</source>'
WHEN 2 THEN 'book">' || who || '<source>' || p_name || '</source> <publisher-name>P</publisher-name>'
WHEN 3 THEN 'web">' || who || '<ext-link ext-link-type="uri" xlink:href="http://x.y/' || z || '">http://x.y/' || z || '</ext-link> <issue>1</issue>'
ELSE 'web">' || who || '<ext-link ext-link-type="doi" xlink:href="10.1/' || z || '">10.1/' || z || '</ext-link>' END || '</mixed-citation></ref>' AS xml FROM r""",
    "fn96_date_tags": f"""SELECT para_no AS id, CASE k WHEN 0 THEN '<day>12</day> <month>May</month> <year>' || y || '</year>' WHEN 1 THEN '<year>' || y || 'a</year>'
WHEN 2 THEN '<month>March</month> <day>3</day>, <year>' || y || '</year>' ELSE '<year>' || y || '</year>, <year>' || z || '</year>' END AS xml FROM ({P})""",
    "fn20_entities": "SELECT p_partkey AS id, 'a&#x' || lpad(to_hex(p_partkey + 160), greatest(4, length(to_hex(p_partkey + 160)))::INT, '0') || ';b & c&#x' || lpad(to_hex(p_size::BIGINT), 4, '0') || ';' AS text FROM part",
    "snk02_appended_results": "SELECT s_suppkey AS file_id, s_nationkey::INT AS total_references FROM supplier UNION ALL SELECT p_partkey + 1000, p_size FROM part",
    "snk09_text_reports": f"""WITH p AS (SELECT *, CASE WHEN k < 3 THEN 'Missing references' ELSE 'Unused references' END AS section, a || ', ' || y || ' #' || para_no AS detail FROM ({P})),
s AS (SELECT doc_id, section, section || ' (' || count(*) || ')' || chr(10) || string_agg('  - ' || detail, chr(10) ORDER BY detail) AS block FROM p GROUP BY doc_id, section)
SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY section) AS report FROM s GROUP BY doc_id""",
    "snk18_cache_lines": """SELECT '{"key":"' || p_name || '","value":' || max(p_partkey) || '}' AS line FROM part GROUP BY p_name""",
    "snk19_segment_runs": f"""SELECT para_no AS id, unnest([0, 2, 3, 4])::BIGINT AS run_no, unnest([a, ' (', y, ')']) AS text, unnest(['bib_surname', NULL, 'bib_year', NULL]) AS style FROM ({P})""",
    "snk05_bias_report": f"""WITH {M.SENTS}, t(term, category) AS (VALUES ('stupid', 'again'), ('Thin', 'body'), ('lying', 'act'), ('The', 'words'), ('for the', 'words'), ('THE', 'upper')),
g AS (SELECT doc_id, para_no, greatest(1, ceil(coalesce(sum({M.WORDS.format('text')}) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160))::BIGINT AS page FROM paras)
SELECT 'doc' || doc_id || '.docx' AS filename, page AS page_number, category, term, count(*) AS n FROM sents JOIN g USING (doc_id, para_no), t
WHERE regexp_matches(sentence, (CASE WHEN term = upper(term) THEN '' ELSE '(?i)' END) || '(^|[^A-Za-z0-9_À-ÿ])' || term || '($|[^A-Za-z0-9_À-ÿ])') GROUP BY ALL""",
}
ORACLES["pipe05_lexicon_report"] = ORACLES["snk05_bias_report"].replace("'doc' || doc_id || '.docx' AS filename, page AS page_number, category, term, count(*) AS n", "doc_id, page, category, term, sent_no, para_no").replace(" GROUP BY ALL", "")
