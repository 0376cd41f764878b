"""Text substrate, lexicon and pattern scans, captions and credits, over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import captions, lexicon
from marginalia.plans.sqlquery import run_sql
from marginalia.sources.tables import table
from marginalia.sources.texts import decoded


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def paras(spark: SparkSession, d: str) -> DataFrame:
    return T.paragraphs(docs(spark, d))


def long(c: Column) -> Column:
    return c.cast("long")


def lexicon_terms(spark: SparkSession, d: str) -> DataFrame:
    """A lexicon as its file would give it: categories and terms, one term twice."""
    return spark.createDataFrame([(1, "person", "stupid"), (2, "body", "Thin"), (3, "act", "lying"), (4, "words", "The"), (5, "words", "for the"), (6, "again", "stupid"), (7, "upper", "THE")], "line_no int, category string, term string")


def caption_texts(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs built from parts: captions of figures and tables, mentions, credits."""
    return run_sql(spark, d, """
SELECT p_partkey % 50 AS doc_id, p_partkey AS para_no,
       CASE WHEN p_partkey % 7 = 0 THEN concat('Figure ', p_size, '.', p_partkey % 9, ' ', p_name)
            WHEN p_partkey % 7 = 1 THEN concat('Table ', p_size, '.', p_partkey % 9, ' ', p_type)
            WHEN p_partkey % 7 = 2 THEN concat('as Fig. ', p_size, '-', p_partkey % 9, ' shows')
            WHEN p_partkey % 7 = 3 THEN concat('Source: ', p_brand, ' Press')
            WHEN p_partkey % 7 = 4 THEN concat('see Table ', p_size, '.', p_partkey % 9)
            ELSE p_name END AS text
FROM {part}""")


CAPTION_SQL = """
paras AS (SELECT p_partkey % 50 AS doc_id, p_partkey AS para_no, p_partkey % 7 AS k, p_size || '.' || (p_partkey % 9) AS no, p_brand, p_name, p_type FROM part),
items AS (SELECT doc_id, para_no, CASE WHEN k IN (0, 2) THEN 'Figure' ELSE 'Table' END AS item_type, no AS item_no, k IN (0, 1) AS is_caption FROM paras WHERE k IN (0, 1, 2, 4))"""


def items(spark: SparkSession, d: str) -> DataFrame:
    return captions.items(caption_texts(spark, d))


def unmatched(spark: SparkSession, d: str, captions_: bool) -> DataFrame:
    a, b = (items(spark, d).where(F.col("is_caption") == x).select("doc_id", "item_type", "item_no").distinct() for x in (captions_, not captions_))
    return a.join(b, ["doc_id", "item_type", "item_no"], "left_anti")


def completion(spark: SparkSession, d: str) -> DataFrame:
    """Share of each document's items that are both captioned and cited."""
    each = items(spark, d).groupBy("doc_id", "item_type", "item_no").agg(F.max(F.col("is_caption").cast("int")).alias("cap"), F.max((~F.col("is_caption")).cast("int")).alias("cit"))
    per = each.groupBy("doc_id").agg(F.sum("cap").alias("caps"), F.sum("cit").alias("cits"), F.sum(((F.col("cap") == 1) & (F.col("cit") == 0)).cast("int")).alias("uncited"), F.sum(((F.col("cap") == 0) & (F.col("cit") == 1)).cast("int")).alias("uncaptioned"))
    total = F.greatest("caps", "cits")
    return per.select("doc_id", long(F.col("uncited")).alias("uncited"), long(F.col("uncaptioned")).alias("uncaptioned"), F.when(total > 0, F.round((total - F.col("uncited") - F.col("uncaptioned")) / total * 100, 1)).otherwise(0.0).alias("completion"))


def scripts(spark: SparkSession, d: str) -> DataFrame:
    """Pages on which each script occurs."""
    pages = T.pages_by_words(paras(spark, d))
    rows = paras(spark, d).join(pages, ["doc_id", "para_no"])
    each = F.array_compact(F.array(*[F.when(F.col("text").rlike(f"[{a}-{z}]"), F.lit(n)) for n, a, z in T.SCRIPTS]))
    return rows.select("doc_id", "page", F.explode(each).alias("script")).groupBy("script", "doc_id").agg(F.array_join(F.sort_array(F.collect_set("page")), ",").alias("pages"))


def balance(spark: SparkSession, d: str) -> DataFrame:
    """Opening and closing delimiters of each document."""
    n = lambda c: long(F.length("text") - F.length(F.replace("text", F.lit(c), F.lit(""))))
    return docs(spark, d).select("doc_id", n("(").alias("open_round"), n(")").alias("close_round"), n("[").alias("open_square"), n("]").alias("close_square"), (n("(") == n(")")).alias("balanced"))


def estimates(spark: SparkSession, d: str) -> DataFrame:
    per = paras(spark, d).groupBy("doc_id").agg(F.sum(T.n_words(F.col("text"))).alias("words"), F.count("*").alias("n_paras"))
    return per.select("doc_id", "words", (F.expr("n_paras div 40") + 1).alias("pages_by_paras"), (F.expr("words div 250") + 1).alias("pages_by_words"))




def marks(k: int) -> Column:
    return (F.length("text") % 11) == k


PARAS = "paras AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS para_no, unnest(string_split(text, chr(10))) AS text FROM documents)"
WORDS = "len(regexp_extract_all({}, '[^ \\t\\n]+'))"
SENTS = PARAS + ", sents AS (SELECT doc_id, para_no, unnest(range(len(regexp_extract_all(text, '[^.!?]+[.!?]*')))) AS sent_no, unnest(regexp_extract_all(text, '[^.!?]+[.!?]*')) AS sentence FROM paras)"

QUERIES = {
    "src03_paragraphs": lambda s, d: paras(s, d).select("doc_id", "para_no", F.btrim("text", F.lit(" \t\r")).alias("text")).where("text <> ''"),
    "src10_lexicon_last_wins": lambda s, d: lexicon.load(lexicon_terms(s, d)).select("term", "category"),
    "src17_src18_charsets": lambda s, d: charset_pages(s, d),
    "src17_html_length": lambda s, d: table(s, d, "pages").select("page_id", long(F.length(T.without_images(F.col("html")))).alias("n")),
    "fn07_collapse_space": lambda s, d: docs(s, d).select("doc_id", F.md5(T.collapse_space(F.col("text")).cast("binary")).alias("h")),
    "fn16_head": lambda s, d: docs(s, d).select("doc_id", F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text")).alias("head")),
    "fn17_escape_html": lambda s, d: table(s, d, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("h")),
    "fn18_strip_tags": lambda s, d: table(s, d, "pages").select("page_id", long(F.length(T.strip_tags(F.col("html")))).alias("n")),
    "agg21_tag_counts": lambda s, d: table(s, d, "pages").select("page_id", long(F.regexp_count(F.lower("html"), F.lit("<p"))).alias("n")),
    "fn70_sentences": lambda s, d: T.sentences(paras(s, d)).where("trim(sentence) <> ''"),
    "win07_pages_by_breaks": lambda s, d: T.pages_by_breaks(paras(s, d), marks(3).cast("int")),
    "win08_pages_by_words": lambda s, d: T.pages_by_words(paras(s, d)),
    "win09_positional_pages": lambda s, d: paras(s, d).select("doc_id", "para_no", (F.expr("(para_no - 1) div 40") + 1).alias("page")),
    "win05_level_jumps": lambda s, d: paras(s, d).withColumn("level", long(F.length("text") % 6 + 1)).withColumn("prev", F.lag("level").over(W.partitionBy("doc_id").orderBy("para_no"))).where("level > prev + 1").select("doc_id", "para_no", "level", "prev"),
    "win10_citation_runs": lambda s, d: citation_runs(paras(s, d)),
    "win11_merged_spans": lambda s, d: T.merged_spans(table(s, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") * 10).alias("start"), (F.col("l_partkey") * 10 + F.col("l_quantity").cast("long")).alias("end")), ["doc_id"]),
    "prj09_section_rows": lambda s, d: T.section_rows(paras(s, d), marks(2), marks(5)).select("doc_id", "para_no"),
    "prj10_rows_before": lambda s, d: T.rows_before(paras(s, d), marks(4)).select("doc_id", "para_no"),
    "prj12_length_guard": lambda s, d: docs(s, d).select("doc_id", F.length("text").alias("n")).withColumn("m", F.lag("n").over(W.partitionBy(F.col("doc_id") % 100).orderBy("doc_id"))).where("n > 0 AND m > 0 AND least(n, m) / greatest(n, m) >= 0.6").select("doc_id"),
    "agg17_scripts": scripts,
    "agg18_estimates": estimates,
    "agg19_balance": balance,
    "jn15_fn71_lexicon_hits": lambda s, d: lexicon.hits(T.sentences(paras(s, d)), lexicon.load(lexicon_terms(s, d))).groupBy("category", "term").agg(F.count("*").alias("n")),
    "pipe05_lexicon_report": lambda s, d: lexicon.report(paras(s, d), lexicon.load(lexicon_terms(s, d))).select("doc_id", "page", "category", "term", "sent_no", "para_no"),
    "fn60_caption_items": lambda s, d: items(s, d),
    "jn13_uncited_captions": lambda s, d: unmatched(s, d, True),
    "jn13_uncaptioned_citations": lambda s, d: unmatched(s, d, False),
    "agg14_completion": completion,
    "agg15_items_by_type": lambda s, d: items(s, d).groupBy("item_type").agg(F.count("*").alias("n"), long(F.sum(F.col("is_caption").cast("int"))).alias("captions")),
    "agg16_first_place": lambda s, d: items(s, d).groupBy("doc_id", "item_type", "item_no", "is_caption").agg(F.min("para_no").alias("first_para")),
    "jn16_pipe06_permission_log": lambda s, d: captions.permission_log(caption_texts(s, d)),
    "jn22_overlapping_runs": lambda s, d: overlaps(s, d),
}


CHARSET_BYTES = [("windows-1252", "93e9942080", "“é” €"), ("windows-1251", "cff0e8e2e5f2", "Привет"), ("windows-1250", "9ae8f8", "ščř"), ("koi8-r", "f0d2c9d7c5d4", "Привет"), ("iso-8859-1", "e920a3", "é £"), ("utf-8", "c3a9e282ac", "é€")]


def charset_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose titles are bytes of several character sets, each declared in the page."""
    cases = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(h).alias("hex")) for n, h, _ in CHARSET_BYTES])
    case = F.element_at(cases, (F.col("page_id") % len(CHARSET_BYTES) + 1).cast("int"))
    head = F.encode(F.concat(F.lit('<html><meta charset="'), case["name"], F.lit('"><title>')), "US-ASCII")
    content = F.concat(head, F.unhex(case["hex"]), F.encode(F.concat(F.lit("</title>"), F.regexp_replace("url", "[^ -~]", "")), "US-ASCII"))
    return table(spark, d, "pages").select("page_id", decoded(content).alias("html"))


def citation_runs(p: DataFrame) -> DataFrame:
    """Neighbouring paragraphs of a kind joined into runs."""
    w = W.partitionBy("doc_id").orderBy("para_no")
    kind = (F.length("text") % 3) == 0
    run = p.withColumn("cite", kind).withColumn("run", F.sum((~F.col("cite")).cast("int")).over(w))
    return run.where("cite").groupBy("doc_id", "run").agg(F.min("para_no").alias("first_para"), F.count("*").alias("n")).drop("run")


def overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of text that a span runs through: a range join within a document, whose spans and runs are few."""
    li = table(spark, d, "lineitem")
    spans = li.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 100).alias("start"), (F.col("l_partkey") % 100 + 15).alias("end"))
    runs = li.select(F.col("l_orderkey").alias("r_doc"), (F.col("l_linenumber") * 20).cast("long").alias("r_start"), (F.col("l_linenumber") * 20 + F.col("l_quantity").cast("long")).alias("r_end"))
    return spans.join(runs, (F.col("doc_id") == F.col("r_doc")) & (F.col("r_start") < F.col("end")) & (F.col("r_end") > F.col("start"))).select("doc_id", "start", "r_start", "r_end")


ORACLES = {
    "src03_paragraphs": f"WITH {PARAS} SELECT doc_id, para_no, trim(text, ' ' || chr(9) || chr(13)) AS text FROM paras WHERE trim(text, ' ' || chr(9) || chr(13)) <> ''",
    "src10_lexicon_last_wins": "SELECT * FROM (VALUES ('stupid', 'again'), ('Thin', 'body'), ('lying', 'act'), ('The', 'words'), ('for the', 'words'), ('THE', 'upper')) t(term, category)",
    "src17_src18_charsets": f"""SELECT page_id, '<html><meta charset="' || ({[n for n, *_ in CHARSET_BYTES]!r})[page_id % {len(CHARSET_BYTES)} + 1] || '"><title>' || ({[t for *_, t in CHARSET_BYTES]!r})[page_id % {len(CHARSET_BYTES)} + 1]
|| '</title>' || regexp_replace(url, '[^ -~]', '', 'g') AS html FROM pages""",
    "src17_html_length": r"SELECT page_id, length(regexp_replace(regexp_replace(html, '<img[^>]*>', '', 'gi'), 'url\(data:[^)]*\)', '', 'g')) AS n FROM pages",
    "fn07_collapse_space": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) AS h FROM documents",
    "fn16_head": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS head FROM documents",
    "fn17_escape_html": "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages",
    "fn18_strip_tags": "SELECT page_id, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages",
    "agg21_tag_counts": "SELECT page_id, (length(lower(html)) - length(replace(lower(html), '<p', ''))) // 2 AS n FROM pages",
    "fn70_sentences": f"WITH {SENTS} SELECT doc_id, para_no, sent_no, (length(regexp_extract((SELECT text FROM paras p WHERE p.doc_id = s.doc_id AND p.para_no = s.para_no), '^[.!?]*')) + coalesce(sum(length(sentence)) OVER (PARTITION BY doc_id, para_no ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, sentence FROM sents s QUALIFY trim(sentence) <> ''",
    "win07_pages_by_breaks": f"WITH {PARAS} SELECT doc_id, para_no, (1 + coalesce(sum((length(text) % 11 = 3)::INT) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS page FROM paras",
    "win08_pages_by_words": f"WITH {PARAS} SELECT doc_id, para_no, greatest(1, ceil(coalesce(sum({WORDS.format('text')}) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160))::BIGINT AS page FROM paras",
    "win09_positional_pages": f"WITH {PARAS} SELECT doc_id, para_no, (para_no - 1) // 40 + 1 AS page FROM paras",
    "win05_level_jumps": f"WITH {PARAS}, l AS (SELECT doc_id, para_no, (length(text) % 6 + 1)::BIGINT AS level FROM paras), g AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY para_no) AS prev FROM l) SELECT * FROM g WHERE level > prev + 1",
    "win10_citation_runs": f"WITH {PARAS}, c AS (SELECT *, length(text) % 3 = 0 AS cite FROM paras), r AS (SELECT *, sum((NOT cite)::INT) OVER (PARTITION BY doc_id ORDER BY para_no) AS run FROM c) SELECT doc_id, min(para_no) AS first_para, count(*) AS n FROM r WHERE cite GROUP BY doc_id, run",
    "win11_merged_spans": """WITH s AS (SELECT l_suppkey AS doc_id, l_partkey * 10 AS start, l_partkey * 10 + l_quantity::BIGINT AS "end" FROM lineitem),
m AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum((reach IS NULL OR start >= reach)::INT) OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT doc_id, min(start) AS start, max("end") AS "end" FROM i GROUP BY doc_id, island""",
    "prj09_section_rows": f"WITH {PARAS}, m AS (SELECT *, CASE length(text) % 11 WHEN 2 THEN 1 WHEN 5 THEN 0 END AS mark FROM paras), s AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_no) AS inside FROM m) SELECT doc_id, para_no FROM s WHERE inside = 1 AND mark IS NULL",
    "prj10_rows_before": f"WITH {PARAS} SELECT doc_id, para_no FROM paras p WHERE NOT EXISTS (SELECT 1 FROM paras q WHERE q.doc_id = p.doc_id AND length(q.text) % 11 = 4 AND q.para_no <= p.para_no)",
    "prj12_length_guard": "WITH n AS (SELECT doc_id, length(text) AS n, lag(length(text)) OVER (PARTITION BY doc_id % 100 ORDER BY doc_id) AS m FROM documents) SELECT doc_id FROM n WHERE n > 0 AND m > 0 AND least(n, m) / greatest(n, m) >= 0.6",
    "agg17_scripts": f"""WITH {PARAS}, p AS (SELECT doc_id, text, greatest(1, ceil(coalesce(sum({WORDS.format('text')}) OVER (PARTITION BY doc_id ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 160))::BIGINT AS page FROM paras),
s AS (SELECT DISTINCT k.script, doc_id, page FROM p, (VALUES {', '.join(f"('{n}', '[{a}-{z}]')" for n, a, z in T.SCRIPTS)}) k(script, pattern) WHERE regexp_matches(text, k.pattern))
SELECT script, doc_id, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM s GROUP BY script, doc_id""",
    "agg18_estimates": f"WITH {PARAS}, e AS (SELECT doc_id, sum({WORDS.format('text')})::BIGINT AS words, count(*) AS n FROM paras GROUP BY doc_id) SELECT doc_id, words, n // 40 + 1 AS pages_by_paras, words // 250 + 1 AS pages_by_words FROM e",
    "agg19_balance": "WITH n AS (SELECT doc_id, " + ", ".join(f"length(text) - length(replace(text, '{c}', '')) AS {n}" for c, n in (("(", "open_round"), (")", "close_round"), ("[", "open_square"), ("]", "close_square"))) + " FROM documents) SELECT *, open_round = close_round AS balanced FROM n",
    "fn60_caption_items": f"WITH {CAPTION_SQL} SELECT * FROM items",
    "jn13_uncited_captions": f"WITH {CAPTION_SQL} SELECT doc_id, item_type, item_no FROM items WHERE is_caption EXCEPT SELECT doc_id, item_type, item_no FROM items WHERE NOT is_caption",
    "jn13_uncaptioned_citations": f"WITH {CAPTION_SQL} SELECT doc_id, item_type, item_no FROM items WHERE NOT is_caption EXCEPT SELECT doc_id, item_type, item_no FROM items WHERE is_caption",
    "agg14_completion": f"""WITH {CAPTION_SQL}, e AS (SELECT doc_id, item_type, item_no, max(is_caption::INT) AS cap, max((NOT is_caption)::INT) AS cit FROM items GROUP BY ALL),
p AS (SELECT doc_id, greatest(sum(cap), sum(cit)) AS total, sum((cap = 1 AND cit = 0)::INT)::BIGINT AS uncited, sum((cap = 0 AND cit = 1)::INT)::BIGINT AS uncaptioned FROM e GROUP BY doc_id)
SELECT doc_id, uncited, uncaptioned, CASE WHEN total > 0 THEN round((total - uncited - uncaptioned) / total * 100, 1) ELSE 0 END::DOUBLE AS completion FROM p""",
    "agg15_items_by_type": f"WITH {CAPTION_SQL} SELECT item_type, count(*) AS n, sum(is_caption::INT)::BIGINT AS captions FROM items GROUP BY item_type",
    "agg16_first_place": f"WITH {CAPTION_SQL} SELECT doc_id, item_type, item_no, is_caption, min(para_no) AS first_para FROM items GROUP BY ALL",
    "jn16_pipe06_permission_log": f"""WITH {CAPTION_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para_no) AS i FROM paras), c AS (SELECT * FROM n WHERE k IN (0, 1)),
x AS (SELECT c.doc_id, c.para_no, c.i, (SELECT min(s.i) FROM n s WHERE s.doc_id = c.doc_id AND s.k IN (0, 1) AND s.i > c.i AND s.i <= c.i + 9) AS stop, (SELECT min(s.i) FROM n s WHERE s.doc_id = c.doc_id AND s.k = 3 AND s.i > c.i AND s.i <= c.i + 9) AS hit FROM c)
SELECT x.doc_id, x.para_no, CASE WHEN n.k = 0 THEN 'Figure' ELSE 'Table' END AS item_type, n.no AS item_no, CASE WHEN n.k = 0 THEN n.p_name ELSE n.p_type END AS caption, coalesce('Source: ' || h.p_brand || ' Press', '') AS credit, split_part(n.no, '.', 1) AS chapter,
       CASE WHEN h.i IS NULL THEN 'NO' ELSE 'YES' END AS needs_permission
FROM x JOIN n ON n.doc_id = x.doc_id AND n.i = x.i LEFT JOIN n h ON h.doc_id = x.doc_id AND h.i = x.hit AND (x.stop IS NULL OR x.hit < x.stop)""",
    "jn22_overlapping_runs": "WITH s AS (SELECT l_orderkey AS doc_id, l_partkey % 100 AS start, l_partkey % 100 + 15 AS e FROM lineitem), r AS (SELECT l_orderkey AS d, l_linenumber * 20::BIGINT AS r_start, l_linenumber * 20 + l_quantity::BIGINT AS r_end FROM lineitem) SELECT doc_id, start, r_start, r_end FROM s JOIN r ON doc_id = d AND r_start < e AND r_end > start",
    "jn15_fn71_lexicon_hits": f"WITH {SENTS}, t(term, category) AS (VALUES ('stupid', 'again'), ('Thin', 'body'), ('lying', 'act'), ('The', 'words'), ('for the', 'words'), ('THE', 'upper')) SELECT category, term, count(*) AS n FROM sents, t WHERE regexp_matches(sentence, (CASE WHEN term = upper(term) THEN '' ELSE '(?i)' END) || '(^|[^A-Za-z0-9_À-ÿ])' || term || '($|[^A-Za-z0-9_À-ÿ])') GROUP BY category, term",
}
