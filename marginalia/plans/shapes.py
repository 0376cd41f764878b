"""References that no look-up knows, by shape: books, chapters, theses, pages and articles read by the rule table, as styled segments; and whole
bibliographies by scored candidates, with the rule table for what has none.

References are built from parts in seven shapes of each style; the twins list what they were built of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import fallback
from marginalia.operators import structuring
from marginalia.plans.sqlquery import run_sql, twin
from marginalia.plans.styles import PARTS
from marginalia.sources.tables import dealt

AMA_LINES = f"""SELECT para_no, element_at(array('book', 'edited_book', 'thesis', 'web', 'article', 'article', 'book'), cast(k + 1 AS int)) AS kind, CASE k
  WHEN 0 THEN concat(a, ' J, ', b, ' MK. ', p_name, '. 3rd ed.  Town, ST: Press of ', c, '; ', y, '.')
  WHEN 1 THEN concat(a, ' J. ', p_name, '. In: ', b, ' J, ', c, ' T, eds. ', p_brand, ' at large. Town: Press; ', y, ':11-19.')
  WHEN 2 THEN concat(a, ' J. ', p_name, '. University of ', b, '. ', y)
  WHEN 3 THEN concat('Office of ', a, '. ', p_name, '. Published ', y, '. https://example.org/', para_no, '.')
  WHEN 4 THEN concat(a, ' J, ', b, ' MK.  ', p_name, '. Annals of ', c, '. ', y, ';12(3):45-67.')
  WHEN 5 THEN concat(a, ' J. ', p_name, '. Annals of ', c, ' ', y, '. http://example.org/', para_no)
  ELSE concat(a, ' J. ', p_name, ' 2nd ed. Town: Press; ', y, '.') END AS line FROM ({PARTS})"""

APA_LINES = f"""SELECT para_no, element_at(array('book', 'edited_book', 'thesis', 'web', 'article', 'thesis', 'edited_book'), cast(k + 1 AS int)) AS kind, CASE k
  WHEN 0 THEN concat(a, ', J. K., & ', b, ', M. (', y, '). ', p_name, ' (2nd ed.). Press of ', c, '.')
  WHEN 1 THEN concat(a, ', J. (', y, '). ', p_name, '. In B. ', b, ', & C. ', c, ' (Eds.), ', p_brand, ' at large (pp. 11-19). Press.')
  WHEN 2 THEN concat(a, ', J. (n.d.). ', p_name, '. University of ', b, '.')
  WHEN 3 THEN concat('Office of ', a, '. (', y, ', October 16). ', p_name, '. https://example.org/', para_no, '.')
  WHEN 4 THEN concat(a, ', J., & ', b, ', M. (', y, '). ', p_name, '. Annals of ', c, ', 12(3), 45-67.')
  WHEN 5 THEN concat(a, ', J. (', y, '). ', p_name, '. Annals of ', c, ', 12(3).')
  ELSE concat(a, ', J. (', y, '). ', p_name, '. In B. ', b, ' (Eds.), ', p_brand, ' at large. Press of ', c, '.') END AS line FROM ({PARTS})"""


def segments(lines: str, style: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = dealt(run_sql(spark, d, lines), "para_no").select("para_no", fallback.segments(F.col("line"), F.col("kind"), style).alias("s"))
        styled = F.transform(F.filter("s", lambda s: s["style"].isNotNull()), lambda s: F.concat(F.replace(s["style"], F.lit("bib_"), F.lit("")), F.lit(":"), s["text"]))
        return found.select("para_no", F.array_join(styled, "|").alias("segments"), F.array_join(F.transform("s", lambda s: s["text"]), "").alias("text"))

    return run


def listed(shapes: list[tuple[str, str]]) -> str:
    """The twin: segments and text of each shape, with {names} for what it was built of."""

    def built(shape: str) -> str:
        for name in ("a", "b", "c", "y", "p_name", "p_brand", "para_no"):
            shape = shape.replace("{" + name + "}", f"' || {name} || '")
        return f"'{shape}'"

    cases = lambda i: "CASE k " + " ".join(f"WHEN {k} THEN {built(s[i])}" for k, s in enumerate(shapes)) + " END"
    return f"SELECT para_no, {cases(0)} AS segments, {cases(1)} AS text FROM ({twin(PARTS)})"


#: References to one section of each document, numbered ones in their own style.
BIBLIOGRAPHY = f"""SELECT DISTINCT doc_id, 0L AS para_no, 'Normal' AS style, '<ref-open>' AS text FROM ({PARTS}) UNION ALL
SELECT doc_id, para_no, CASE k WHEN 6 THEN 'REF-N' ELSE 'REF-U' END AS style, CASE k
  WHEN 3 THEN concat(a, ', J. (', y, '). ', p_name, ' (2nd ed.). New York: Springer.')
  WHEN 6 THEN concat(z, '. ', a, ' J. ', p_name, '. Annals of ', c, '. ', y, ';3:1-9.')
  ELSE concat(a, ', J. (', y, '). ', p_name, '. Annals of ', c, ', 3.') END AS text FROM ({PARTS})"""

#: What a search gave for a title, by its length: itself, a longer title, a third or two thirds of it, nothing.
FOUND = """SELECT upper(p_name) AS query, source, 1 AS cand_no, title, doi, named_struct('type', 'journal-article',
  'author', transform(array('Smith', 'Jones', 'Brown', 'Garcia'), f -> named_struct('given', 'Ann', 'family', f)), 'title', title, 'container', 'Found Journal', 'volume', '9', 'issue', '1',
  'page', '1-2', 'publisher', cast(NULL AS string), 'doi', doi, 'url', cast(NULL AS string), 'year', '1999') AS item
FROM (SELECT DISTINCT p_name, CASE WHEN length(p_name) % 5 = 1 THEN 'pubmed' ELSE 'crossref' END AS source, CASE WHEN length(p_name) % 5 = 1 THEN '' ELSE '10.1/x' END AS doi,
  trim(CASE length(p_name) % 5 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' again') WHEN 2 THEN substring(p_name, 1, length(p_name) div 3) ELSE substring(p_name, 1, length(p_name) * 2 div 3) END) AS title
FROM {part} WHERE length(p_name) % 5 < 4)"""


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return structuring.enriched(run_sql(spark, d, BIBLIOGRAPHY), run_sql(spark, d, FOUND))


#: The twin of it: scores by lengths, acceptance by score, title and name.
ENRICHED = f"""WITH f AS (SELECT *, CASE len(p_name) % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' again' WHEN 2 THEN trim(substring(p_name, 1, len(p_name) // 3)) WHEN 3 THEN trim(substring(p_name, 1, len(p_name) * 2 // 3)) END AS title,
  len(p_name) % 5 <> 1 AS has_doi, a IN ('Smith', 'Jones', 'Brown') AS known FROM ({twin(PARTS)})),
s AS (SELECT *, 2::DOUBLE * least(len(title), len(p_name)) / (len(title) + len(p_name)) AS sim FROM f), t AS (SELECT *, sim + CASE WHEN has_doi THEN 0.06::DOUBLE ELSE 0::DOUBLE END AS sc FROM s),
o AS (SELECT *, CASE WHEN k = 3 THEN 'book' WHEN title IS NULL OR sc < CASE WHEN has_doi THEN 0.6 ELSE 0.75 END THEN 'no match' WHEN sim >= 0.4 AND (known OR (sim >= 0.8 AND sc >= 0.9)) THEN 'lookup' ELSE 'rejected' END AS outcome FROM t)
SELECT doc_id, para_no, CASE k WHEN 6 THEN 'REF-N' ELSE 'REF-U' END AS ref_style, CASE k WHEN 6 THEN z END AS number, CASE k WHEN 3 THEN 'book' ELSE 'article' END AS kind, outcome, CASE WHEN k <> 3 AND sc >= 0.6 THEN round(sc, 6) END AS score,
CASE WHEN outcome = 'lookup' AND k = 6 THEN z || '.' || chr(9) || 'Smith A, Jones A, Brown A, Garcia A. ' || title || '. Found Journal. 1999;9(1):1-2.' || CASE WHEN has_doi THEN ' doi:10.1/x' ELSE '' END
WHEN outcome = 'lookup' THEN 'Smith, A., Jones, A., Brown, A., & Garcia, A. (1999). ' || title || '. Found Journal, 9(1), 1-2.' || CASE WHEN has_doi THEN ' https://doi.org/10.1/x' ELSE '' END
WHEN k = 3 THEN a || ', J. (' || y || '). ' || p_name || ' (2nd ed.). New York: Springer.' WHEN k = 6 THEN z || '.' || chr(9) || a || ' J. ' || p_name || '. Annals of ' || c || '. ' || y || ';3:1-9.'
ELSE a || ', J. (' || y || '). ' || p_name || '. Annals of ' || c || ', 3.' END AS formatted FROM o"""

QUERIES = {"fn53_ama_shapes": segments(AMA_LINES, "ama"), "fn53_apa_shapes": segments(APA_LINES, "apa"), "pipe04_scored_references": enriched}
ORACLES = {
    "pipe04_scored_references": ENRICHED,
    "fn53_ama_shapes": listed([
        ("surname:{a}|fname:J|surname:{b}|fname:MK|book:{p_name}|editionno:3rd ed.|location:Town, ST|publisher:Press of {c}|year:{y}", "{a} J, {b} MK. {p_name}. 3rd ed. Town, ST: Press of {c}; {y}."),
        ("surname:{a}|fname:J|chaptertitle:{p_name}|ed-surname:{b}|ed-fname:J|ed-surname:{c}|ed-fname:T|book:{p_brand} at large|location:Town|publisher:Press|year:{y}|fpage:11|lpage:19", "{a} J. {p_name}. In: {b} J, {c} T, eds. {p_brand} at large. Town: Press; {y}:11-19."),
        ("surname:{a}|fname:J|title:{p_name}|publisher:University of {b}|year:{y}", "{a} J. {p_name}. University of {b}; {y}."),
        ("surname:Office of {a}|title:{p_name}|year:{y}|url:https://example.org/{para_no}", "Office of {a}. {p_name}. {y}. https://example.org/{para_no}"),
        ("surname:{a}|fname:J|surname:{b}|fname:MK|article:{p_name}|journal:Annals of {c}|year:{y}|volume:12|issue:3|fpage:45|lpage:67", "{a} J, {b} MK. {p_name}. Annals of {c}. {y};12(3):45-67."),
        ("surname:{a}|fname:J|article:{p_name}|journal:Annals of {c}|year:{y}|url:http://example.org/{para_no}", "{a} J. {p_name}. Annals of {c}; {y}. http://example.org/{para_no}"),
        ("surname:{a}|fname:J|book:{p_name}|editionno:2nd ed|location:Town|publisher:Press|year:{y}", "{a} J. {p_name}. 2nd ed. Town: Press; {y}."),
    ]),
    "fn53_apa_shapes": listed([
        ("surname:{a}|fname:J. K.|surname:{b}|fname:M.|year:{y}|book:{p_name}|editionno:2nd ed.|publisher:Press of {c}", "{a}, J. K., & {b}, M. ({y}). {p_name} (2nd ed.). Press of {c}."),
        ("surname:{a}|fname:J.|year:{y}|chaptertitle:{p_name}|ed-fname:B.|ed-surname:{b}|ed-fname:C.|ed-surname:{c}|book:{p_brand} at large|fpage:11|lpage:19|publisher:Press", "{a}, J. ({y}). {p_name}. In B. {b}, & C. {c} (Eds.), {p_brand} at large (pp. 11-19). Press."),
        ("surname:{a}|fname:J.|year:n.d.|book:{p_name}|publisher:University of {b}", "{a}, J. (n.d.). {p_name}. University of {b}."),
        ("surname:Office of {a}.|year:{y}|month:October|day:16|title:{p_name}|url:https://example.org/{para_no}", "Office of {a}. ({y}, October 16). {p_name}. https://example.org/{para_no}"),
        ("surname:{a}|fname:J.|surname:{b}|fname:M.|year:{y}|book:{p_name}|publisher:Annals of {c}, 12(3), 45-67", "{a}, J., & {b}, M. ({y}). {p_name}. Annals of {c}, 12(3), 45-67."),
        ("surname:{a}|fname:J.|year:{y}|article:{p_name}|journal:Annals of {c}, 12(3)", "{a}, J. ({y}). {p_name}. Annals of {c}, 12(3)."),
        ("surname:{a}|fname:J.|year:{y}|chaptertitle:{p_name}|ed-fname:B.|ed-surname:{b}|book:{p_brand} at large|publisher:Press of {c}", "{a}, J. ({y}). {p_name}. In B. {b} (Eds.), {p_brand} at large. Press of {c}."),
    ]),
}
