"""Reference structuring: which paragraphs are references, what each says, and how it is written anew.

Paragraphs between the open and close marks are references, until a heading that names no bibliography or a short label
ends the section. A reference keeps its number; what is left is read by its style, typed, met with the best candidate
of a lookup table and formatted, by that or by what was read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import authoryear as A
from marginalia.functions import fallback as by_rules
from marginalia.functions import formatters
from marginalia.functions.text import settled
from marginalia.operators import flow, matching

# Marks, headings that keep a section open, labels that close it, styles, numbers, links and years.
OPEN, CLOSE = "<ref-open>", "<ref-close>"
KEEPING = "references|bibliography|works cited|literature cited"
LABELS = ["appendix", "tables", "figures", "index"]
STYLES = ["REF-N", "REF-U", "REF"]
NUMBER = r"^(\[?\d+\]?[\.\)]?)\s+"
HEAD_LINK = r"(?i)^.*?https?://doi\.org/10\.\S+"
YEAR = r"\b((?:19|20)\d{2})\b"
APA_LINE = r"^(.+?)\s*\((\d{4})\)\.\s*(.+?)\.\s*([^,\.]+)"


def section_paragraphs(paras: DataFrame) -> DataFrame:
    """The paragraphs (doc_id, para_no, style, text) inside reference sections, marks, blanks and closing lines aside.

    The last mark before a paragraph decides, so a document's paragraphs are gone through once, in a window.
    A heading or label closes only an open section, which a mark of its own carries along.
    """
    text = F.btrim("text", F.lit(" \t\r\n"))
    low = F.lower(text)
    heading = F.coalesce(F.col("style").startswith("Heading"), F.lit(False)) & ~low.rlike(KEEPING)
    ends = heading | (low.isin(LABELS) & (F.length(text) < 40))
    mark = F.when(text.contains(OPEN), 1).when(text.contains(CLOSE) | ends, 0)
    order = W.partitionBy("doc_id").orderBy("para_no")
    inside = F.last("mark", ignorenulls=True).over(order)
    marked = paras.withColumn("text", text).withColumn("mark", mark).withColumn("inside", inside)
    return marked.where("inside = 1 AND mark IS NULL AND text <> ''").select("doc_id", "para_no", "style", "text")


def cleaned(rows: DataFrame) -> DataFrame:
    """`rows` with `ref_style` (given, or by a number in front), `number` and `body`: a leading link and the number taken off."""
    style = F.when(F.col("style").isin(STYLES), F.col("style")).when(F.col("text").rlike(r"^\[?\d+\]?\.?"), "REF-N").when(F.col("text").startswith("REF"), "REF").otherwise("REF-U")
    head = F.regexp_extract(F.substring("text", 1, 150), HEAD_LINK, 0)
    bare = F.when(head != "", F.ltrim(F.btrim(F.substr("text", F.length(head) + 1)), F.lit(".,;)"))).otherwise(F.col("text"))
    rows = rows.withColumn("ref_style", style).withColumn("bare", bare)
    number = F.regexp_extract(F.regexp_extract("bare", NUMBER, 0), r"\d+", 0)
    return rows.withColumn("number", F.nullif(number, F.lit(""))).withColumn("body", F.btrim(F.regexp_replace("bare", NUMBER, ""))).drop("bare")


def _year(line: Column) -> Column:
    return F.nullif(F.regexp_extract(line, YEAR, 1), F.lit(""))


def ama_parts(line: Column) -> Column:
    """struct(authors, title, journal, year) of a reference whose parts end in points and blanks; what is absent is empty."""
    bare = F.regexp_replace(F.btrim(F.regexp_replace(line, r"\s+", " ")), r"^\d+\.\s*", "")
    parts = F.filter(F.transform(F.split(bare, r"\.\s+"), lambda p: F.btrim(p)), lambda p: p != "")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    return F.struct(part(0).alias("authors"), part(1).alias("title"), F.rtrim(part(2), F.lit(". ")).alias("journal"), _year(line).alias("year"))


def apa_parts(line: Column) -> Column:
    """struct(authors, title, journal, year) of `Authors (Year). Title. Journal, ...`, else of what points part."""
    bare = F.btrim(F.regexp_replace(line, r"\s+", " "))
    group = lambda k: F.btrim(F.regexp_extract(bare, APA_LINE, k))
    parts = F.filter(F.transform(F.split(bare, r"\."), lambda p: F.btrim(p)), lambda p: p != "")
    part = lambda k: F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
    named = F.struct(group(1).alias("authors"), group(3).alias("title"), group(4).alias("journal"), group(2).alias("year"))
    return F.when(bare.rlike(APA_LINE), named).otherwise(F.struct(part(0).alias("authors"), part(1).alias("title"), part(2).alias("journal"), _year(bare).alias("year")))


def people(authors: Column) -> Column:
    """array<struct<given, family>> of `Smith J, Jones MK` or `Smith, J., & Jones, M. K.`"""
    comma = F.regexp_extract_all(authors, F.lit(r"([^,&]+,\s*(?:[A-Z]\.[\s-]*)+)"), F.lit(1))
    named = F.transform(comma, lambda a: F.struct(F.btrim(F.split_part(a, F.lit(","), F.lit(2))).alias("given"), F.btrim(F.split_part(a, F.lit(","), F.lit(1))).alias("family")))
    last = lambda a: F.regexp_extract(a, r"^(.*?)\s+([A-Z]{1,3})$", 2)
    spaced = F.transform(
        F.filter(F.transform(F.split(authors, ","), lambda a: F.btrim(a)), lambda a: a != ""),
        lambda a: F.struct(
            F.regexp_replace(last(a), "(.)", "$1. ").alias("given"),
            F.when(last(a) != "", F.regexp_extract(a, r"^(.*?)\s+([A-Z]{1,3})$", 1)).otherwise(a).alias("family"),
        ),
    )
    return F.when(F.size(named) > 0, named).otherwise(spaced)


def single_initials(authors: Column) -> Column:
    """`Smith, J., & Jones, M.`: the first initial of each author only; none: Unknown authors."""
    name = lambda a: F.btrim(F.concat(F.coalesce(a["family"], F.lit("")), F.lit(", "), F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat(F.substring(a["given"], 1, 1), F.lit("."))).otherwise("")))
    n = F.size(authors)
    each = F.transform(authors, lambda a, i: F.concat(F.when((i == n - 1) & (n > 1), "& ").otherwise(""), name(a)))
    return F.when(F.coalesce(n, F.lit(0)) <= 0, "Unknown authors").otherwise(F.array_join(each, ", "))


def from_pubmed(item: Column) -> Column:
    """A PubMed record in the shape of the other source's: the short journal name in an array, no DOI as null."""
    short = F.when(F.coalesce(item["iso_abbrev"], F.lit("")) != "", F.array(item["iso_abbrev"])).otherwise(F.array().cast("array<string>"))
    text = lambda n: F.coalesce(item[n], F.lit("")).alias(n)
    return F.struct(item["author"].alias("author"), item["title"].alias("title"), short.alias("short_container_title"), text("volume"), text("issue"), text("page"), F.nullif(item["doi"], F.lit("")).alias("doi"))


def numbered(number: Column, text: Column) -> Column:
    """A formatted reference with its number, a point and a tab before it, if it had one."""
    return F.when(number.isNotNull(), F.concat(number, F.lit(".\t"), text)).otherwise(text)


def fallback(parts: Column, kind: Column, body: Column) -> Column:
    """What a reference without an accepted candidate becomes: authors (year). title. journal, with clean points and blanks.

    A web page ends with its address. What could not be read at all stays as it was.
    """
    link = F.regexp_extract(body, r"https?://\S+|www\.\S+", 0)
    year = F.concat(F.lit("("), F.coalesce(parts["year"], F.lit("n.d.")), F.lit(")"))
    piece = lambda c: F.nullif(F.regexp_replace(F.btrim(c), r"[.,;:\s]+$", ""), F.lit(""))
    whole = F.concat_ws(". ", F.concat_ws(" ", piece(parts["authors"]), year), piece(parts["title"]), piece(parts["journal"]))
    out = F.concat(whole, F.lit("."), F.when((kind == "web") & (link != ""), F.concat(F.lit(" "), F.rtrim(link, F.lit(".,;")))).otherwise(""))
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"\.{2,}", "."), r"\s+([.,;:])", "$1")
    return F.when(piece(parts["title"]).isNull(), body).otherwise(F.btrim(out))


def structured(paras: DataFrame, lookup: DataFrame, style: str = "apa") -> DataFrame:
    """(doc_id, para_no, ref_style, number, kind, source, formatted) for each reference of the paragraphs.

    `lookup` (title, item) stands for what a search gives: the candidate of a reference is the item of its title, compared
    in lower case without signs, an equi-join. An article or book that has one is formatted by it, others by what was read.
    """
    read = {"apa": apa_parts, "ama": ama_parts}[style]
    write = {"apa": formatters.apa, "ama": formatters.ama}[style]
    key = lambda c: F.btrim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    rows = cleaned(section_paragraphs(paras)).withColumn("parts", read(F.col("body"))).withColumn("kind", A.reference_type(F.col("body")))
    known = lookup.select(key(F.col("title")).alias("key"), "item").where("key <> ''").groupBy("key").agg(F.min_by("item", F.to_json("item")).alias("item"))
    met = rows.withColumn("key", key(F.col("parts.title"))).join(known, "key", "left")
    use = F.col("item").isNotNull() & F.coalesce(F.col("kind"), F.lit("article")).isin("article", "book")
    text = F.when(use, formatters.plain(write(F.col("item")))).otherwise(fallback(F.col("parts"), F.col("kind"), F.col("body")))
    return met.select("doc_id", "para_no", "ref_style", "number", F.coalesce("kind", F.lit("article")).alias("kind"), F.when(use, "lookup").otherwise("text").alias("source"), numbered(F.col("number"), text).alias("formatted"))


def enriched(paras: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, para_no, ref_style, number, kind, outcome, score, formatted): each reference by its best candidate, or by what it says.

    `candidates` (query, source, cand_no, title, doi, item) is what searches gave for a title; cand_no tells those of a query and source
    apart. Numbered references are read and written in the one style, others in the other. Each title is asked for once, however many
    references have it, and only titles of references are scored. A candidate is taken by its score, DOI, title and first three authors;
    a reference with an address asks for a score of 0.9. outcome: lookup, rejected, no match, or the kind that asks for no candidate
    (book, edited_book, thesis, web); all but the first are formatted by the rule table. Null texts are no references.
    """
    numbered_style = F.col("ref_style") == "REF-N"
    parts = F.when(numbered_style, ama_parts(F.col("body"))).otherwise(apa_parts(F.col("body")))
    keep = ["doc_id", "para_no", "ref_style", "number", "body"]
    rows = settled(cleaned(section_paragraphs(paras)), keep[:2], **{n: F.col(n) for n in keep[2:]})
    rows = settled(rows, keep, parts=parts, kind=A.reference_type(F.col("body")))
    rows = settled(rows, [*keep, "parts", "kind"], query=matching.plain_title(F.col("parts.title")))
    asked = candidates.withColumn("query", matching.plain_title(F.col("query"))).where("query <> ''")
    wanted = asked.join(rows.where("kind IS NULL").select("query").distinct(), "query", "left_semi")
    best = matching.best_candidate(wanted)
    one = wanted.groupBy("query", "source", "cand_no").agg(F.min_by(F.struct("title", "doi", "item"), F.to_json(F.struct("title", "doi", "item"))).alias("c"))
    won = best.join(one, ["query", "source", "cand_no"]).select("query", "score", "c.*")
    met = rows.join(won, "query", "left").withColumn("likeness", matching.alike(F.col("parts.title"), F.col("title")))
    family = lambda a: F.lower(F.coalesce(a["family"], F.lit("")))
    fits = F.coalesce(F.exists(F.slice("item.author", 1, 3), lambda a: (family(a) != "") & F.contains(F.lower("parts.authors"), family(a))), F.lit(False))
    has_doi = F.btrim(F.coalesce("doi", F.lit(""))) != ""
    unsure = F.col("body").rlike(r"https?://") & (F.col("score") < flow.SCORE_SURE)
    enough = F.col("score") >= F.when(has_doi, flow.LEAST_WITH_DOI).otherwise(flow.LEAST_WITHOUT)
    taken = flow.accepted(F.col("score"), has_doi, F.col("likeness"), fits)
    outcome = F.when(F.col("kind").isNotNull(), F.col("kind")).when(F.col("item").isNull() | unsure | ~enough, "no match").when(taken, "lookup").otherwise("rejected")
    met = settled(met, [*keep, "kind", "score", "item"], outcome=outcome)
    found = F.when(numbered_style, formatters.plain(formatters.ama(F.col("item")))).otherwise(formatters.plain(formatters.apa(F.col("item"))))
    read = F.when(numbered_style, by_rules.segments(F.col("body"), F.col("kind"), "ama")).otherwise(by_rules.segments(F.col("body"), F.col("kind"), "apa"))
    text = F.when(F.col("outcome") == "lookup", found).otherwise(formatters.plain(read))
    return met.select("doc_id", "para_no", "ref_style", "number", F.coalesce("kind", F.lit("article")).alias("kind"), "outcome", F.when(F.col("kind").isNull(), F.col("score")).alias("score"), numbered(F.col("number"), text).alias("formatted"))


def bibliography_ids(runs: DataFrame) -> DataFrame:
    """(doc_id, para_no, ref_id, run_no): paragraphs in a numbered reference style with their id: the first number of a
    bib_number run, else what the paragraph begins with; a paragraph without a number is left out (run_no null if from the text)."""
    digits = F.nullif(F.regexp_extract("text", r"(\d+)", 1), F.lit(""))
    own = F.when(F.col("style") == "bib_number", digits)
    first = F.min_by(F.struct(own.alias("id"), "run_no"), F.when(own.isNotNull(), F.col("run_no")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "text"))), lambda r: r["text"]), "")
    each = runs.where(F.col("para_style").rlike(r"^REF-N")).groupBy("doc_id", "para_no").agg(first.alias("first"), line.alias("line"))
    lead = F.nullif(F.regexp_extract(F.ltrim("line"), r"^\[?(\d+)", 1), F.lit(""))
    ref_id = F.coalesce("first.id", lead).try_cast("long")
    return each.select("doc_id", "para_no", ref_id.alias("ref_id"), F.when(F.col("first.id").isNotNull(), F.col("first.run_no")).alias("run_no")).where("ref_id IS NOT NULL")
