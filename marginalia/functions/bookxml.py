"""Tagged book text as XML pieces: chapter data, lists, references and dates, as chains of column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tags of lists and what they become, tags of references and what they become.
LIST_TYPES = {"OL": "order", "AL": "lower-alpha", "AU": "upper-alpha", "RL": "lower-roman", "RU": "upper-roman", "BL": "bullet", "UL": "none"}
BIB_TAGS = {
    "biborganization": "collab", "bibsurname": "surname", "bibfname": "given-names", "bibchaptertitle": "chapter-title", "bibtitle": "source",
    "bibarticle": "article-title", "bibjournal": "source", "bibpublisher": "publisher-name", "bibvolume": "volume", "bibissue": "issue",
    "bibfpage": "fpage", "biblpage": "lpage",
}
DEEPEST_LIST = 6


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """`text` after each (pattern, replacement), in any case and across lines."""
    return reduce(lambda t, r: F.regexp_replace(t, f"(?is){r[0]}", r[1]), rules, text)


def paragraph_of(html: Column, name: str, group: str = r"(.*?)") -> Column:
    """The content of the first paragraph of a class, without bold marks around it; null if there is none."""
    pattern = rf'(?is)<p class="{name}">\s*(?:<strong>)?\s*{group}\s*(?:</strong>)?\s*</p>'
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def chapter_data(html: Column) -> Column:
    """struct(label, number, title, authors, abstract, keywords) of a chapter's page; absent ones are null or empty."""
    label = paragraph_of(html, "ChapterNumber", r"(Chapter [0-9]+)")
    names = F.regexp_replace(F.coalesce(paragraph_of(html, "ChapterAuthor"), F.lit("")), r"<[^>]*>", "")
    authors = F.filter(F.transform(F.split(names, r"\s+and\s+|\s*,\s*"), lambda a: F.btrim(a)), lambda a: a != "")
    after = lambda heading: F.nullif(F.regexp_extract(html, rf'(?is)<p class="[^"]*">\s*(?:<strong>)*{heading}(?:</strong>)*\s*</p>\s*<p class="[^"]*">(.*?)</p>', 1), F.lit(""))
    words = F.coalesce(after("Keywords?"), F.lit(""))
    keywords = F.filter(F.transform(F.split(words, F.when(words.contains(","), ",").otherwise(";")), lambda k: F.btrim(k)), lambda k: k != "")
    person = lambda a: F.struct(F.regexp_extract(a, r"^(?:(.+) )?(\S+)$", 2).alias("surname"), F.regexp_extract(a, r"^(?:(.+) )?(\S+)$", 1).alias("given"))
    return F.struct(
        label.alias("label"), F.nullif(F.regexp_extract(F.coalesce(label, F.lit("")), r"(\d+)", 1), F.lit("")).alias("number"), paragraph_of(html, "ChapterTitle").alias("title"),
        F.transform(authors, person).alias("authors"), after("Abstract").alias("abstract"), keywords.alias("keywords"),
    )


def nested_lists(text: Column) -> Column:
    """List items tagged by type and level (<OL1>..</OL1><BL2>..</BL2>) as nested lists.

    From the deepest level up, a list that follows one of the level above moves into it; neighbours of a tag are items of one list.
    """
    tags = "|".join(LIST_TYPES)
    for level in range(DEEPEST_LIST - 1, 0, -1):
        inner = rf"((?:\n*<(?:{tags}){level + 1}>.*?</(?:{tags}){level + 1}>)+)"
        text = F.regexp_replace(text, rf"(?s)</({tags}){level}>{inner}", f"$2</$1{level}>")
    text = F.regexp_replace(text, rf"(?s)</({tags})([0-9])>\s*<\1\2>", "</list-item><list-item>")
    text = F.regexp_replace(text, rf"</({tags})[0-9]>", "</list-item></list>")
    for tag, kind in LIST_TYPES.items():
        text = F.regexp_replace(text, f"<{tag}[0-9]>", f'<list list-type="{kind}"><list-item>')
    return text


def date_tags(text: Column) -> Column:
    """Months, days and years of a date in tags: letters are months, four digits years with their letter, other digits days."""
    split = r"(?i)([0-9]{4}[a-z]?(?![a-z0-9])|[0-9]+|[a-z]{2,}|[^0-9a-z]+|[a-z])"
    parts = F.regexp_extract_all(text, F.lit(split), F.lit(1))
    tagged = lambda x, n: F.concat(F.lit(f"<{n}>"), x, F.lit(f"</{n}>"))
    each = F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9]{4}[A-Za-z]?$"), tagged(x, "year")).when(x.rlike("^[0-9]+$"), tagged(x, "day")).when(x.rlike("^[A-Za-z]{2,}$"), tagged(x, "month")).otherwise(x))
    return F.array_join(each, "")


def publication_type(text: Column) -> Column:
    """web, article, book or other, by the first kind whose tags occur."""
    return (
        F.when(text.rlike("(?i)</ext-link>"), "web")
        .when(text.rlike("(?i)</issue>|</article-title>"), "article")
        .when(text.rlike("(?i)</chapter-title>|</publisher-name>|</publisher-loc>"), "book")
        .otherwise("other")
    )


def tagged_reference(text: Column, ref_id: Column) -> Column:
    """A reference paragraph with bib tags as a ref element: tags renamed, dates tagged, typed."""
    year = F.regexp_extract(text, r"(?is)<bibyear>(.*?)</bibyear>", 1)
    out = F.replace(text, F.concat(F.lit("<bibyear>"), year, F.lit("</bibyear>")), date_tags(year))
    out = rewritten(out, [(f"<(/?){old}>", f"<$1{new}>") for old, new in BIB_TAGS.items()])
    out = rewritten(out, [(r"<volume><italic>(.*?)</italic></volume>", "<volume>$1</volume>")])
    out = rewritten(out, [(rf"<bib{k}>(.*?)</bib{k}>", f'<ext-link ext-link-type="{t}" xlink:href="$1">$1</ext-link>') for k, t in (("url", "uri"), ("doi", "doi"))])
    bare = rewritten(out, [(r"^<p class=\"[^\"]*\">", ""), (r"</p>$", "")])
    return F.concat(F.lit('<ref id="'), ref_id, F.lit('"><mixed-citation publication-type="'), publication_type(out), F.lit('">'), bare, F.lit("</mixed-citation></ref>"))


def schemed(href: Column) -> Column:
    """An address with a scheme; one without gets http, a mailbox mailto."""
    return F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), href).when(href.rlike(r"^[^\s/@]+@[^\s/@]+$"), F.concat(F.lit("mailto:"), href)).otherwise(F.concat(F.lit("http://"), href))


def renamed_classes(html: Column, names: dict[str, str]) -> Column:
    """Paragraph classes renamed, each as a whole name."""
    return rewritten(html, [(f'class="{old}"', f'class="{new}"') for old, new in names.items()])


# Marks of a run with the tags they become, from the outside in; a character style stands after the second.
RUN_TAGS = [("smallcaps", "smallcaps"), ("struck", "strikethrough"), ("style", None), ("superscript", "sup"), ("subscript", "sub"), ("bold", "strong"), ("italic", "em"), ("underlined", "u")]


def run_html(run: Column) -> Column:
    """A run (a struct of text, style and marks) as HTML: its text escaped, then a tag for each mark that is on."""
    out = F.coalesce(run["text"], F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    for mark, tag in reversed(RUN_TAGS):
        name = run["style"] if tag is None else F.lit(tag)
        on = F.coalesce(name, F.lit("")) != "" if tag is None else F.coalesce(run[mark], F.lit(False))
        out = F.concat(F.when(on, F.concat(F.lit("<"), name, F.lit(">"))).otherwise(""), out, F.when(on, F.concat(F.lit("</"), name, F.lit(">"))).otherwise(""))
    return out


def paragraph_html(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): runs (keys, run_no, para_style, text, style and marks) as paragraphs of their style's class."""
    run = F.struct(*[F.col(c) for c in ("text", "style", *[m for m, tag in RUN_TAGS if tag])])
    each = runs.select(*keys, "run_no", "para_style", run_html(run).alias("html"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_no", "html"))), lambda r: r["html"]), "")
    return each.groupBy(*keys).agg(F.concat(F.lit('<p class="'), F.min("para_style"), F.lit('">'), line, F.lit("</p>")).alias("html"))


def table_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, html): cells (keys, row_no, col_no, html, colspan, align, merge) as tables.

    A cell that starts a vertical merge (`restart`) spans the rows below whose cell of its column goes on (`continue`),
    up to the first that does not; those that go on are left out.
    """
    column = W.partitionBy(*keys, "col_no").orderBy("row_no")
    group = F.count_if(F.coalesce(F.col("merge") != "continue", F.lit(True))).over(column.rowsBetween(W.unboundedPreceding, 0))
    grouped = cells.withColumn("group", group)
    spans = grouped.withColumn("rowspan", F.count("*").over(W.partitionBy(*keys, "col_no", "group")))
    own = spans.where("merge IS NULL OR merge <> 'continue'")
    mark = lambda name, c: F.when(c > 1, F.concat(F.lit(f' {name}="'), c, F.lit('"'))).otherwise("")
    align = F.when(F.coalesce("align", F.lit("")) != "", F.concat(F.lit(' align="'), "align", F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("<td"), mark("colspan", F.coalesce("colspan", F.lit(1))), mark("rowspan", F.col("rowspan")), align, F.lit(">"), "html", F.lit("</td>"))
    joined = lambda order, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(c).alias("x")))), lambda r: r["x"]), "")
    rows = own.withColumn("cell", cell).groupBy(*keys, "row_no").agg(F.concat(F.lit("<tr>"), joined("col_no", "cell"), F.lit("</tr>")).alias("line"))
    return rows.groupBy(*keys).agg(F.concat(F.lit("<table>"), joined("row_no", "line"), F.lit("</table>")).alias("html"))
