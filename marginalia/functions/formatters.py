"""Bibliographic items as styled segments in APA, AMA and Chicago style.

An item is a struct of type, author (array of given and family), title, container, volume, issue, page,
publisher, doi, url and year. A citation is an array of struct(text, style); a null text is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.authoryear import initials

ITEM = "type string, author array<struct<given:string,family:string>>, title string, container string, volume string, issue string, page string, publisher string, doi string, url string, year string"


def seg(text: Column | str, style: str | None = None) -> Column:
    return F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(style).cast("string").alias("style"))


def joined(*parts: Column) -> Column:
    """Segments in order, those without text left out."""
    return F.filter(F.array(*parts), lambda s: F.coalesce(s["text"], F.lit("")) != "")


def given_with(before: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(before), text))


def people(authors: Column, name, between) -> Column:
    """Segments of each author after the first with what stands between; none: unknown authors."""
    each = F.flatten(F.transform(authors, lambda a, i: F.concat(F.when(i > 0, F.array(seg(between(i)))).otherwise(F.array().cast("array<struct<text:string,style:string>>")), name(a, i))))
    return F.when(F.coalesce(F.size(authors), F.lit(0)) <= 0, F.array(seg("Unknown authors", "bib_unpubl"))).otherwise(each)


def apa(item: Column) -> Column:
    """All authors up to 20, else 19, an ellipsis and the last; initials with stops; year in parentheses."""
    authors, n = item["author"], F.size(item["author"])
    shown = F.when(n <= 20, authors).otherwise(F.concat(F.slice(authors, 1, 19), F.slice(authors, -1, 1)))
    name = lambda a, i: joined(seg(a["family"], "bib_surname"), seg(given_with(", ", F.when(F.size(initials(a["given"])) > 0, F.concat(F.array_join(initials(a["given"]), ". "), F.lit(".")))), "bib_fname"))
    between = lambda i: F.when((n > 20) & (i == 19), ", ... ").when((i == n - 1) & (n <= 20), ", & ").otherwise(", ")
    year = F.coalesce(item["year"], F.lit("n.d."))
    mark = lambda before, text: seg(F.when(F.coalesce(text, F.lit("")) != "", before))
    place = joined(mark(" ", item["container"]), seg(item["container"], "bib_journal"), mark(", ", item["volume"]), seg(item["volume"], "bib_volume"), seg(F.when(F.coalesce(item["issue"], F.lit("")) != "", F.concat(F.lit("("), item["issue"], F.lit(")")))), seg(given_with(", ", item["page"]), "bib_page"), seg("."))
    book = joined(seg(given_with(" ", item["publisher"]), "bib_publisher"), seg("."))
    end = joined(seg(F.coalesce(given_with(" https://doi.org/", item["doi"]), given_with(" ", item["url"])), "bib_doi"))
    title = F.coalesce(item["title"], F.lit("No title available"))
    return F.concat(people(shown, name, between), joined(seg(" ("), seg(year, "bib_year"), seg("). ")), joined(seg(title, "bib_title"), seg(".")), F.when(item["type"] == "book", book).otherwise(place), end)


def ama(item: Column) -> Column:
    """All authors up to 6, else 3 and et al; initials without stops; year;volume(issue):pages."""
    authors, n = item["author"], F.size(item["author"])
    shown = F.when(n <= 6, authors).otherwise(F.slice(authors, 1, 3))
    name = lambda a, i: joined(seg(F.btrim(a["family"]), "bib_surname"), seg(given_with(" ", F.array_join(initials(a["given"]), "")), "bib_fname"))
    who = F.concat(people(shown, name, lambda i: F.lit(", ")), F.when(n > 6, F.array(seg(", et al", "bib_etal"))).otherwise(F.array().cast("array<struct<text:string,style:string>>")))
    title = F.coalesce(item["title"], F.lit("No title available"))
    place = joined(seg(item["container"], "bib_journal"), seg(". "), seg(F.coalesce(item["year"], F.lit("n.d")), "bib_year"), seg(given_with(";", item["volume"]), "bib_volume"), seg(F.when(F.coalesce(item["issue"], F.lit("")) != "", F.concat(F.lit("("), item["issue"], F.lit(")")))), seg(given_with(":", item["page"]), "bib_page"), seg("."))
    book = joined(seg(item["publisher"], "bib_publisher"), seg("; "), seg(F.coalesce(item["year"], F.lit("n.d")), "bib_year"), seg("."))
    return F.concat(who, joined(seg(". "), seg(title, "bib_title"), seg(". ")), F.when(item["type"] == "book", book).otherwise(place), joined(seg(given_with(" doi:", item["doi"]), "bib_doi")))


def chicago(item: Column) -> Column:
    """First author inverted, ten at most, and before the last; publisher and year last for books."""
    authors, n = item["author"], F.size(item["author"])
    name = lambda a, i: F.when(i == 0, joined(seg(F.btrim(a["family"]), "bib_surname"), seg(given_with(", ", F.btrim(a["given"])), "bib_fname"))).otherwise(joined(seg(F.btrim(a["given"]), "bib_fname"), seg(" "), seg(F.btrim(a["family"]), "bib_surname")))
    between = lambda i: F.when((i == n - 1) & (n <= 10), ", and ").otherwise(", ")
    who = F.concat(people(F.slice(authors, 1, 10), name, between), F.when(n > 10, F.array(seg(", et al", "bib_etal"))).otherwise(F.array().cast("array<struct<text:string,style:string>>")))
    title, year = F.coalesce(item["title"], F.lit("No title available")), F.coalesce(item["year"], F.lit("n.d."))
    book = joined(seg(title, "bib_book"), seg(". "), seg(item["publisher"], "bib_publisher"), seg(", "), seg(year, "bib_year"), seg("."))
    article = joined(seg('"'), seg(title, "bib_title"), seg('." '), seg(item["container"], "bib_journal"), seg(given_with(" ", item["volume"]), "bib_volume"), seg(given_with(", no. ", item["issue"]), "bib_issue"), seg(" ("), seg(year, "bib_year"), seg(")"), seg(given_with(": ", item["page"]), "bib_page"), seg("."))
    return F.concat(who, joined(seg(". ")), F.when(item["type"] == "book", book).otherwise(article), joined(seg(given_with(" https://doi.org/", item["doi"]), "bib_doi")))


def plain(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def html(segments: Column) -> Column:
    """Segments as HTML, titles, journals and volumes in italics."""
    italic = ("bib_book", "bib_journal", "bib_volume")
    return F.array_join(F.transform(segments, lambda s: F.when(s["style"].isin(*italic), F.concat(F.lit("<i>"), s["text"], F.lit("</i>"))).otherwise(s["text"])), "")


def missing_elements(item: Column) -> Column:
    """What an item of its type lacks."""
    no = lambda c: F.coalesce(item[c], F.lit("")) == ""
    book, kind = item["type"].isin("book", "edited_book"), item["type"]
    return F.array_compact(
        F.array(
            F.when(book & no("publisher") & no("url") & no("doi"), "Publisher missing"), F.when(book & no("year"), "Year missing"), F.when(book & (F.coalesce(F.size(item["author"]), F.lit(0)) <= 0), "Author/Editor missing"),
            F.when((kind == "web") & no("url"), "URL missing"), F.when((kind == "thesis") & no("publisher"), "Institution missing"),
        )
    )
