"""Credits in a paragraph, and whether an item needs permission."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What begins a credit, where an editor's remark ends it, and what tells of a foreign source.
CREDIT_STARTS = [
    r"sources?[\.\s:]*", r"adapted\s+from", r"modified\s+from", r"reprinted\s+from", r"reproduced\s+from", r"with\s+permission",
    r"published\s+with\s+permission", r"copyright", "©", r"courtesy\s+of", r"images?\s+courtesy", r"photo\s+credit", r"illustration\s+by",
    r"illustrated\s+by", "shutterstock", "getty", r"retrieved\s+from", r"accessed\s+from", "https?://", r"doi\.org/",
]
REMARK = r"(?i)(?:please advise|either redraw|if using the original)"
RISKS = [
    r"adapted\s+from", r"modified\s+from", r"based\s+on", r"reproduced\s+from", r"courtesy\s+of", "copyright", "©", r"from\s+another\s+book",
    "journal", "press", "university", "https?://", r"doi\.org/", r"sources?[\.\s:]*",
]
MARKERS = ["sources", "retrieved", "accessed", "doi", "http"]

CREDIT = "(?i)(?:" + "|".join(CREDIT_STARTS) + ")"
RISK = "(?i)(?:" + "|".join(RISKS) + ")"


def distinct_longest(texts: Column) -> Column:
    """The texts in order, without those seen before and those within an earlier, longer one."""
    none = F.array().cast("array<string>")
    return F.aggregate(texts, none, lambda kept, x: F.when(F.exists(kept, lambda k: k.contains(x)), kept).otherwise(F.concat(kept, F.array(x))))


def credit_sentence(text: Column) -> Column:
    """The credit that a paragraph gives, null without one.

    A paragraph that begins with Sources is one block; a note gives none; else every credit runs from its start to the
    end of the paragraph or an editor's remark, and what repeats within an earlier one goes, links said twice too.
    """
    line = F.btrim(F.regexp_replace(text, r"\s+", " "))
    cut = lambda c: F.btrim(F.split(c, REMARK, 2)[0])
    every = F.regexp_extract_all(line, F.lit(f"(?is)(?=({CREDIT[4:]}.*))"), F.lit(1))
    none = F.array().cast("array<string>")
    block = F.lower(line).startswith("sources:") | F.lower(line).startswith("sources ")
    found = F.when(block, F.array(cut(line))).when(F.lower(line).startswith("note:"), none).otherwise(F.transform(every, cut))
    out = F.array_join(distinct_longest(found), " ")
    for link in (r"(https?://doi\.org/\S+)(\s+\1)+", r"(https?://\S+)(\s+\1)+", r"(https://doi\.org/\S+)\s+doi\.org/(\S+)"):
        out = F.regexp_replace(out, link, "$1")
    return F.when(text.rlike(CREDIT) & (F.size(found) > 0), F.btrim(out))


def needs_permission(caption: Column, credit: Column) -> Column:
    """YES if the credit, or without one the caption, tells of a foreign source, else NO."""
    has = F.coalesce(credit, F.lit("")) != ""
    marked = credit.rlike(RISK)
    for m in MARKERS:
        marked = marked | F.lower(credit).contains(m)
    return F.when(has & marked, "YES").when(has, "NO").when(caption.rlike(RISK), "YES").otherwise("NO")
