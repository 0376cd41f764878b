"""Citations against references: exact, abbreviated, smart, by author, by spelling; duplicates; candidates."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from marginalia.functions.authoryear import citation_key, et_al_issue, normalized
from marginalia.functions.text import settled, spread
from marginalia.sources.tables import dealt


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


#: From this length of the later text on difflib leaves frequent characters out.
JUNK_FROM = 200


def alike_by(x: str, y: str, over: float = -1.0) -> float:
    """difflib's ratio of the earlier and the later text, not symmetric; or `over` or less, by a bound, as soon as it can't be more.

    Of short texts the longest run in common is found by looking up ever longer pieces of the earlier text, the first of equal ones in both.
    """
    if len(y) >= JUNK_FROM:
        return difflib.SequenceMatcher(None, x, y).ratio()
    total = len(x) + len(y)
    if x == y or x in y or y in x:
        return 2.0 * min(len(x), len(y)) / total if total else 1.0
    same, most, todo = 0, min(len(x), len(y)), [(x, y)]
    while todo:
        a, b = todo.pop()
        n = at = 0
        for i in range(len(a)):
            if i + n >= len(a):
                break
            while i + n < len(a) and a[i : i + n + 1] in b:
                n, at = n + 1, i
        if n:
            j = b.find(a[at : at + n])
            left, right = (a[:at], b[:j]), (a[at + n :], b[j + n :])
            same += n
            todo += [pair for pair in (left, right) if pair[0] and pair[1]]
            most -= min(len(a), len(b)) - n - min(map(len, left)) - min(map(len, right))
        else:
            most -= min(len(a), len(b))
        if 2.0 * most / total <= over:
            return 2.0 * most / total
    return 2.0 * same / total


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's ratio of the earlier and the later text; not symmetric, so keep their order."""
    return pd.Series([alike_by(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_over(least: float):
    """As `ratio`, but texts that are not over `least` may get any value up to it."""

    @F.pandas_udf(DoubleType())
    def bounded(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike_by(x or "", y or "", least) for x, y in zip(a, b, strict=True)], dtype="float64")

    return bounded


def words(author: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(author, F.lit(r"\b[a-z]{2,}\b"), F.lit(0))), F.array(*map(F.lit, ("and", "the", "et", "al"))))


def match_citations(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """doc_id, cite_id, ref_pos, how: the first reference that a citation matches in the strongest way.

    cites: doc_id, cite_id, author, year. refs: doc_id, ref_pos, author, year, full_author, abbreviations.
    Ways within a year: exact key, abbreviation, smart (equal when normalised, name before a bracketed
    abbreviation, et al. on the first name, all words among the reference's). Then the same author in another
    year, then a spelling over 0.8 alike. A bibliography is as large as a document's, so pairs stay few. Citations of a document that say the
    same are matched once, and names are normalised once a row, not once a pair.
    """
    said = ["doc_id", "author", "year"]
    lead = normalized(F.regexp_extract("author", r"^(.*?)\s*\[.*?\]", 1))
    asked = settled(settled(cites.select(*said).distinct(), said, c=normalized(F.col("author")), prefix=lead, key=citation_key(F.col("author"), F.col("year"))), [*said, "c", "prefix", "key"], has=words(F.col("c")))
    r = refs.select(F.col("doc_id").alias("r_doc"), "ref_pos", F.col("author").alias("r_author"), F.col("year").alias("r_year"), F.coalesce("full_author", "author").alias("full"), "abbreviations")
    own = ["r_doc", "ref_pos", "r_year", "abbreviations"]
    r = settled(r, own, f=normalized(F.col("full")), r_c=normalized(F.col("r_author")), r_key=citation_key(F.col("r_author"), F.col("r_year")))
    r = settled(r, [*own, "f", "r_c", "r_key"], r_has=words(F.col("f")))
    pair = asked.join(r, F.col("doc_id") == F.col("r_doc"))
    same_year, first = F.col("year") == F.col("r_year"), lambda c: F.split_part(c, F.lit(" "), F.lit(1))
    c, f = F.col("c"), F.col("f")
    smart = (c == f) | ((F.col("prefix") != "") & (F.col("prefix") == f)) | (c.contains("et al") & (first(c) == first(f))) | ((F.size("has") > 1) & (F.size(F.array_except("has", "r_has")) == 0))
    rank = F.when(F.col("key") == F.col("r_key"), 1).when(same_year & F.array_contains("abbreviations", F.btrim("author")), 2).when(same_year & smart, 3).when(c == F.col("r_c"), 4)
    best = lambda kind, unlike: F.struct(kind.cast("int").alias("kind"), unlike.cast("double").alias("unlike"), "ref_pos")
    firm = pair.withColumn("rank", rank).where("rank IS NOT NULL").groupBy(*said).agg(F.min(best(F.col("rank"), F.lit(0))).alias("best"))
    known = firm.select(*[F.col(k).alias(f"k_{k}") for k in said])
    equal = lambda other: [F.col(k).eqNullSafe(F.col(f"{other}_{k}")) for k in said]
    rest = asked.join(known, equal("k"), "left_anti").join(r, F.col("doc_id") == F.col("r_doc"))
    a, b = F.col("c"), F.col("r_c")
    banded = rest.where((F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))) > 0.8 / 1.2)
    near = banded.withColumn("ratio", ratio_over(0.8)(a, b)).where("ratio > 0.8")
    spelt = near.groupBy(*said).agg(F.min(best(F.lit(5), -F.col("ratio"))).alias("best"))
    each = firm.unionByName(spelt).select(*[F.col(k).alias(f"e_{k}") for k in said], "best")
    found = cites.join(each, equal("e")).groupBy("doc_id", "cite_id").agg(F.min("best").alias("best"))
    how = F.when(F.col("best.ref_pos").isNull(), "missing").when(F.col("best.kind") == 1, "exact").when(F.col("best.kind") == 2, "abbreviation").when(F.col("best.kind") == 3, "smart")
    how = how.when(F.col("best.kind") == 4, "year mismatch").when(F.col("best.kind") == 5, "spelling").otherwise("missing")
    return cites.select("doc_id", "cite_id").join(found, ["doc_id", "cite_id"], "left").select("doc_id", "cite_id", "best.ref_pos", how.alias("how"))


def validation(cites: DataFrame, refs: DataFrame) -> DataFrame:
    """(doc_id, finding, cite_id, ref_pos): what is said of each citation and reference of a document, from one matching.

    A matched citation is valid, and has `et al error` or `et al warning` besides if its authors are cited so; one that isn't is a year
    mismatch, a spelling or missing. References that no citation matches or nearly matches are unused. Documents with references alone have all
    of them unused; citations without a reference list are missing.
    """
    found = match_citations(cites, refs).join(cites.select("doc_id", "cite_id", F.col("author").alias("cited")), ["doc_id", "cite_id"])
    both = found.join(refs.select("doc_id", "ref_pos", F.coalesce("full_author", "author").alias("full")), ["doc_id", "ref_pos"], "full")
    valid = F.col("how").isin("exact", "abbreviation", "smart")
    misuse = F.when(valid, F.concat(F.lit("et al "), et_al_issue(F.col("cited"), F.col("full"))))
    findings = F.array(F.when(F.col("cite_id").isNull(), "unused").when(valid, "valid").otherwise(F.col("how")), misuse)
    return spread(both, ["doc_id", "cite_id", "ref_pos"], findings, "finding").select("doc_id", "finding", "cite_id", "ref_pos")


#: Letters to a 64-bit number, and bits to a letter, in a bag of letters.
BAG_LETTERS, BAG_BITS = 13, 4
BAG_PARTS = -(-(len(LETTERS) + 1) // BAG_LETTERS)


def letter_bag(text: Column) -> Column:
    """How often a text has each letter, and any others: a bit for each of the first BAG_BITS times, and the number of what is beyond them (`more`).

    What two texts have in common is no more than the bits that both have set and the lesser `more`.
    """
    times = [F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in LETTERS] + [F.length(F.regexp_replace(text, f"[{LETTERS}]", ""))]
    unary = F.array(*[F.lit((1 << n) - 1).cast("long") for n in range(BAG_BITS + 1)])
    bits = lambda n, k: F.element_at(unary, F.least(n, F.lit(BAG_BITS)) + 1) * F.lit(1 << BAG_BITS * k).cast("long")
    part = lambda own: sum((bits(n, k) for k, n in enumerate(own)), F.lit(0).cast("long"))
    more = sum((F.greatest(n - BAG_BITS, F.lit(0)) for n in times), F.lit(0))
    return F.struct(*[part(times[k * BAG_LETTERS : (k + 1) * BAG_LETTERS]).alias(f"p{k}") for k in range(BAG_PARTS)], more.alias("more"))


def duplicates(rows: DataFrame, block: list[str], pos: str, text: str, least: float = 0.85) -> DataFrame:
    """block, id, duplicate_of, score: pairs within a block whose ratio is over `least`; the later is the duplicate.

    Texts are compared in lower case with blanks collapsed. Blocks are documents: pairs are those of one bibliography.
    Before the ratio stand two bounds that no pair over `least` can pass: by lengths, and by letters in common.
    """
    low = F.btrim(F.regexp_replace(F.lower(text), r"\s+", " "))
    rows = settled(dealt(rows, *block, pos), [*block, pos], _low=low)
    rows = settled(rows.where(F.length("_low") > 0), [*block, pos, "_low"], _bag=letter_bag(F.col("_low")), _n=F.length("_low"))
    parts = [f"p{k}" for k in range(BAG_PARTS)]
    side = lambda own, name, end: rows.select(*block, F.col(pos).alias(name), F.col("_low").alias(own), F.col("_n").alias(f"n{end}"), *[F.col(f"_bag.{c}").alias(c + end) for c in [*parts, "more"]])
    a, b = side("_a", "duplicate_of", "x"), side("_b", "id", "y")
    shorter, longer = F.least("nx", "ny"), F.greatest("nx", "ny")
    # Sorted, not broadcast: the sizes that Spark guesses by are those of the files, and rows made from them can be many times as large.
    pairs = a.join(b.hint("merge"), block).where((F.col("duplicate_of") < F.col("id")) & (shorter / longer > least / (2 - least)))
    common = sum((F.bit_count(F.col(f"{c}x").bitwiseAND(F.col(f"{c}y"))) for c in parts), F.least("morex", "morey"))
    pairs = pairs.where(2 * common > least * (F.col("nx") + F.col("ny")))
    return pairs.withColumn("ratio", ratio_over(least)("_a", "_b")).where(F.col("ratio") > least).select(*block, "id", "duplicate_of", F.round(F.col("ratio") * 100, 1).alias("score"))


def plain_title(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"\s+", " ")))


def alike(asked: Column, title: Column) -> Column:
    """The ratio of two titles in lower case with blanks collapsed; none with an empty one."""
    return F.when((F.coalesce(title, F.lit("")) == "") | (asked == ""), F.lit(0.0)).otherwise(ratio(plain_title(asked), plain_title(title)))


def by_title(candidates: DataFrame, key: str = "query") -> DataFrame:
    """The item (key, cand_no, score) of one source for each query title: the first of an equal title, with score 1, else the first most alike.

    Queries none of whose items is alike at all have none. An empty title equals an empty query only.
    """
    same = plain_title(F.col(key)) == plain_title(F.coalesce("title", F.lit("")))
    scored = candidates.withColumn("same", same).withColumn("score", F.when(same, 1.0).otherwise(alike(F.col(key), F.col("title"))))
    first = F.max_by(F.struct("cand_no", "score"), F.struct("same", "score", -F.col("cand_no")))
    return scored.where("score > 0").groupBy(key).agg(first.alias("b")).select(key, "b.cand_no", F.round("b.score", 6).alias("score"))


def best_candidate(candidates: DataFrame, key: str = "query", floor: float = 0.6) -> DataFrame:
    """The best item for each query title among those of two sources.

    candidates: query, source, cand_no, title, doi. A DOI adds 0.06; under the floor there is none; a PubMed
    winner yields to a CrossRef item with a DOI that is within 0.02.
    """
    scored = candidates.withColumn("alike", alike(F.col(key), F.col("title"))).withColumn("score", F.col("alike") + F.when(F.coalesce("doi", F.lit("")) != "", 0.06).otherwise(0.0))
    first = lambda score: F.struct(score.alias("score"), (F.col("source") == "crossref").alias("_c"), (-F.col("cand_no")).alias("_n"), "cand_no", "source", "doi")
    best = scored.groupBy(key).agg(F.max(first(F.col("score"))).alias("b"), F.max(F.when(F.col("source") == "crossref", first(F.col("alike")))).alias("c"))
    yields = (F.col("b.source") == "pubmed") & (F.col("c.score") + 0.02 >= F.col("b.score")) & (F.coalesce("c.doi", F.lit("")) != "")
    out = best.withColumn("w", F.when(yields, F.col("c")).otherwise(F.col("b")))
    return out.where(F.col("b.score") >= floor).select(key, F.col("w.source").alias("source"), F.col("w.cand_no").alias("cand_no"), F.round("w.score", 6).alias("score"))


def containing(parts: DataFrame, wholes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, part, whole): the pairs of distinct texts, of equal keys, in which the whole holds the part, at any place; empty texts are in none.

    Both sides are cut into runs of three characters (all runs of one and two as well, for parts that are shorter). A part is looked up by
    the one of its runs that the fewest wholes have, so no list of a frequent run is read; what is found is then compared.
    """
    part, whole = F.col("part"), F.col("whole")
    parts, wholes = parts.select(*keys, "part").where("part <> ''").distinct(), wholes.select(*keys, "whole").where("whole <> ''").distinct()
    return met_by_runs(parts.withColumn("needs", F.array("part")), wholes, keys).where(F.contains(whole, part)).select(*keys, "part", "whole")


def runs_of(text: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))


def met_by_runs(asked: DataFrame, wholes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """`asked` (distinct rows; keys, needs: an array of texts) with each whole of its keys that has the one of their runs of characters that the fewest
    wholes have. A whole that holds all `needs` is among them; empty ones ask for nothing."""
    posted = wholes.select(*keys, "whole", F.explode(F.array_distinct(F.concat(*[runs_of(F.col("whole"), n) for n in (1, 2, 3)]))).alias("run"))
    looked = F.flatten(F.transform("needs", lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < 3, F.array(t)).otherwise(runs_of(t, 3))))
    own = [c for c in asked.columns if c not in keys]
    counts = posted.groupBy(*keys, "run").agg(F.count("*").alias("n"))
    rows = asked.withColumn("run", F.explode(F.array_distinct(looked))).join(counts, [*keys, "run"], "left")
    rarest = rows.groupBy(*keys, *own).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("r")).where("r.n > 0")
    return rarest.select(*keys, *own, F.col("r.run").alias("run")).join(posted, [*keys, "run"]).drop("run")


def journal_short(items: DataFrame, names: DataFrame) -> DataFrame:
    """`items` (journal) with `short`: of the same name in `names` (name, short; in lower case), else of the longest one that it
    holds or that holds it, else itself. Each distinct journal is looked up once, in both directions by rare runs of its characters."""
    low = F.lower("journal")
    keys = items.select("journal", low.alias("low")).distinct()
    held = containing(names.select(F.col("name").alias("part")), keys.select(F.col("low").alias("whole"))).select(F.col("part").alias("name"), F.col("whole").alias("low"))
    holding = containing(keys.select(F.col("low").alias("part")), names.select(F.col("name").alias("whole"))).select(F.col("whole").alias("name"), F.col("part").alias("low"))
    hit = keys.join(held.union(holding).distinct(), "low").join(names, "name")
    order = F.struct((F.col("low") == F.col("name")).alias("same"), F.length("name").alias("n"), F.col("name").alias("name"))
    best = hit.groupBy("journal").agg(F.max_by("short", order).alias("short"))
    found = items.join(best, "journal", "left")
    return found.withColumn("short", F.coalesce("short", "journal"))
