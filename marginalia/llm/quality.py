"""Quality rules: a table of thresholds compiled into one projection.

Edge cases: a null, empty or blank text has no words, so it fails the base rules and
is not kept. Rows are judged one by one, so repeated rows and ids each get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, unused, words_of

# Common function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and in to that is was for on with as it at by be this from or an are "
    "de la le les et des en un une du que est dans pour il ne sur par "
    "der die das und ist von zu den mit sich ein nicht auf für "
    "el los y por con para las del se una no"
).split()

#: (rule, measure, least, most): a document stays if every measure lies within its bounds.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("word_length", "word_chars / n_words", 3.0, 10.0),
    ("symbols", "n_symbols / n_words", None, 0.1),
    ("stop_words", "n_stop_words / n_words", 0.08, None),
    ("repeated_lines", "n_dup_lines / n_lines", None, 0.4),
]


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` with a struct column `quality` of counts, each a whole-text measure.

    Repeated three-word windows are found by sorting the windows' hashes with their places:
    equal neighbours are repeats, and the places, sorted again, give the words they cover.
    """
    quality_, words_, lines_, sorted_, at_ = unused(docs, "quality", "_words", "_lines", "_sorted", "_at")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.withColumn(words_, words_of(text)).withColumn(lines_, F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    w, lines = F.col(words_), F.col(lines_)
    window = F.transform(w, lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("p")))
    df = df.withColumn(sorted_, F.sort_array(F.slice(window, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))))
    s = F.col(sorted_)
    again = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
    df = df.withColumn(at_, F.sort_array(F.transform(again, lambda x: x["p"])))
    at = F.col(at_)
    covered = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    long = lambda c: c.cast("long")
    quality = F.struct(
        long(F.size(w)).alias("n_words"),
        long(F.length(F.array_join(w, ""))).alias("word_chars"),
        long(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        long(F.aggregate(covered, F.lit(0), lambda a, x: a + x)).alias("n_repeat_words"),
        long(F.size(lines)).alias("n_lines"),
        long(F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,"))).isin(STOP_WORDS)))).alias("n_stop_words"),
    )
    return df.withColumn(quality_, quality).drop(words_, lines_, sorted_, at_)


def base_failed(q: Column) -> Column:
    """Too short, or over half of the words in repeated three-word windows."""
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def verdict(q: Column, rules=RULES) -> Column:
    """The rule table as one boolean: every ratio within its bounds. A ratio over nothing breaks no bound."""
    ok = F.lit(True)
    for _, measure, least, most in rules:
        top, bottom = (q[x.strip()] for x in measure.split("/"))
        ratio = top / F.nullif(bottom, F.lit(0))
        for fails in [ratio < least] * (least is not None) + [ratio > most] * (most is not None):
            ok &= ~F.coalesce(fails, F.lit(False))
    return ok


def score_quality(docs: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """`docs` with `quality` (counts), `base_failed` and `kept`; if `docs` has columns of these names, theirs stay and these get underscores."""
    quality_, failed_, kept_ = unused(docs, "quality", "base_failed", "kept")
    q = F.col(quality_)
    return measures(docs, text_col).withColumn(failed_, base_failed(q)).withColumn(kept_, ~base_failed(q) & verdict(q, rules))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that pass, with the columns they came with.

    The verdict is made to look non-deterministic, or the filter would be pushed below the projections that
    hold the sorted windows, which would then be sorted anew for every word.
    """
    scored = score_quality(docs.select(F.struct("*").alias("_row"), F.col("text")), rules)
    return scored.select("_row", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("_kept")).where("_kept").select("_row.*")
