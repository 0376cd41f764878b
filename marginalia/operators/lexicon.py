"""Lexicon and pattern scans over sentences and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marginalia.functions import text as T

#: First words of a lexicon up to which sentences are searched for them before the join.
MOST_FIRSTS = 1000
#: What tells sentences apart.
KEYS = ["doc_id", "para_no", "sent_no"]


def load(rows: DataFrame) -> DataFrame:
    """(term, category, line_no): terms with space collapsed, the last line of a term giving its category, the first its place."""
    term = T.collapse_space(F.col("term"))
    return rows.where("trim(term) <> ''").groupBy(term.alias("term")).agg(F.max_by("category", "line_no").alias("category"), F.min("line_no").alias("line_no"))


def _met(sentences: DataFrame, terms: DataFrame, placed: bool) -> DataFrame:
    """`sentences` and `terms` with `_start`, `_end` (0 unless `placed`) for each place where a sentence has a term, word by word.

    Sentences and terms are cut into words and what lies between. A place that begins with a term's first word is kept with as many
    pieces as the longest term has, and the term's own pieces must equal them: no pattern is made for a term, and Spark joins by first word,
    by broadcast or shuffle as the lexicon's size has it. Terms in capitals match as they are, others in any case; terms that begin
    with no word character meet none. One that ends with none needs a word right after it.
    """
    cut = lambda c: F.regexp_extract_all(c, F.lit(r"(?U)\w+|\W+"), F.lit(0))
    size = F.size(cut(F.col("term")))
    closed = F.rlike("term", F.lit(r"(?U)\w$"))
    keyed = terms.withColumn("_first", F.lower(F.regexp_extract("term", r"(?U)^\w+", 0))).where("_first <> ''").withColumns({"_n": size, "_closed": closed})
    bounds = keyed.agg(F.max("_n").alias("most")).first()
    most = bounds["most"] or 0
    firsts = [r["_first"] for r in keyed.select("_first").distinct().limit(MOST_FIRSTS + 1).collect()]

    def candidates(pieces: Column) -> Column:
        # Few first words: only places with one of these go on, so that sentences are not spelled out in full.
        hit = lambda x: F.lower(x).isin(firsts) if len(firsts) <= MOST_FIRSTS else x.rlike(r"(?U)^\w")
        at = F.array_compact(F.transform(pieces, lambda x, i: F.when(hit(x), i)))
        own = lambda i: F.slice(pieces, i + 1, most + 1).alias("pieces")
        if not placed:
            return F.array_distinct(F.transform(at, lambda i: F.struct(F.lit(0).cast("long").alias("start"), own(i))))
        starts = T.starts_of(F.transform(pieces, lambda x: F.length(x)))
        return T.bound(at, lambda a: F.when(F.size(a) > 0, T.bound(starts, lambda s: F.transform(a, lambda i: F.struct(F.get(s, i).alias("start"), own(i))))))

    if not firsts:
        return sentences.join(keyed, F.lit(False)).withColumns({"_start": F.lit(0).cast("long"), "_end": F.lit(0).cast("long")}).drop("_first", "_n", "_closed")
    found = T.spread(sentences, sentences.columns, T.bound(cut(F.col("sentence")), candidates), "_at")
    both = found.withColumn("_word", F.lower(F.get("_at.pieces", F.lit(0)))).join(keyed, F.col("_word") == F.col("_first"))
    own = F.array_join(F.slice("_at.pieces", F.lit(1), F.col("_n")), "")
    equal = F.when(F.col("term") == F.upper("term"), own == F.col("term")).otherwise(F.lower(own) == F.lower("term"))
    ends = F.col("_closed") | (F.size("_at.pieces") > F.col("_n"))
    places = {"_start": F.col("_at.start"), "_end": F.col("_at.start") + F.length(own)}
    return both.where(equal & ends).withColumns(places).drop("_at", "_word", "_first", "_n", "_closed")


def hits(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each sentence and term in it; terms in capitals match as they are, others in any case."""
    return _met(sentences, terms, placed=False).drop("_start", "_end").dropDuplicates([*KEYS, "term"])


def places(sentences: DataFrame, terms: DataFrame) -> DataFrame:
    """A row for each place of a term in a sentence, with its `start` and `end` there (code points from 0); of terms at one place the first of the lexicon.

    `terms` has line_no, their order in the lexicon. A sentence's own `start` is called `sentence_start`.
    """
    told = sentences.withColumnRenamed("start", "sentence_start") if "start" in sentences.columns else sentences
    first = W.partitionBy(*KEYS, "_start", "_end").orderBy("line_no")
    return _met(told, terms, placed=True).withColumn("_no", F.row_number().over(first)).where("_no = 1").drop("_no").withColumnsRenamed({"_start": "start", "_end": "end"})


def report(paras: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, para_no, sent_no, page, category, term, sentence for each finding."""
    return hits(T.sentences(paras), terms).join(T.pages_by_words(paras), ["doc_id", "para_no"])
