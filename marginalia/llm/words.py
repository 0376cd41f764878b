"""Per-word values summed over documents, with each distinct word valued once.

A corpus has few very frequent words and a long tail of rare ones. The frequent ones (a bounded
head, whatever the corpus) go to every task with their values, so most occurrences are summed where
they are read; rare ones are joined by word, and no join key is hot, since hot words are in the head.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, row_key

HEAD, HEAD_BYTES = 1 << 18, 64  # words and bytes of a word that go to every task at most


SLICE_BYTES = 1 << 22


def slices(b: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about `most` bytes of text, so that arrays over its words stay small."""
    size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64)
    run = np.cumsum(size) // most
    cuts = [*np.flatnonzero(np.diff(run, prepend=-1)).tolist(), b.num_rows]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        yield b.slice(a, z - a)


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, words): text i holds words[codes[offsets[i]:offsets[i + 1]]]; `lower`: A-Z only."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.dictionary_encode()
    codes, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
    offsets, codes = offsets - offsets[0], codes[offsets[0] : offsets[-1]]
    blank = pc.index(words, "").as_py()
    if blank >= 0:  # white space at a text's ends
        keep = codes != blank
        offsets, codes = np.concatenate([[0], np.cumsum(keep)])[offsets], codes[keep]
    return offsets, codes, words


def with_kinds(kinds: np.ndarray, offsets: np.ndarray, codes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, words) with each word told apart by the kind of its text: the kind's digit comes before it."""
    base = int(kinds.max(initial=0)) + 1
    both = codes.astype(np.int64) * base + np.repeat(kinds, np.diff(offsets))
    there = np.zeros(len(words) * base, bool)
    there[both] = True
    picked = np.flatnonzero(there)
    digit = pa.array((picked % base).astype(str), pa.string())
    return (np.cumsum(there) - 1)[both], pc.binary_join_element_wise(digit, words.take(pa.array(picked // base)), "")


Kinds = Callable[[np.ndarray, np.ndarray, pa.Array], np.ndarray]
#: From (kinds, offsets, codes, words) of texts, a number for each text.
OfText = Callable[[np.ndarray, np.ndarray, np.ndarray, pa.Array], np.ndarray]


def word_counts(docs: DataFrame, lower: bool, train: str = "true", kinds: Kinds | None = None) -> DataFrame:
    """(word, n, n_train): occurrences in all texts, and in those where the SQL condition `train` holds.

    With `kinds`, which gives each text a kind from 0 to 9, words are counted by kind (with_kinds), and the texts
    of a kind as a word of its digit and a line end.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, codes, words = split_words(b.column("text"), lower)
            if kinds:
                own, train = kinds(offsets, codes, words), b.column("train").to_numpy(zero_copy_only=False)
                codes, words = with_kinds(own, offsets, codes, words)
                each = np.unique(own)
                texts = [np.array([(own[rows] == k).sum() for k in each], np.int64) for rows in (slice(None), train)]
                yield pa.record_batch({"word": pa.array([f"{k}\n" for k in each]), "n": texts[0], "n_train": texts[1]})
            n = np.bincount(codes, minlength=len(words))
            seen = np.flatnonzero(n)
            trained = np.repeat(b.column("train").to_numpy(zero_copy_only=False).astype(float), np.diff(offsets))
            known = np.bincount(codes, weights=trained, minlength=len(words))
            yield pa.record_batch({"word": words.take(pa.array(seen)), "n": n[seen], "n_train": known[seen].astype(np.int64)})

    each = docs.select("text", F.expr(train).alias("train")).mapInArrow(count, "word string, n long, n_train long")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train"))


def head_of(words: DataFrame, most: int = HEAD) -> int:
    """The least n from which on at most `most` words are as frequent; found on a histogram of a few hundred rows."""
    step = F.floor(F.log2("n") * 8)
    rows = words.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, 1 << 62
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["words"]
        if total > most:
            break
        least = r["least"]
    return least


def sum_over_words(
    docs: DataFrame, words: DataFrame, values: list[str], lower: bool, kinds: Kinds | None = None, of_text: OfText | None = None
) -> DataFrame:
    """One row for each document: doc_id, kind, n_bytes, n_words, the sum of each of `values` over its words and, if given, `of_text`.

    `words` has word, n and the values (doubles), for every word of the corpus. Rows of equal id and
    content are summed as one and given back as often as they occur.
    """
    given, values = values, [*values, "of_text"] if of_text else values
    is_head = (F.col("n") >= head_of(words)) & (F.octet_length("word") <= HEAD_BYTES)
    head = words.where(is_head).select("word", *given).toArrow()
    table = np.column_stack([head.column(v).to_numpy() for v in given])
    shared = docs.sparkSession.sparkContext.broadcast((head.column("word").combine_chunks(), np.vstack([table, np.zeros((1, len(given)))])))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, table = shared.value
        for b in (part for whole in batches for part in slices(whole)):
            offsets, codes, words = split_words(b.column("text"), lower)
            kind = kinds(offsets, codes, words) if kinds else np.zeros(b.num_rows, np.int64)
            if kinds:
                codes, words = with_kinds(kind, offsets, codes, words)
            place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            at = place[codes]
            ids, keys = b.column("doc_id"), b.column("text_key")
            own = pa.array([f"\n{i}\n{k}" for i, k in zip(ids.to_pylist(), keys.to_pylist(), strict=True)], pa.string())  # no word has a line end
            sums = {v: np.bincount(doc, weights=table[at, k], minlength=b.num_rows) for k, v in enumerate(given)}
            if of_text:
                sums["of_text"] = of_text(kind, offsets, codes, words)
            size = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            told = {"copies": np.ones(b.num_rows, np.int64), "kind": kind.astype(np.int64), "n_bytes": size, "n_words": np.diff(offsets)} | sums
            whole = pa.StructArray.from_arrays([pa.array(x) for x in told.values()], names=list(told))
            yield pa.record_batch({"doc_id": ids, "text_key": keys, "word": own, "times": np.zeros(b.num_rows, np.int64), "own": whole})
            rare = at < 0
            pair, times = np.unique(doc[rare] * np.int64(len(words)) + codes[rare], return_counts=True)
            row, word = pa.array(pair // max(len(words), 1)), pa.array(pair % max(len(words), 1))
            none = pa.nulls(len(pair), whole.type)
            yield pa.record_batch({"doc_id": ids.take(row), "text_key": keys.take(row), "word": words.take(word), "times": times.astype(np.int64), "own": none})

    told = "copies: long, kind: long, n_bytes: long, n_words: long" + "".join(f", {v}: double" for v in values)
    schema = f"doc_id long, text_key long, word string, times long, own struct<{told}>"
    rows = docs.select(*row_key(), "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(spread, schema)
    rare = words.where(~is_head).select("word", *[F.col(v).alias(f"w_{v}") for v in given])
    copies = F.greatest(F.sum("own.copies"), F.lit(1))
    both = lambda v: F.coalesce(F.sum(f"own.{v}"), F.lit(0.0)) + (F.coalesce(F.sum(F.col("times") * F.col(f"w_{v}")), F.lit(0.0)) if v in given else 0.0)
    total = [(both(v) / copies).alias(v) for v in values]
    each = rows.join(rare, "word", "left").groupBy("doc_id", "text_key").agg(
        copies.alias("copies"),
        F.max("own.kind").alias("kind"),
        (F.sum("own.n_bytes") / copies).cast("long").alias("n_bytes"),
        (F.sum("own.n_words") / copies).cast("long").alias("n_words"),
        *total,
    )
    return each.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies", "text_key")


def by_word(words: DataFrame, value: Callable[[pa.Array], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """`words` with columns worked out from each word once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for b in batches:
            yield pa.record_batch({n: b.column(n) for n in b.schema.names} | value(b.column("word")))

    old = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(each, f"{old}, {schema}")
