"""Fill-in-the-middle texts: seeded cuts looked up in an index of distinct texts.

A text's units are words with the white space before them; white space at its end is one more. The index has one row for each
distinct text with the ends of all units, in code points, as an Elias-Fano list: about 2 + log2(length of a unit) bits a unit,
of which any single end is read without decoding the others. Documents are dealt out once by the SHA-256 of their text. Where they
land, equal texts are grouped by the texts themselves, ends are computed for each group once, and the index is joined
back by digest; the join finds the documents where they already are (Spark reuses the exchange, so texts are shuffled once).
A text that more than a task's share of the rows have in common is dealt to several tasks by document id; its index row is made in one of them
and sent to the others. Such texts are fewer than there are tasks.

Edge cases: null texts are empty ones; they have no units and stay plain. A null id counts as an empty id, so such rows are cut by the hash
of the seed alone. Equal rows give equal rows; rows of one id are cut each by its own text. Texts with a sentinel inside stay plain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from .common import BLANKS

# The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

IS_BLANK = np.zeros(256, bool)
IS_BLANK[[ord(c) for c in BLANKS]] = True
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """The ends of a text's units in code points, from its UTF-8 bytes."""
    if not len(raw):
        return np.zeros(0, np.int64)
    blank = IS_BLANK[raw]
    last = ~blank & np.append(blank[1:], True)  # the last byte of each word
    last[-1] = True
    return np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)[last]


class EliasFano:
    """An ascending list of integers from 0 to `top`: low bits packed, high bits as a bitmap of gaps."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes):
        self.n, self.width = n, width
        self.low, self.high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.ranks = np.cumsum(ONES[self.high])  # ones up to and with each byte

    @staticmethod
    def encode(ends: np.ndarray) -> tuple[int, int, bytes, bytes]:
        """(n, width, low, high) of the list."""
        n = len(ends)
        if not n:
            return 0, 0, b"", b""
        width = max(0, int(np.log2(max(int(ends[-1]) // n, 1))))
        low = (ends[:, None] >> np.arange(width)) & 1
        high = np.zeros(n + (int(ends[-1]) >> width) + 1, bool)
        high[(ends >> width) + np.arange(n)] = True
        return n, width, np.packbits(low.astype(bool).ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()

    def __getitem__(self, i: int) -> int:
        """The i-th integer: a rank look-up, one byte of the bitmap, and its own low bits."""
        byte = int(np.searchsorted(self.ranks, i, "right"))
        before = int(self.ranks[byte - 1]) if byte else 0
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        top = byte * 8 + int(bits[i - before]) - i
        at = i * self.width
        piece = int.from_bytes(self.low[at // 8 : (at + self.width + 7) // 8].tobytes(), "little") >> at % 8
        return top << self.width | piece & (1 << self.width) - 1


def _frequent(rows: DataFrame, share: int) -> DataFrame:
    """(digest, parts, anchor): the texts of over `share` rows, with the tasks they are dealt to and their least id; fewer rows than tasks."""
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("anchor")).where(F.col("n") > share)
    found = counts.select("digest", F.ceil(F.col("n") / share).cast("int").alias("parts"), "anchor")
    return F.broadcast(rows.sparkSession.createDataFrame(found.collect(), found.schema))


def _dealt(rows: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, digest, part, text): the documents dealt out by content; the least id of a frequent text is in its part 0."""
    spread = F.pmod(F.xxhash64("doc_id").bitwiseXOR(F.xxhash64("anchor")), F.col("parts")).cast("int")
    return rows.join(frequent, "digest", "left").select("doc_id", "digest", F.coalesce(spread, F.lit(0)).alias("part"), "text").repartition("digest", "part")


def text_index(dealt: DataFrame) -> DataFrame:
    """(digest, first_doc_id, n, width, low, high): the list of unit ends of each distinct text, made once.

    `dealt` has doc_id, digest, part and text, and all rows of a digest and part in one partition.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            made = [EliasFano.encode(unit_ends(np.frombuffer(t.as_buffer(), np.uint8))) for t in texts]
            n, width, low, high = ([m[k] for m in made] for k in range(4))
            told = {"digest": b.column("digest"), "first_doc_id": b.column("first_doc_id"), "n": pa.array(n, pa.int64()), "width": pa.array(width, pa.int32())}
            yield pa.record_batch(told | {"low": pa.array(low, pa.binary()), "high": pa.array(high, pa.binary())})

    # All columns of `dealt` are used here, so that Spark sees the same exchange as in the join. Part 0 is asked for
    # after the grouping: a filter on the column itself would move below the exchange and make it another one.
    groups = dealt.groupBy("digest", "part", "text").agg(F.min("doc_id").alias("first_doc_id"), F.min("part").alias("least")).where("least = 0")
    return groups.select("digest", "first_doc_id", "text").mapInArrow(each, "digest binary, first_doc_id long, n long, width int, low binary, high binary")


@F.arrow_udf(StructType().add("a", LongType()).add("b", LongType()))
def _ends(n: pa.Array, width: pa.Array, low: pa.Array, high: pa.Array, i: pa.Array, j: pa.Array) -> pa.Array:
    """The code points that end the first i and the first j units."""
    a, b = [], []
    for size, w, lo, hi, x, y in zip(n.to_pylist(), width.to_pylist(), low.to_pylist(), high.to_pylist(), i.to_pylist(), j.to_pylist(), strict=True):
        ends = EliasFano(size, w, lo, hi) if size else None
        a.append(ends[x - 1] if x else 0)
        b.append(ends[y - 1] if y else 0)
    return pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def transform(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text as it is (plain), or as prefix, suffix and middle in the
    order of its form (psm, spm). The four first words of SHA-256(`seed:id`) choose both cuts and the form."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    share = max(1, docs.count() // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    frequent = _frequent(rows, share)
    dealt = _dealt(rows, frequent)
    parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    index = text_index(dealt).join(frequent, "digest", "left").select("digest", F.explode(parts).alias("part"), "n", "width", "low", "high")
    each = dealt.join(index.hint("shuffle_hash"), ["digest", "part"], "left")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    x, y = h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)
    each = each.withColumn("ends", _ends("n", "width", "low", "high", F.least(x, y), F.greatest(x, y)))
    told = F.col("text")
    stays = (told == "") | told.contains(PREFIX) | told.contains(SUFFIX) | told.contains(MIDDLE) | (h[2] % 100 >= plain_percent)
    form = F.when(stays, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    a, b = F.col("ends.a"), F.col("ends.b")
    piece = lambda start, size: F.substr(told, (start + 1).cast("int"), size.cast("int"))
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b - a), piece(b, F.length(told))
    each = each.select("doc_id", "n", "text", a.alias("a"), b.alias("b"), form.alias("form"), prefix.alias("p"), middle.alias("m"), suffix.alias("s"))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "p", F.lit(SUFFIX), "s", F.lit(MIDDLE), "m"))
    output = output.otherwise(F.concat(F.lit(SUFFIX), "s", F.lit(PREFIX), "p", F.lit(MIDDLE), "m"))
    cut = F.col("form") != "plain"
    return each.select("doc_id", "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"), F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of; what was cut has no sentinel inside, so its parts are told apart."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
