"""Lexicons, lookup caches and web pages from files, on any store that Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Character sets by the names pages give them, and what Spark calls them.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "US-ASCII", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE"}
#: Sets of one byte a character that Spark doesn't decode, by the names that Python's tables have for them.
ONE_BYTE = {
    "windows-1250": "cp1250", "cp1250": "cp1250", "windows-1251": "cp1251", "cp1251": "cp1251", "windows-1252": "cp1252", "cp1252": "cp1252", "x-ansi": "cp1252",
    "windows-1253": "cp1253", "windows-1254": "cp1254", "windows-1257": "cp1257", "iso-8859-2": "iso8859-2", "latin2": "iso8859-2", "iso-8859-5": "iso8859-5",
    "iso-8859-7": "iso8859-7", "iso-8859-9": "iso8859-9", "iso-8859-15": "iso8859-15", "koi8-r": "koi8-r",
}
DECLARED = r"(?i)<meta[^>]*charset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)"


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, category, term) of a CSV file with those headers in any case and order, blanks around them and a byte-order mark aside.

    Lines without a term are left out; line_no follows the file's order.
    """
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    names = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    if not {"category", "term"} <= names.keys():
        raise ValueError(f"a lexicon needs the columns category and term, not {raw.columns}")
    rows = raw.select(F.monotonically_increasing_id().alias("line_no"), *[F.btrim(F.col(f"`{names[n]}`")).alias(n) for n in ("category", "term")])
    return rows.where("term <> ''")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a cache in lines of JSON; broken lines and lines without a key are left out."""
    lines = spark.read.text(path).select(F.from_json("value", "key string, value string", {"mode": "PERMISSIVE"}).alias("j"))
    return lines.select("j.key", "j.value").where("key IS NOT NULL")


def from_bytes(latin: Column, codec: str) -> Column:
    """A text read as Latin-1 in which every byte above 127 becomes what it means in `codec`; bytes without a meaning become U+FFFD."""
    high = range(128, 256)
    meant = bytes(high).decode(codec, errors="replace")
    changed = [(chr(b), m) for b, m in zip(high, meant, strict=True) if chr(b) != m]
    return F.translate(latin, "".join(a for a, _ in changed), "".join(m for _, m in changed))


def decoded(content: Column) -> Column:
    """The text of a page's bytes: by its byte-order mark, else the set it declares, else as UTF-8 if it is that, else Latin-1."""
    latin = F.decode(content, "ISO-8859-1")
    said = F.lower(F.regexp_extract(F.substring(latin, 1, 2048), DECLARED, 1))
    out = F.when(F.try_validate_utf8(content.cast("string")).isNotNull(), content.cast("string")).otherwise(latin)
    for name, charset in CHARSETS.items():
        if charset not in ("UTF-8",):
            out = F.when(said == name, F.decode(content, charset)).otherwise(out)
    for name, codec in ONE_BYTE.items():
        out = F.when(said == name, from_bytes(latin, codec)).otherwise(out)
    hex_head = F.hex(F.substring(content, 1, 3))
    out = F.when(hex_head.startswith("FFFE") | hex_head.startswith("FEFF"), F.decode(content, "UTF-16")).otherwise(out)
    return F.regexp_replace(out, "^﻿", "")


def read_html(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of every .htm or .html below `path`."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{htm,html}").option("recursiveFileLookup", "true").load(path)
    return files.select("path", decoded(F.col("content")).alias("html"))
