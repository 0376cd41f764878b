"""What several of these operators share: the shared folder, row keys, constants."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that parts words: the space and \\x09 to \\x0D.
BLANKS = " \t\n\x0b\x0c\r"
WORD_GAP = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Set here only where it is unset and Spark runs on one machine."""
    found, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not found:
        found = sc.getCheckpointDir()
        if not found and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = found or "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def work_path(spark: SparkSession, tag: str) -> str:
    """A new path in the session's own part of the shared folder, which clear() empties."""
    return f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Names of the parts of the session's folder that are written to, innermost last.
_parts: list[str] = []


def _folder(spark: SparkSession) -> str:
    return "/".join([shared_dir(spark), f"marginalia-{spark.sparkContext.applicationId}", *_parts])


def clear(spark: SparkSession) -> None:
    """Deletes what this session's operators wrote to the shared folder (inside passing(): to its part); for when their results have been used."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Tables that operators write inside go when this ends; results must have been written elsewhere by then."""
    _parts.append(f"passing-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        try:
            clear(spark)
        finally:
            _parts.pop()


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: computed once, and safe when executors are lost."""
    path = work_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Memory that is free goes back to the system. Python workers outlive tasks, and what the arrays of one leave would stay beside those of the next."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc's
        trim(0)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after each as long as `df` has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """The words of a text as an array; null or blank texts give an empty one."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, WORD_GAP))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns that tell rows of different content apart, though ids repeat or are null."""
    return [F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key")]
