"""Queries written once as SQL over named tables: Catalyst plans them here, and the same text, over the
same tables elsewhere, is their twin."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from marginalia.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """`text` with every {table} read from `sf_dir`."""
    names = {n for n in re.findall(r"\{(\w+)\}", text) if n in TABLES}
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in sorted(names)})


def query(text: str):
    """A registry entry from one SQL text."""
    return lambda spark, sf_dir: run_sql(spark, sf_dir, text)


def twin(text: str) -> str:
    """The text over tables of the same names."""
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in TABLES else m[0], text)
