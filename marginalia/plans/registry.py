"""Every query of the library outside the training-data operators, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans import activity, biblio, books, manuscript, numeric, packages, shapes, styles, technical, workflow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (activity, numeric, manuscript, biblio, workflow, styles, technical, packages, shapes, books):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
