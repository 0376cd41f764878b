"""Conditions and lines of the activity store that depend on a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of files that are taken in and given out.
ALLOWED = ["docx", "doc"]
GIVEN = ["docx", "doc", "zip", "txt", "html", "xlsx"]


def composed_filter(history: DataFrame, type: str = "", route_type: str = "", user_id: int | None = None, is_admin: bool = False, owner: int | None = None) -> DataFrame:  # noqa: A002
    """The history under the filters that a request has; who is no administrator sees what `owner` owns, whoever is asked for."""
    who = user_id if is_admin else owner
    tests = [("type", type or None), ("route_type", route_type or None), ("user_id", who)]
    for name, wanted in tests:
        if wanted is not None:
            history = history.where(F.col(name) == wanted)
    return history


def resolved_tokens(asked: DataFrame, memory: DataFrame, jobs: DataFrame, folders: DataFrame) -> DataFrame:
    """`asked` (token) with `route_type`: of the token in memory, else of its job if that has no errors (general without a
    route), else `recovered` if its folder is there, else null. Equi-joins by token; the least of several rows counts."""
    own = lambda df, c, name: df.groupBy("token").agg(F.min(c).alias(name))
    done = jobs.where(F.coalesce("errors", F.lit("")) == "")
    route = F.coalesce(F.nullif(F.col("route_type"), F.lit("")), F.lit("general"))
    met = asked.join(own(memory, F.col("route_type"), "_m"), "token", "left").join(own(done, route, "_j"), "token", "left").join(own(folders, F.lit("recovered"), "_f"), "token", "left")
    return met.withColumn("route_type", F.coalesce("_m", "_j", "_f")).drop("_m", "_j", "_f")


def audit_line(when: Column, *parts: Column) -> Column:
    """A line of the log: time to the second, then its parts, between dashes; null parts are left out."""
    return F.concat_ws(" - ", F.date_format(when, "yyyy-MM-dd HH:mm:ss"), *parts)


def ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def is_allowed(name: Column) -> Column:
    return ending(name).isin(ALLOWED)


def is_download(name: Column) -> Column:
    return ending(name).isin(GIVEN)


def safe_name(name: Column) -> Column:
    """A name for storing: path signs are blanks, blanks are one underscore, other signs go, no points or underscores at its ends."""
    flat = F.regexp_replace(F.btrim(F.regexp_replace(name, r"[/\\:]", " ")), r"\s+", "_")
    return F.regexp_replace(F.regexp_replace(flat, r"[^A-Za-z0-9_.-]", ""), r"^[._]+|[._]+$", "")
