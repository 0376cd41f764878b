"""Connected components of a graph given as edges, by alternating stars.

Each round hangs every node's larger neighbours on its least neighbour, then every node on the least
of its smaller ones; rounds grow with the logarithm of the size. Each round's edges are checkpointed
in the shared folder, so a lost executor costs no lineage; a small graph goes to few tasks, as each task that writes and each one that shuffles leaves files. So are each node's least neighbours, by which edges are joined: with a table on
either side AQE splits the edges of a node with very many, which it doesn't beside an aggregation.

Edge cases: edges with a null end are left out, as are their nodes if no other edge names them; an edge to itself alone gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: Edges of a task, where there are more than the cores take.
TASK_EDGES = 1 << 18


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of an edge with the least node it is connected with; no edges, no rows."""
    shared_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct().checkpoint()
    # No round has more edges than there are now, and twice as many with both directions.
    tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-2 * e.count() // TASK_EDGES))
    e, state = e.coalesce(tasks), None
    while True:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks).checkpoint()
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = large.coalesce(tasks).checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks).checkpoint()
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.union(least).distinct().coalesce(tasks).checkpoint()
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.countDistinct("u")).first())
        if now == state or now[0] == now[2] == 0:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
