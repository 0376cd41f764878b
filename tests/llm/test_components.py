"""Components of a small graph, whatever the number of shuffle partitions."""

import os

from marginalia.llm import common
from marginalia.llm.components import components


def test_a_small_graph_leaves_few_files(spark):
    names = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {n: spark.conf.get(n, None) for n in names}
    top = common.shared_dir(spark).removeprefix("file://")
    parts = lambda: {(at, f) for at, _, files in os.walk(top) if os.path.basename(at).startswith("rdd-") for f in files if f.startswith("part-")}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        old = parts()
        edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 50 != 49], "a long, b long")
        got = {r["node"]: r["root"] for r in components(edges).collect()}
        assert got == {i: i // 50 * 50 for i in range(300)}
        sizes = {}
        for at, _ in parts() - old:
            sizes[at] = sizes.get(at, 0) + 1
        assert len(sizes) > 4 and sorted(sizes.values())[-2] <= spark.sparkContext.defaultParallelism
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
