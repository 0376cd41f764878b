"""Dashboards over all users."""

import pytest

from marginalia.plans import registry


def test_users_by_total_are_all_users_with_all_activity(spark, small):
    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet")
    total = {r[0]: 0 for r in read("customer").select("c_custkey").collect()}
    for r in [*read("orders").select("o_custkey").collect(), *read("events").select("user_id").collect()]:
        if r[0] in total:
            total[r[0]] += 1
    got = [(r["user_id"], r["total"]) for r in registry.QUERIES["srt05_users_by_total"](spark, small).collect()]
    assert got == sorted(total.items(), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize(("name", "tables"), [("prj03_tagged_projection", ["orders"]), ("set03_recent_union", ["orders", "events"])])
def test_all_rows_are_listed(spark, small, name, tables):
    users = {r[0] for r in spark.read.parquet(f"{small}/customer.parquet").select("c_custkey").collect()}
    ids = [r[0] for t, c in (("orders", "o_custkey"), ("events", "user_id")) if t in tables for r in spark.read.parquet(f"{small}/{t}.parquet").select(c).collect()]
    assert registry.QUERIES[name](spark, small).count() == (len(ids) if len(tables) == 1 else sum(i in users for i in ids))
