"""Books put together from rows with parents: order, orphans, floats, nulls, documents without a root."""

from xml.etree import ElementTree

from marginalia.operators import assembly
from marginalia.plans import books

NODE = "doc_id long, node_id string, parent_id string, depth int, place long, sub long, tag string, attributes string, text string"
FLOAT = "doc_id long, node_id string, tag string, attributes string, text string"
CITE = "doc_id long, float_id string, node_id string"


def test_levels_in_order(spark):
    rows = [(1, "r", None, 0, 0, 0, "a", None, None), (1, "x", "r", 1, 2, 0, "b", ' n="1"', "2<&"), (1, "y", "r", 1, 1, 0, "b", "", None), (1, "z", "x", 2, 5, 0, "c", "", "in"),
            (1, "o", "gone", 3, 1, 0, "c", "", "lost"), (2, "r", None, 0, 0, 0, "a", "", ""), (3, "q", "r", 1, 0, 0, "b", "", ""), (4, None, None, 0, 0, 0, "a", "", "id"), (1, "z", "x", 2, 5, 0, "c", "", "in")]
    got = {r["doc_id"]: r["xml"] for r in assembly.assembled(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {1: '<a><b></b><b n="1">2&lt;&amp;<c>in</c></b><c>lost</c></a>', 2: "<a></a>", 4: "<a>id</a>"}
    assert assembly.assembled(spark.createDataFrame([], NODE)).collect() == []


def test_floats_after_their_first_citation(spark):
    nodes = [(d, "r", None, 0, 0, 0, "a", "", "") for d in (1, 2)] + [(1, f"p{i}", "r", 1, i, 0, "p", "", str(i)) for i in range(4)] + [(1, "t", "p1", 2, 0, 0, "t", "", "")]
    floats = [(1, "f2", "fig", "", "two"), (1, "f1", "fig", "", "one"), (1, "f3", "fig", "", "none"), (2, "f1", "fig", "", "other"), (9, "f1", "fig", "", "no root")]
    cites = [(1, "f1", "p2"), (1, "f1", "p0"), (1, "f2", "p0"), (1, "f4", "p1"), (2, "f1", "p9"), (None, "f1", "p0")]
    made = assembly.floated(spark.createDataFrame(nodes, NODE), spark.createDataFrame(floats, FLOAT), spark.createDataFrame(cites, CITE))
    got = {r["doc_id"]: r["xml"] for r in assembly.assembled(made).collect()}
    assert got == {1: "<a><p>0</p><fig>one</fig><fig>two</fig><p>1<t></t></p><p>2</p><p>3</p><fig>none</fig></a>", 2: "<a><fig>other</fig></a>"}


def test_books_are_well_formed(spark, small):
    for row in books.books(spark, small).collect():
        ids = [e.get("id") for e in ElementTree.fromstring(row["xml"]).iter() if e.get("id")]
        assert len(ids) == len(set(ids)) > 0


def test_books_are_made_and_read_once(spark, small, monkeypatch):
    """Nothing is asked to find the depth, nothing joined to find the roots, and a book is parsed once for all its counts."""
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "first", None)
        made = books.counted(spark, small)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan(made)
    assert plan(assembly.floated(*(books.run_sql(spark, small, q) for q in (books.NODES, books.FIGURES, books.CITES)))).count("Join ") == 2
    assert books.run_sql(spark, small, books.NODES).agg({"depth": "max"}).first()[0] == books.DEEPEST
