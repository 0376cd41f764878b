"""Rows with parents put together as one XML text a document, level by level from the deepest.

A node is (doc_id, node_id, parent_id, depth, place, sub, tag, attributes, text); a document's root has depth 0 and no parent. Each level is one
aggregation: nodes meet what their children have become, in the order of place, sub and id. Nothing recurses; levels are as many as the
deepest node has, which is the one number that comes to the driver. A document's text is a row, so it is as large as the document.

All nodes of depth 1 are the root's. A deeper one whose parent is not one level above it goes to the end of the root; a document without a
root has none of its nodes. Null texts and attributes are empty; of nodes of one id in a document, and of roots, the least stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
NODE = ["doc_id", "node_id", "parent_id", "depth", "place", "sub", "tag", "attributes", "text"]


def escaped(text: Column) -> Column:
    """Text as XML holds it; characters that XML can't hold are left out, carriage returns are spelt."""
    for plain, spelt in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(plain), F.lit(spelt))
    return F.regexp_replace(text, NOT_XML, "")


def attribute(name: str, value: Column) -> Column:
    """` name="value"`, empty if the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(escaped(value.cast("string")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))


def assembled(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(doc_id, xml) of each document that has a root. `deepest`: a depth that no node is below; without it all nodes are made once more to find it."""
    own = F.struct("parent_id", "place", "sub", "tag", F.coalesce("attributes", F.lit("")).alias("attributes"), escaped(F.coalesce("text", F.lit(""))).alias("text"))
    # Nodes of a document stand in one row first, so that all levels share one exchange and the sources are read once for them.
    each = nodes.select("doc_id", F.struct("node_id", "depth", own.alias("own")).alias("node"))
    if deepest is None:
        deepest = each.agg(F.max("node.depth").alias("d")).first()["d"]
    no_child, no_own = F.lit(None).cast("struct<place:bigint,sub:bigint,node_id:string,xml:string>"), F.lit(None).cast(each.schema["node"].dataType["own"].dataType)
    gathered = each.groupBy("doc_id").agg(F.collect_list("node").alias("nodes"))
    below, astray = None, None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = F.filter("nodes", lambda n: n["depth"] == depth)  # noqa: B023
        here = gathered.select("doc_id", F.inline(level)).select("doc_id", "node_id", "own", no_child.alias("child"))
        for children in (below, astray if depth == 0 else None):
            here = here.unionByName(children) if children is not None else here
        if depth == 0:
            here = here.withColumn("node_id", F.lit(None).cast("string"))
        met = here.groupBy("doc_id", "node_id").agg(F.min("own").alias("own"), F.array_sort(F.collect_list("child")).alias("children"))
        inner = F.array_join(F.transform("children", lambda c: c["xml"]), "")
        xml = F.concat(F.lit("<"), "own.tag", "own.attributes", F.lit(">"), "own.text", inner, F.lit("</"), "own.tag", F.lit(">"))
        if depth == 0:
            return met.where("own IS NOT NULL").select("doc_id", xml.alias("xml"))
        child = F.struct(F.col("own.place").cast("long").alias("place"), F.col("own.sub").cast("long").alias("sub"), "node_id", xml.alias("xml"))
        below = met.where("own IS NOT NULL").select("doc_id", F.col("own.parent_id").alias("node_id"), no_own.alias("own"), child.alias("child"))
        last = F.struct(F.lit(2**62).alias("place"), F.lit(0).cast("long").alias("sub"), F.lit("").alias("node_id"), inner.alias("xml"))
        lost = met.where("own IS NULL").select("doc_id", F.lit(None).cast("string").alias("node_id"), no_own.alias("own"), last.alias("child"))
        astray = lost if astray is None else astray.unionByName(lost)
    return nodes.select("doc_id", F.lit("").alias("xml")).limit(0)


def floated(nodes: DataFrame, floats: DataFrame, cites: DataFrame) -> DataFrame:
    """`nodes` and the floats among them: each beside the first node of its document that cites it, or at the end of the root.

    floats: doc_id, node_id, tag, attributes, text. cites: doc_id, float_id, node_id. A float takes the parent and place of that node, after it; several of a place go by their ids.
    A float cited from inside a table stands there, in the cell. One that is not cited has depth 1 and so needs no parent's name.
    """
    at = cites.join(nodes.select("doc_id", "node_id", "parent_id", "depth", "place"), ["doc_id", "node_id"])
    first = at.groupBy("doc_id", F.col("float_id").alias("node_id")).agg(F.min(F.struct("place", "depth", "parent_id")).alias("f"))
    put = floats.where("doc_id IS NOT NULL").join(first, ["doc_id", "node_id"], "left")
    where = [F.col("f.parent_id").alias("parent_id"), F.coalesce("f.depth", F.lit(1)).cast("int").alias("depth"), F.coalesce("f.place", F.lit(2**61)).cast("long").alias("place"), F.lit(1).cast("long").alias("sub")]
    return nodes.select(*NODE).unionByName(put.select("doc_id", "node_id", *where, "tag", "attributes", "text"))
