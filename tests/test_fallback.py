"""The rule table of references that no look-up knows: hand-read cases, edges, long texts, the size of plans."""

import time

import pytest
from pyspark.sql import functions as F

from marginalia.functions import fallback

CASES = [
    ("ama", "book", "Smith JB, Jones M. Nursing care. 4th ed. Baltimore, MD: Williams & Wilkins; 1995.", "Smith JB, Jones M. Nursing care. 4th ed. Baltimore, MD: Williams & Wilkins; 1995.", "surname fname surname fname book editionno location publisher year"),
    ("ama", "book", "Smith J.B. Care 2nd ed. Wiley", "Smith JB. Care. 2nd ed. Wiley.", "surname fname book editionno publisher"),
    ("ama", "book", "WHO. Report of 1999. Geneva", "WHO. Report of 1999. Geneva; 1999.", "surname book publisher year"),
    ("ama", "edited_book", "Adams K. Pain. In: Orr J (eds.). Research. York: Press; 1994.", "Adams K. Pain. In: Orr J, eds. Research. York: Press; 1994.", "surname fname chaptertitle ed-surname ed-fname book location publisher year"),
    ("ama", "thesis", "Lee A. On cells. Boston: Boston University; 2001.", "Lee A. On cells. Boston: Boston University; 2001.", "surname fname title location publisher year"),
    ("ama", "web", "Facts on salt. Published 2020. Accessed May 5, 2021.", "Facts on salt. Published 2020. 2020. Accessed May 5, 2021.", "surname title year comment"),
    ("ama", "article", "Hall P. Scans. Heart. 2015;27:e14.", "Hall P. Scans. Heart. 2015;27:e14.", "surname fname article journal year volume fpage"),
    ("ama", "article", "Hall P. Scans. Some Journal", "Hall P. Scans. Some Journal.", "surname fname article journal"),
    ("apa", "book", "Smith, J. B., & Jones, M. (2001). Care of all (Rev. ed.). Springer.", "Smith, J. B., & Jones, M. (2001). Care of all (Rev. ed.). Springer.", "surname fname surname fname year book editionno publisher"),
    ("apa", "book", "Smith, J. K. L. (2001) Care. Springer", "Smith, J. K. L. (2001). Care. Springer.", "surname fname year book publisher"),
    ("apa", "edited_book", "Coe, A. (1998). Loss. In S. Coates & D. B. Lee (Ed.), Bonds (pp. 75–97). Press.", "Coe, A. (1998). Loss. In S. Coates, & D. B. Lee (Eds.), Bonds (pp. 75-97). Press.", "surname fname year chaptertitle ed-fname ed-surname ed-fname ed-surname book fpage lpage publisher"),
    ("apa", "thesis", "Lee, A. (n. d.). On cells.", "Lee, A. (n. d.). On cells. ", "surname fname year book"),
    ("apa", "web", "National Group. (2020, Spring). Salt. https://a.b/c).", "National Group. (2020, Spring). Salt. https://a.b/c", "surname year month title url"),
    ("apa", None, "National Group. Salt of 2020. Press", "National Group. (2020). Salt of 2020. Press.", "surname year book publisher"),
]


@pytest.mark.parametrize("style", ["ama", "apa"])
def test_cases_read_by_hand(spark, style):
    cases = [c for c in CASES if c[0] == style]
    rows = spark.createDataFrame([(i, c[1], c[2]) for i, c in enumerate(cases)], "i int, kind string, line string")
    got = rows.select("i", fallback.segments(F.col("line"), F.col("kind"), style).alias("s")).orderBy("i").collect()
    said = [("".join(s["text"] for s in r["s"]), " ".join(s["style"].removeprefix("bib_") for s in r["s"] if s["style"])) for r in got]
    assert said == [c[3:] for c in cases]


def test_null_empty_and_long_references(spark):
    long = "Smith J, " * 30_000 + "Lee A. " + "word " * 100_000 + "(x) 3(4). In: a: b"
    rows = spark.createDataFrame([(0, None), (1, ""), (2, " . "), (3, "x"), (4, "https://a.b"), (5, long), (6, long), (7, "\n(2001)\t")], "i int, line string")
    started = time.time()
    for style in ("ama", "apa"):
        for kind in ("book", None):
            got = {r["i"]: r["s"] for r in rows.select("i", fallback.segments(F.col("line"), F.lit(kind).cast("string"), style).alias("s")).collect()}
            assert got[0] is None and got[1] == [] and got[3][0]["text"] == "x" and got[5] == got[6] and len(got[5]) > 30_000
    assert time.time() - started < 60
    assert rows.where("i > 9").select(fallback.segments(F.col("line"), F.lit("book"), "ama")).collect() == []


def test_more_rules_make_no_larger_plan(spark):
    def size(rules):
        made = spark.range(1).select(F.aggregate(fallback.table(rules), F.lit(0), lambda n, r: n + F.length(r["pattern"])).alias("n"))
        return len(made._jdf.queryExecution().optimizedPlan().treeString().split(":")[0].split("+-"))

    assert size(fallback.AMA) == size(fallback.AMA * 3)
