"""Edges of the style parsers, structuring, credits, highlighting, flow and Word readers, worked out by hand."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marginalia.functions import bookxml, credits, otherstyles
from marginalia.functions.numbers import get_numbers, id_rows, number_ranges
from marginalia.functions.text import hex_entities
from marginalia.operators import captions, dashboard, flow, highlighting, reports, store, structuring
from marginalia.sources.docx import read_docx_comments, read_docx_marks, read_docx_media


def ask(spark, value, expression, kind="string"):
    """What an expression of column t gives for a value."""
    return spark.createDataFrame([(value,)], f"t {kind}").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("shown", "ids"), [("99999999999", []), ("7, 99999999999-3", [7]), ("5-2", []), ("1-20000", list(range(1, 20001))), (None, None)])
def test_numbers_of_any_width(spark, shown, ids):
    assert ask(spark, shown, get_numbers(F.col("t"))) == ids


def test_wide_ranges_are_rows(spark):
    assert [tuple(r) for r in ask(spark, "1-2000000000, 4", number_ranges(F.col("t")))] == [(1, 2000000000), (4, 4)]
    rows = spark.createDataFrame([(1, "3, 1-70000, 9"), (2, None), (3, "x")], "id long, t string")
    got = id_rows(rows, ["id"], "t").orderBy("seq").collect()
    assert [(r.seq, r.n) for r in got] == list(enumerate([3, *range(1, 70001), 9])) and {r.id for r in got} == {1}
    assert id_rows(spark.createDataFrame([(1, "1-30000000")], "id long, t string"), ["id"], "t").count() == 30_000_000


def test_wide_caption_ranges_name_all_items(spark):
    rows = spark.createDataFrame([(1, 1, "Figures 1.1-1.200000"), (1, 2, "Figures 1.1-99999999999.2"), (1, 3, "Figure 2.1-2.3"), (1, 4, None)], "doc_id long, para_no long, text string")
    got = {}
    for r in captions.items(rows).collect():
        got.setdefault(r["para_no"], set()).add(r["item_no"])
    assert got == {1: {f"1.{n}" for n in range(1, 200_001)}, 2: {"1.1", "99999999999.2"}, 3: {"2.1", "2.2", "2.3"}}


def test_unknown_styles(spark):
    with pytest.raises(ValueError, match="no parser"):
        otherstyles.parser("mla")
    assert otherstyles.parser(" APA ") is otherstyles.PARSERS["apa"]
    paras = spark.createDataFrame([(1, 1, "(Smith, 2001)"), (2, 1, "(Smith 2001)"), (3, 1, None)], "doc_id long, para_no long, text string")
    styles = spark.createDataFrame([(1, "mla"), (2, "Vancouver"), (3, "apa")], "doc_id long, style string")
    assert {(r["doc_id"], r["author"], r["year"]) for r in otherstyles.by_style(paras, styles).collect()} == {(1, "Smith", "2001"), (2, "Smith", "2001")}


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("", None),
        (None, None),
        ("Drawn by hand", None),
        ("Note: courtesy of X", None),
        ("Courtesy of A. Please advise. Getty", "Courtesy of A. Getty"),
        ("sources  A\nB please advise", "sources A B"),
        ("See https://doi.org/10.1/x https://doi.org/10.1/x", "https://doi.org/10.1/x"),
        ("resource pack", "source pack"),
    ],
)
def test_credits(spark, line, want):
    assert ask(spark, line, credits.credit_sentence(F.col("t"))) == want


def test_contexts(spark):
    text = "a b c d e f TERM g h i j k l"
    assert ask(spark, text, highlighting.around(F.col("t"), F.lit(text.index("TERM")), F.lit(text.index("TERM") + 4))) == "c d e f TERM g h i j "
    assert ask(spark, "TERM", highlighting.around(F.col("t"), F.lit(0), F.lit(4))) == "TERM"


def test_entities_and_dates(spark):
    assert ask(spark, "&#160;x &amp; &#8212; &#; &#99999999999;", hex_entities(F.col("t"))) == "&#x00A0;x &amp; &#x2014; &#; &#99999999999;"
    assert ask(spark, "May 2001b, 3", bookxml.date_tags(F.col("t"))) == "<month>May</month> <year>2001b</year>, <day>3</day>"
    assert ask(spark, "", bookxml.nested_lists(F.col("t"))) == ""
    lists = "<UL1>a</UL1>\n<OL2>b</OL2><UL1>c</UL1>"
    assert ask(spark, lists, bookxml.nested_lists(F.col("t"))).count("<list ") == 2


def test_sections(spark):
    rows = [(1, "Normal", "before"), (2, "Normal", "<ref-open>"), (3, "REF-N", "1. A"), (4, None, " "), (5, "Heading 1", "References"), (6, "Heading 2", "Other"), (7, "Normal", "2. B"), (8, "Normal", "<ref-open>"), (9, "Normal", "Index"), (10, "Normal", "3. C")]
    paras = spark.createDataFrame([(1, *r) for r in rows] + [(2, 1, None, None)], "doc_id long, para_no long, style string, text string")
    assert [r["para_no"] for r in structuring.section_paragraphs(paras).orderBy("para_no").collect()] == [3, 5]
    got = structuring.cleaned(structuring.section_paragraphs(paras)).orderBy("para_no").collect()
    assert [(r["ref_style"], r["number"], r["body"]) for r in got] == [("REF-N", "1", "A"), ("REF-U", None, "References")]


def test_people_of_both_shapes(spark):
    both = structuring.people(F.col("t"))
    assert [tuple(x) for x in ask(spark, "Smith J, Van Dyk MK", both)] == [("J. ", "Smith"), ("M. K. ", "Van Dyk")]
    assert [x["family"] for x in ask(spark, "Smith, J., & Jones, M. K.", both)] == ["Smith", "Jones"]


def test_colours_and_carried_values(spark):
    marks = spark.createDataFrame([(1, 1, 1, "yellow"), (1, 1, 2, "cyan"), (1, 2, 1, "cyan"), (1, 2, 2, "green"), (1, 2, 2, "green")], "d int, p int, made int, colour string")
    got = {r["p"]: r["colour"] for r in flow.standing_colours(marks, ["d", "p"], "made", "colour").collect()}
    assert got == {1: "yellow", 2: "green"}
    rows = spark.createDataFrame([(1, 1, None), (1, 2, 9), (1, 3, None), (1, 4, 2), (1, 5, None)], "d int, p int, v int")
    assert [r["x"] for r in rows.select("p", flow.carried("v", ["d"], "p").alias("x")).orderBy("p").collect()] == [None, 9, 9, 2, 2]


def test_labels_and_links(spark):
    labels = spark.createDataFrame([(1, "Fig 1", "f1"), (1, "Fig 2a", "f2a"), (1, "Fig 2", "f2")], "doc_id int, label string, id string")
    cites = spark.createDataFrame([(1, 1, "FIG 1"), (2, 1, "Fig 1b"), (3, 1, "Fig 2a"), (4, 1, "Fig 3"), (5, 2, "Fig 1")], "ref int, doc_id int, label string")
    assert {r["ref"]: r["id"] for r in flow.resolved_labels(cites, labels).collect()} == {1: "f1", 2: "f1", 3: "f2a", 4: None, 5: None}
    refs = spark.createDataFrame([(1, "Smith J, Jones M. T. 2001"), (2, "Smith J. U. 2001"), (3, "Lee (K). V. 2001")], "ref_id int, line string")
    asks = spark.createDataFrame([(1, "Smith and Jones", "2001"), (2, "Smith", "2001"), (3, "Lee", "2001"), (4, "Jones, Smith", "2001"), (5, "", "2001"), (6, "(Lee)", "1999")], "cite int, names string, year string")
    assert {r["cite"]: r["ref_id"] for r in flow.single_links(asks, refs).collect()} == {1: 1, 3: 3}


def test_open_ranges(spark):
    rows = [(1, 1, 0, "a"), (1, 2, 1, "a"), (1, 3, 1, "b"), (1, 4, -1, "a"), (1, 5, -1, "a"), (1, 6, -1, "b"), (1, 7, 0, "b")]
    marks = spark.createDataFrame([(d, p, s, n) for d, p, s, n in rows], "d int, p int, step int, name string")
    assert [r["open"] for r in flow.open_ranges(marks, ["d"], "name", "p", "step").orderBy("p").collect()] == [0, 1, 2, 1, 1, 0, 0]


def test_filters_and_names(spark):
    rows = spark.createDataFrame([(1, "macro", "a", 7), (2, "macro", "b", 7), (3, "validation", "", 8)], "id int, type string, route_type string, user_id int")
    ids = lambda **k: sorted(r["id"] for r in store.composed_filter(rows, **k).collect())
    assert ids(is_admin=True) == [1, 2, 3] and ids(is_admin=True, type="macro", route_type="b") == [2] and ids(user_id=8, owner=7) == [1, 2]
    assert ask(spark, "../../etc/pass wd?.docx", store.safe_name(F.col("t"))) == "etc_pass_wd.docx"


def test_reports(spark):
    rows = spark.createDataFrame([(1, "b", "2"), (1, "a", "1"), (1, "b", "1")], "doc_id int, section string, detail string")
    assert reports.text_report(rows).first()["report"] == "a (1)\n  - 1\n\nb (2)\n  - 1\n  - 2"
    files, results = reports.file_and_result(spark.createDataFrame([(1, "x")], "no long, name string"), spark.createDataFrame([(1, 5)], "no long, n int"), F.lit(41))
    assert files.first().asDict() == {"name": "x", "id": 42} and results.first().asDict() == {"n": 5, "file_id": 42}


def test_word_marks_comments_and_media(spark, tmp_path):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    run = "<w:r><w:rPr>{}</w:rPr><w:t>{}</w:t></w:r>"
    body = f"<w:p>{run.format('<w:highlight w:val=\"yellow\"/><w:i/>', 'one')}{run.format('<w:dstrike/>', 'two')}{run.format('<w:vanish w:val=\"0\"/><w:highlight w:val=\"none\"/>', 'three')}<w:r><w:footnoteReference w:id='1'/></w:r></w:p><w:sectPr/>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/comments.xml", f"<w:comments {w}><w:comment w:author='Ann'><w:p><w:r><w:t>a</w:t><w:t>b</w:t></w:r></w:p></w:comment><w:comment/></w:comments>")
        z.writestr("word/_rels/document.xml.rels", "<Relationships><Relationship Type='http://x/relationships/image'/><Relationship Type='http://x/relationships/styles'/></Relationships>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    path = f"file://{tmp_path}"
    marks = read_docx_marks(spark, path)
    assert [tuple(r)[3:] for r in marks.orderBy("run_no").collect()] == [("one", True, True, False, False), ("two", False, False, True, False), ("three", False, False, False, False), ("", False, False, False, False)]
    assert [tuple(r)[1:] for r in read_docx_comments(spark, path).orderBy("comment_no").collect()] == [(1, "Ann", "ab"), (2, "Unknown", "")]
    media = read_docx_media(spark, path)
    assert tuple(media.first())[1:] == (1, 1, 0, 1)
    audit = dashboard.formatting_audit(marks.withColumnRenamed("path", "doc_id"), media.withColumnRenamed("path", "doc_id"))
    assert {tuple(r)[1:] for r in audit.collect()} == {(1, "Strikethrough", "two"), (None, "Section Break", "Section 1")}
