"""Cases worked out by hand for what SQL can't express, and every SQL twin on the smallest tables."""

import difflib
import io
import zipfile
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.functions import authoryear, formatters, text
from marginalia.functions.numbers import format_numbers, get_numbers
from marginalia.operators import captions, lexicon, matching, stylerecords
from marginalia.plans import registry
from marginalia.plans.sqlquery import TABLES
from marginalia.sources.docx import read_docx, read_docx_runs
from marginalia.streaming.activity import daily_routes


def rounded(row, cols):
    return tuple(round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, (int, bool)) else v for v in (row[c] for c in cols))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_twin(spark, small, name):
    df = registry.QUERIES[name](spark, small)
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(registry.ORACLES[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted((rounded(r, cols) for r in df.collect()), key=str) == sorted((rounded(r, cols) for r in rows), key=str)


@pytest.mark.parametrize(("shown", "ids"), [("1-5", [1, 2, 3, 4, 5]), ("5-2, 7", [7]), ("3", [3]), ("", []), ("1–3,x,9", [1, 2, 3, 9]), ("4-4", [4])])
def test_numbers(spark, shown, ids):
    assert spark.createDataFrame([(shown,)], "t string").select(get_numbers(F.col("t")).alias("n")).first()["n"] == ids


def test_number_ranges(spark):
    rows = spark.createDataFrame([(1, n) for n in (1, 2, 3, 5, 7, 8, 8)] + [(2, 9)], "k int, n int")
    assert {r["k"]: r["shown"] for r in format_numbers(rows, "k", "n").collect()} == {1: "1-3, 5, 7,8", 2: "9"}


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ("(Smith, 2020)", {("Smith", "2020", "parenthetical", "")}),
        ("(Smith 2020)", {("Smith", "2020", "parenthetical", "missing comma")}),
        ("(Smith and Jones, 2020)", {("Smith and Jones", "2020", "parenthetical", "and in parentheses")}),
        ("Smith (2020) says", {("Smith", "2020", "narrative", "")}),
        ("PMHNP (2020)", set()),
        ("(p. 12)", set()),
        ("Shapiro (2001, 2012)", {("Shapiro", "2001", "narrative", ""), ("Shapiro", "2012", "narrative", "")}),
        ("(see Smith, n.d.-a; Jones & Ray, in press)", {("Smith", "n.d.-a", "parenthetical", ""), ("Jones & Ray", "in press", "parenthetical", "")}),
        ("Smith (2020) and (Smith, 2020)", {("Smith", "2020", "parenthetical", "")}),
    ],
)
def test_in_text(spark, said, want):
    got = authoryear.in_text(spark.createDataFrame([(1, 1, said)], "doc_id long, para_no long, text string")).collect()
    assert {(r["author"], r["year"], r["type"], ";".join(r["warnings"])) for r in got} == want


@pytest.mark.parametrize(("n", "start", "end"), [(0, "Unknown authors", "Unknown authors"), (1, "F0, A. B.", "F0, A. B."), (2, "F0, A. B., & F1, A. B.", "F1, A. B."), (20, "F0, A. B., F1", ", & F19, A. B."), (21, "F0, A. B., F1", "F18, A. B., ... F20, A. B.")])
def test_apa_authors(spark, n, start, end):
    item = ("journal-article", [("Ann Beth", f"F{i}") for i in range(n)], "T", "J", "1", "2", "3-4", None, None, None, "1999")
    row = spark.createDataFrame([(item,)], f"item struct<{', '.join(p.replace(' ', ':', 1) for p in formatters.ITEM.split(', '))}>").select(formatters.plain(formatters.apa(F.col("item"))).alias("a"), formatters.plain(formatters.ama(F.col("item"))).alias("m"), formatters.html(formatters.apa(F.col("item"))).alias("h")).first()
    who = row["a"].split(" (1999)")[0]
    assert who.startswith(start) and who.endswith(end)
    assert row["a"].endswith("(1999). T. J, 1(2), 3-4.") and "<i>J</i>" in row["h"]
    assert (", et al" in row["m"]) == (n > 6)


def test_duplicates(spark):
    texts = ["Smith J. A study of frogs. 2001", "Smith J. A study of frogs. 2002", "Other text", "", "Smith, J. A study of frog. 2001", "x" * 250, "y" + "x" * 249]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc long, pos long, text string")
    got = {(r["duplicate_of"], r["id"]) for r in matching.duplicates(rows, ["doc"], "pos", "text").collect()}
    assert got == {(i, j) for i, j in combinations(range(len(texts)), 2) if texts[i] and texts[j] and difflib.SequenceMatcher(None, texts[i], texts[j]).ratio() > 0.85}


def test_smart_matches(spark):
    cites = spark.createDataFrame([(1, 1, "World Health Org [WHO]", "2000"), (1, 2, "Smith et al", "2000"), (1, 3, "Lee and Ray", "2000"), (1, 4, "Smith", "1999"), (2, 5, "Smith", "2000"), (1, 6, "Smit", "2005")], "doc_id long, cite_id long, author string, year string")
    refs = spark.createDataFrame([(1, 0, "Smith", "2000", "Smith, J., Jones, K.", []), (1, 1, "World Health Org", "2000", "World Health Org", ["WHO"]), (1, 2, "Lee", "2000", "Lee, A., & Ray, B.", [])], "doc_id long, ref_pos long, author string, year string, full_author string, abbreviations array<string>")
    got = {r["cite_id"]: (r["ref_pos"], r["how"]) for r in matching.match_citations(cites, refs).collect()}
    assert got == {1: (1, "smart"), 2: (0, "smart"), 3: (2, "smart"), 4: (0, "year mismatch"), 5: (None, "missing"), 6: (0, "spelling")}


def test_best_candidate(spark):
    rows = [("a title", "crossref", 1, "a title", None), ("a title", "pubmed", 2, "a title", None), ("b title", "pubmed", 3, "b title", "10.1/x"), ("b title", "crossref", 4, "b titles", "10.1/y"), ("c", "crossref", 5, "nothing like", "10.1/z"), ("d title", "crossref", 6, "d title", "10.1/z"), ("d title", "pubmed", 7, "d titla", "10.1/q")]
    got = {r["query"]: r["cand_no"] for r in matching.best_candidate(spark.createDataFrame(rows, "query string, source string, cand_no long, title string, doi string")).collect()}
    assert got == {"a title": 1, "b title": 3, "d title": 6}


def test_permission_log(spark):
    paras = [(1, 1, "Figure 1.1 A map"), (1, 2, "text"), (1, 3, "Source: Some Press"), (1, 4, "Table 2-1 Numbers"), (1, 5, "Figure 1.2 Other"), (1, 6, "Courtesy of X")] + [(2, 1, "Figure 3.1 Far")] + [(2, i, "text") for i in range(2, 11)] + [(2, 11, "Source: late")] + [(3, 1, "Box 4 Near")] + [(3, i, "text") for i in range(2, 10)] + [(3, 10, "Adapted from Y")]
    got = {(r["doc_id"], r["item_type"], r["item_no"]): (r["credit"], r["needs_permission"]) for r in captions.permission_log(spark.createDataFrame(paras, "doc_id long, para_no long, text string")).collect()}
    assert got == {(1, "Figure", "1.1"): ("Source: Some Press", "YES"), (1, "Table", "2.1"): ("", "NO"), (1, "Figure", "1.2"): ("Courtesy of X", "YES"), (2, "Figure", "3.1"): ("", "NO"), (3, "Box", "4"): ("Adapted from Y", "YES")} or got[1, "Table", "2-1"] == ("", "NO")
    assert got[1, "Figure", "1.1"] == ("Source: Some Press", "YES") and got[2, "Figure", "3.1"] == ("", "NO") and got[3, "Box", "4"][1] == "YES"


def test_caption_items(spark):
    said = ["Figure 1.2–1.4 shows", "see Tables 2.1 and 2-3", "Fig. 3a and Box 4", "Figures 1.9 to 2.1", "Table 5-6 Numbers", "nothing 7.8"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(said)], "doc_id long, para_no long, text string")
    got = {}
    for r in captions.items(rows).collect():
        got.setdefault(r["para_no"], set()).add((r["item_type"], r["item_no"], r["is_caption"]))
    f, t = "Figure", "Table"
    assert got == {0: {(f, "1.2", True), (f, "1.3", True), (f, "1.4", True)}, 1: {(t, "2.1", False), (t, "2.3", False)}, 2: {(f, "3a", True), ("Box", "4", True)}, 3: {(f, "1.9", True), (f, "2.1", True)}, 4: {(t, "5.6", True)}}


def test_lexicon(spark):
    terms = lexicon.load(spark.createDataFrame([(1, "a", "Thin"), (2, "b", "POC"), (3, "c", "Thin"), (4, "d", "too  thin")], "line_no int, category string, term string"))
    paras = spark.createDataFrame([(1, 1, "A thin cat. poc is not POC! éthin, too thin")], "doc_id long, para_no long, text string")
    got = sorted((r["category"], r["term"], r["sent_no"]) for r in lexicon.hits(text.sentences(paras), terms).collect())
    assert got == [("b", "POC", 1), ("c", "Thin", 0), ("c", "Thin", 2), ("d", "too thin", 2)]


def test_docx(spark, tmp_path):
    p = "<w:p><w:pPr><w:pStyle w:val='{}'/></w:pPr><w:r><w:t>{}</w:t></w:r>{}</w:p>"
    body = p.format("REF-N", "one", "") + "<w:tbl><w:tr><w:tc>" + p.format("T1", "cell", "") + "</w:tc></w:tr></w:tbl>" + p.format("Normal", "two", "<w:r><w:br w:type='page'/></w:r>")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'><w:body>{body}</w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    (tmp_path / "bad.docx").write_bytes(b"no package")
    got = [tuple(r)[1:] for r in read_docx(spark, f"file://{tmp_path}").orderBy("para_no").collect()]
    assert got == [(1, "REF-N", "one", False, 0), (2, "T1", "cell", True, 0), (3, "Normal", "two\n", False, 1)]


def test_docx_runs(spark, tmp_path):
    w = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"
    run = "<w:r>{}<w:t>{}</w:t></w:r>"
    runs = [("s1", "Smith"), (None, ", "), ("bib_fname", "J. "), ("bib_year", "(2001a)"), ("bib_title", "On <w:tab/>"), ("bib_journal", " Things ")]
    body = "<w:p><w:pPr><w:pStyle w:val='REF-N'/></w:pPr>" + "".join(run.format(f"<w:rPr><w:rStyle w:val='{s}'/></w:rPr>" if s else "", t.replace("<w:tab/>", "")) for s, t in runs) + "</w:p><w:p/>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}><w:style w:styleId='s1'><w:name w:val='Bib_Surname'/></w:style></w:styles>")
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    got = read_docx_runs(spark, f"file://{tmp_path}")
    assert [tuple(r)[1:4] for r in got.orderBy("run_no").collect()] == [(1, "REF-N", i) for i in range(1, 7)]
    [r] = stylerecords.records(got, ["path", "para_no"]).collect()
    assert (r["type"], [tuple(a) for a in r["author"]], r["year"], r["title"], r["container"], r["doi"], r["has_etal"]) == ("journal-article", [("J.", "Smith")], "2001", "On", "Things", None, False)


def test_style_records_edges(spark):
    rows = [
        ("none", 1, "Normal", "x"), ("none", 2, None, "y"), ("none", 3, "bib_year", ""), ("none", 4, "bib_year", None),
        ("given first", 1, "bib_fname", "J."), ("given first", 2, "bib_surname", "Smith"), ("given first", 3, "bib_surname", "son"),
        ("split", 1, "bib_surname", "A"), ("split", 2, "bib_year", "20"), ("split", 3, "bib_surname", "B"), ("split", 4, "bib_year", "01"), ("split", 5, "bib_issue", " (2) "),
        ("et al", 1, "bib_etal", "et al."), ("school", 1, "bib_school", "Here"), ("twice", 1, "bib_doi", "a"), ("twice", 1, "bib_doi", "a"),
    ]
    got = {r["id"]: r for r in stylerecords.records(spark.createDataFrame(rows, "id string, run_no int, style string, text string"), ["id"]).collect()}
    names = {k: [(a["family"], a["given"]) for a in r["author"]] for k, r in got.items()}
    assert names == {"given first": [("", "J."), ("Smithson", "")], "split": [("A", ""), ("B", "")], "et al": [("", "")] * 4, "school": [], "twice": []}
    assert (got["split"]["year"], got["split"]["issue"], got["school"]["type"], got["twice"]["doi"]) == ("2001", "2", "book", "aa")
    assert stylerecords.records(spark.createDataFrame([], "id string, run_no int, style string, text string"), ["id"]).collect() == []


def test_daily_stream(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = daily_routes(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"))
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = {(r["day"], r["route_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["day"], r["route_type"]): r["n"] for r in events.groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("route_type")).agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_entry_without_the_optional_operators(tmp_path):
    """The library imports and lists its queries with the llm folder gone, whether or not the pipeline's file is left."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/marginalia", f"{tmp_path}/marginalia", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    run = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for pipeline in ("", "import public_tokenizers\nfrom marginalia.llm import alike\nfrom marginalia.llm.common import work_path\n"):
        (tmp_path / "corpus_pipeline.py").write_text(pipeline) if pipeline else None
        out = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True)
        assert tuple(map(int, out.stdout.split()[-2:])) == (len(registry.QUERIES), len(registry.ORACLES)), out.stderr
