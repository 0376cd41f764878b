"""The source of Word packages: nested tables, broken files, tasks by size, a stream of files."""

import io
import zipfile

from marginalia.sources import docx

NAMESPACE = "xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'"


def package(body, **parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NAMESPACE}>{body}</w:document>")
        for name, text in parts.items():
            z.writestr(f"word/{name}.xml", text)
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def test_nested_tables_in_order(spark):
    table = lambda inner: f"<w:tbl><w:tr><w:tc>{inner}</w:tc><w:tc>{p('next')}</w:tc></w:tr></w:tbl>"
    deep = "".join(["<w:tbl><w:tr><w:tc>"] * 2000) + p("deep") + "".join(["</w:tc></w:tr></w:tbl>"] * 2000)
    rows = [("a", package(f"<w:body>{p('one')}{table(p('in') + table(p('inner')))}{p('two')}</w:body>")), ("b", package(f"<w:body>{deep}</w:body>")), ("e", package("<w:body/>"))]
    found = docx.packages(spark.createDataFrame([(*r, 1) for r in rows], "path string, content binary, error int")).cache()
    got = {(r["path"], r["para_no"]): (r["text"], r["depth"]) for r in docx.paragraphs(found).collect()}
    assert got == {("a", 1): ("one", 0), ("a", 2): ("in", 1), ("a", 3): ("inner", 2), ("a", 4): ("next", 2), ("a", 5): ("next", 1), ("a", 6): ("two", 0), ("b", 1): ("deep", 2000)}
    assert [r["text"] for r in docx.body_texts(found).orderBy("para_no").collect()] == ["one", "two"]
    assert [r["text"] for r in docx.table_texts(found).orderBy("para_no").collect()] == ["one", "in", "next", "two"]
    assert {r["path"] for r in docx.media(found).collect()} == {"a", "b", "e"}


def test_broken_packages_are_rows(spark):
    no_document = io.BytesIO()
    with zipfile.ZipFile(no_document, "w") as z:
        z.writestr("x", "y")
    whole = package(f"<w:body>{p('x' * 500)}</w:body>")
    rows = [("text", b"no package"), ("none", None), ("empty", b""), ("other", no_document.getvalue()), ("xml", package("<w:body>")), ("no body", package("")), ("cut", whole[:-30]), ("ok", whole), ("ok", whole)]
    found = docx.packages(spark.createDataFrame(rows, "path string, content binary")).cache()
    assert sorted(r["path"] for r in found.where("error IS NULL").collect()) == ["ok", "ok"]
    assert found.where("error IS NOT NULL AND paragraphs IS NULL").count() == 7 and docx.paragraphs(found).count() == 2 == docx.media(found).count()
    assert docx.packages(spark.createDataFrame([], "path string, content binary")).collect() == []


def test_the_format_plans_by_size_and_equals_the_binary_files(spark, tmp_path):
    notes = f"<w:comments {NAMESPACE}><w:comment>{p('said')}</w:comment></w:comments>"
    for i in range(6):
        folder = tmp_path / ("sub" if i % 2 else "top")
        folder.mkdir(exist_ok=True)
        (folder / f"{i}.docx").write_bytes(package(f"<w:body>{p(i)}{p('&lt;')}</w:body>", comments=notes))
    (tmp_path / "bad.docx").write_bytes(b"no package")
    (tmp_path / "empty.docx").write_bytes(b"")
    (tmp_path / "no.txt").write_bytes(b"")
    docx.register(spark)
    load = lambda **o: spark.read.format("docx").options(**o).load(str(tmp_path))
    assert load(task_bytes=1).rdd.getNumPartitions() == 8 and load().rdd.getNumPartitions() == 1
    got, want = load(task_bytes=1000), docx.packages(docx.binary_files(spark.read, f"file://{tmp_path}"))
    parts = lambda d: sorted(d.selectExpr("split(path, '/')[size(split(path, '/')) - 1] AS f", "to_json(struct(paragraphs, comments, images, footnotes, sections, error))").collect())
    empty = [r for r in parts(got) if r["f"] == "empty.docx"]
    assert len(empty) == 1 and parts(got) == sorted(parts(want) + empty) and len(parts(want)) == 7  # Spark's binary files leave out those without bytes
    assert [r["text"] for r in docx.comments(got).collect()] == ["said"] * 6


def test_a_stream_of_files_reads_each_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()

    def pour(name):
        (source / name).write_bytes(package(f"<w:body>{p(name)}</w:body>"))
        stream = docx.paragraphs(docx.packages(docx.binary_files(spark.readStream, f"file://{source}"))).select("text")
        run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        assert run.awaitTermination(120) and run.exception() is None
        return sorted(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert pour("a.docx") == ["a.docx"]
    assert pour("b.docx") == ["a.docx", "b.docx"]


def test_readers_without_runs_make_none(spark):
    files = spark.createDataFrame([("a", package(f"<w:body>{p('one')}<w:tbl><w:tr><w:tc>{p('two')}</w:tc></w:tr></w:tbl></w:body>"))], "path string, content binary")
    bare, whole = docx.packages(files, with_runs=False), docx.packages(files)
    assert "runs" not in bare.schema.simpleString() and docx.runs(whole).count() == 2
    assert docx.paragraphs(bare).collect() == docx.paragraphs(whole).collect()
