"""Word documents as rows: each package is unpacked once, into its paragraphs in order, those of tables too, with their runs,
styles and marks, its comments, and what it has of images, notes and sections.

`packages` takes files as binary rows, so any store will do, and Spark's own stream of files; `spark.read.format("docx")`, after
`register`, plans its tasks by the files' sizes. What can't be read is a row that says why in `error`, with null parts; null content
is one too. No files give no rows. Files of equal names are rows each. The readers of parts are projections of `packages`.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType

from marginalia.sources.shipping import ship

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
IMAGES = "/relationships/image"
RUN = "struct<run_no:bigint,style:string,text:string,highlighted:boolean,italic:boolean,struck:boolean,hidden:boolean>"
PARAGRAPH = f"struct<para_no:bigint,style:string,text:string,depth:int,page_breaks:bigint,runs:array<{RUN}>>"
COMMENT = "struct<comment_no:bigint,author:string,text:string>"
PACKAGE = f"path string, paragraphs array<{PARAGRAPH}>, comments array<{COMMENT}>, images long, footnotes long, endnotes long, sections long, error string"
RUNLESS = PACKAGE.replace(f",runs:array<{RUN}>", "")

# The same as Arrow has it, so that rows go to Spark without a frame of objects between.
_RUN = pa.struct({"run_no": pa.int64(), "style": pa.string(), "text": pa.string(), "highlighted": pa.bool_(), "italic": pa.bool_(), "struck": pa.bool_(), "hidden": pa.bool_()})
_PARAGRAPH = {"para_no": pa.int64(), "style": pa.string(), "text": pa.string(), "depth": pa.int32(), "page_breaks": pa.int64()}
_COMMENT = pa.struct({"comment_no": pa.int64(), "author": pa.string(), "text": pa.string()})
_COUNTS = {name: pa.int64() for name in ("images", "footnotes", "endnotes", "sections")}
#: Bytes of packages whose rows a task holds at once, as packed texts grow when unpacked; a larger package is held alone.
HELD = 1 << 20
UNREADABLE = (zipfile.BadZipFile, KeyError, ElementTree.ParseError, zlib.error, EOFError, NotImplementedError, RuntimeError, UnicodeDecodeError, AttributeError)


def text_under(node) -> str:
    return "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in node.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def style_of(node, kind: str) -> str | None:
    """The id of a paragraph's (p) or run's (r) style."""
    style = node.find(f"{W}{kind}Pr/{W}{kind}Style")
    return style.get(f"{W}val") if style is not None else None


def is_on(node, *names: str) -> bool:
    """Whether a run has one of these properties, and not turned off."""
    found = (node.find(f"{W}rPr/{W}{n}") for n in names)
    return any(p is not None and p.get(f"{W}val") not in ("0", "false", "none") for p in found)


def body_paragraphs(body) -> Iterator[tuple]:
    """(paragraph node, tables around it) in document order, whatever the depth of tables."""
    left = [(child, 0) for child in reversed(body)]
    while left:
        node, depth = left.pop()
        if node.tag == f"{W}p":
            yield node, depth
        elif node.tag in (f"{W}tbl", f"{W}tr", f"{W}tc"):
            left += [(child, depth + (node.tag == f"{W}tbl")) for child in reversed(node)]


def run_of(number: int, run, names: dict) -> tuple:
    style = style_of(run, "r")
    return number, names.get(style, style), text_under(run), is_on(run, "highlight"), is_on(run, "i"), is_on(run, "strike", "dstrike"), is_on(run, "vanish")


def paragraph_of(number: int, p, depth: int, names: dict, with_runs: bool = True) -> tuple:
    breaks = sum(b.get(f"{W}type") == "page" for b in p.iter(f"{W}br")) + sum(1 for _ in p.iter(f"{W}lastRenderedPageBreak"))
    own = number, style_of(p, "p") or "Normal", text_under(p), depth, breaks
    return (*own, [run_of(j, run, names) for j, run in enumerate(p.findall(f"{W}r"), 1)]) if with_runs else own


def package(path: str, content: bytes | None, with_runs: bool = True) -> tuple:
    """The columns of `PACKAGE` (or `RUNLESS`) for one file, from one unpacking."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            has = set(z.namelist())
            part = lambda name: ElementTree.fromstring(z.read(name)) if name in has else ()
            document = ElementTree.fromstring(z.read("word/document.xml"))
            styles, comments, links = part("word/styles.xml"), part("word/comments.xml"), part("word/_rels/document.xml.rels")
        body = document.find(f"{W}body")
        if body is None:
            raise KeyError("no body")
        named = ((s.get(f"{W}styleId"), s.find(f"{W}name")) for s in (styles.iter(f"{W}style") if len(styles) else ()))
        names = {k: n.get(f"{W}val") for k, n in named if n is not None}
        paragraphs = [paragraph_of(i, p, depth, names, with_runs) for i, (p, depth) in enumerate(body_paragraphs(body), 1)]
        said = enumerate(comments.iter(f"{W}comment") if len(comments) else (), 1)
        notes = [(i, c.get(f"{W}author", "Unknown"), "".join(t.text or "" for t in c.iter(f"{W}t"))) for i, c in said]
        count = lambda tag: sum(1 for _ in document.iter(f"{W}{tag}"))
        images = sum(r.get("Type", "").endswith(IMAGES) for r in links)
        return path, paragraphs, notes, images, count("footnoteReference"), count("endnoteReference"), count("sectPr"), None
    except UNREADABLE as why:
        return path, None, None, None, None, None, None, f"{type(why).__name__}: {why}"


def packages(files: DataFrame, with_runs: bool = True) -> DataFrame:
    """A row of `PACKAGE` for each of the `files` (path, content), of `RUNLESS` for readers that ask for no runs; a stream of files gives a stream."""
    paragraph = pa.struct(_PARAGRAPH | ({"runs": pa.list_(_RUN)} if with_runs else {}))
    schema = pa.schema({"path": pa.string(), "paragraphs": pa.list_(paragraph), "comments": pa.list_(_COMMENT)} | _COUNTS | {"error": pa.string()})

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = lambda out: pa.record_batch([pa.array(values, f.type) for values, f in zip(zip(*out, strict=True), schema, strict=True)], schema)
        for b in batches:
            out, size = [], 0
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                content = content.as_py()
                out.append(package(path.as_py(), content, with_runs))
                size += len(content or b"")
                if size > HELD:
                    yield together(out)
                    out, size = [], 0
            if out:
                yield together(out)

    return files.select("path", "content").mapInArrow(rows, PACKAGE if with_runs else RUNLESS)


def binary_files(reader, path: str) -> DataFrame:
    """The .docx files below `path` as binary rows; `reader` is spark.read, or spark.readStream, which remembers the files it has seen.

    Spark leaves out files without bytes here; the format `docx` has them as rows with an error.
    """
    columns = "path string, modificationTime timestamp, length long, content binary"
    return reader.format("binaryFile").schema(columns).option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)


def paragraphs(found: DataFrame) -> DataFrame:
    """A row for each paragraph of `packages`, in or out of tables, whose depth counts the tables around it."""
    return found.select("path", F.inline("paragraphs")).drop("runs").withColumn("in_table", F.col("depth") > 0)


def body_texts(found: DataFrame) -> DataFrame:
    """(path, para_no, text) of the paragraphs outside tables."""
    return paragraphs(found).where("depth = 0").select("path", "para_no", "text")


def table_texts(found: DataFrame) -> DataFrame:
    """(path, para_no, in_table, text) of the paragraphs outside tables and right in their cells, not in tables of cells."""
    return paragraphs(found).where("depth <= 1").select("path", "para_no", "in_table", "text")


def runs(found: DataFrame) -> DataFrame:
    """A row for each run right below a paragraph, with its style by name and its marks."""
    each = found.select("path", F.explode("paragraphs").alias("p"))
    return each.select("path", "p.para_no", F.col("p.style").alias("para_style"), F.inline("p.runs"))


def comments(found: DataFrame) -> DataFrame:
    """(path, comment_no, author, text, page): a package has no pages before it is laid out, so the page points to the context."""
    return found.select("path", F.inline("comments")).withColumn("page", F.lit("See Context"))


def media(found: DataFrame) -> DataFrame:
    """(path, images, footnotes, endnotes, sections) of each readable package: notes as its body refers to them."""
    return found.where("error IS NULL").select("path", "images", "footnotes", "endnotes", "sections")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """A row for each paragraph of every .docx below `path`."""
    return paragraphs(packages(binary_files(spark.read, path))).select("path", "para_no", "style", "text", "in_table", "page_breaks")


def read_docx_marks(spark: SparkSession, path: str) -> DataFrame:
    """A row for each run of every .docx below `path`, with how it is marked."""
    return runs(packages(binary_files(spark.read, path))).select("path", "para_no", "run_no", "text", "highlighted", "italic", "struck", "hidden")


def read_docx_comments(spark: SparkSession, path: str) -> DataFrame:
    """A row for each comment of every .docx below `path`."""
    return comments(packages(binary_files(spark.read, path))).select("path", "comment_no", "author", "text")


def read_docx_media(spark: SparkSession, path: str) -> DataFrame:
    """A row for every .docx below `path`: its images, notes and sections."""
    return media(packages(binary_files(spark.read, path)))


def read_docx_runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each run of every .docx below `path`."""
    return runs(packages(binary_files(spark.read, path))).select("path", "para_no", "para_style", "run_no", "style", "text")


class Files(InputPartition):
    """The files of one task."""

    def __init__(self, paths: list[str]):
        self.paths = paths


class DocxReader(DataSourceReader):
    def __init__(self, path: str, task_bytes: int):
        self.path, self.task_bytes = path, task_bytes

    def partitions(self) -> list[Files]:
        """Files in the order of their paths, as many to a task as stay within `task_bytes`; a larger one is a task."""
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(top, recursive=True)) if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        tasks, room = [], 0
        for f in sorted(found, key=lambda f: f.path):
            if f.type == fs.FileType.File and f.path.endswith(".docx"):
                if f.size > room or not tasks:
                    tasks.append([])
                    room = self.task_bytes
                tasks[-1].append(f.path)
                room -= f.size
        return [Files(t) for t in tasks] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            yield package(path, content)


class DocxSource(DataSource):
    """`docx`: the packages below a path that driver and executors see (a URI or an absolute path), one row each, as `PACKAGE` says.

    Option `task_bytes` (32 MB): how much of packed files one task takes.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return PACKAGE

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"], int(self.options.get("task_bytes", 1 << 25)))


def register(spark: SparkSession) -> SparkSession:
    """`spark` with the format `docx`."""
    ship(spark).dataSource.register(DocxSource)
    return spark


@F.pandas_udf(BinaryType())
def packed(document: pd.Series, comments: pd.Series) -> pd.Series:
    """A package of the XML of a document and of its comments; null if there is no document."""

    def one(body: str | None, notes: str | None) -> bytes | None:
        if body is None:
            return None
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", body)
            if notes is not None:
                z.writestr("word/comments.xml", notes)
        return out.getvalue()

    return pd.Series([one(b, n) for b, n in zip(document, comments, strict=True)])
