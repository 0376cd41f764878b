"""Readers of lexicons, caches and pages."""

import pytest

from marginalia.sources.texts import read_cache, read_html, read_lexicon


def test_lexicon(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Term , CATEGORY\n thin , body\n,none\n\"a, b\",x\nthin,again\n".encode())
    rows = read_lexicon(spark, f"file://{tmp_path}/a.csv").orderBy("line_no").collect()
    assert [(r["category"], r["term"]) for r in rows] == [("body", "thin"), ("x", "a, b"), ("again", "thin")]
    (tmp_path / "b.csv").write_text("word,kind\na,b\n")
    with pytest.raises(ValueError, match="needs the columns"):
        read_lexicon(spark, f"file://{tmp_path}/b.csv")


def test_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"key":"a","value":"1"}\nbroken\n{"value":"2"}\n{"key":"b","value":null}\n')
    assert {tuple(r) for r in read_cache(spark, f"file://{tmp_path}/c.json").collect()} == {("a", "1"), ("b", None)}


def test_pages_in_many_character_sets(spark, tmp_path):
    text = "<p>café ß</p>"
    meta = "<meta charset='{}'>"
    files = {
        "plain.html": text.encode(), "mark.html": ("﻿" + text).encode(), "wide.htm": text.encode("utf-16"), "latin.html": text.encode("latin-1"),
        "said.html": (meta.format("ISO-8859-1") + text).encode("latin-1"), "utf.html": (meta.format("utf-8") + text).encode(), "odd.html": (meta.format("x-odd") + text).encode(), "no.txt": b"x",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    got = {r["path"].rsplit("/", 1)[1]: r["html"] for r in read_html(spark, f"file://{tmp_path}").collect()}
    assert got.keys() == files.keys() - {"no.txt"} and all(h.endswith(text) for h in got.values())


def test_sets_of_one_byte_a_character(spark):
    from marginalia.sources import texts

    every = bytes(range(128, 256))
    rows = spark.createDataFrame([(n, f'<meta charset="{n}">'.encode() + every) for n in texts.ONE_BYTE] + [("none", None)], "name string, content binary")
    got = {r.name: r.html for r in rows.select("name", texts.decoded(rows.content).alias("html")).collect()}
    for name, codec in texts.ONE_BYTE.items():
        assert got[name] == f'<meta charset="{name}">' + every.decode(codec, errors="replace")
    assert got["none"] is None
