"""Short words of documents in any script, against brute force."""

import re

from marginalia.plans import registry


def test_short_words_of_every_document(spark, tmp_path):
    texts = {1: "a café is für you_ me", 2: None, 3: "", 4: "élan an naïve x1 end", 5: "東a京 of B"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n"] for r in registry.QUERIES["fn78_short_words"](spark, str(tmp_path)).collect()}
    assert got == {d: len(re.findall(r"\b[A-Za-z]{1,4}\b", t or "")) for d, t in texts.items()}
