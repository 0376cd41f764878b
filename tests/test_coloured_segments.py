"""Coloured segments come from sorted rows alone: no join brings edges to runs or texts back to segments."""

from marginalia.operators import segments

RUN, SPAN = "doc_id long, para_no long, run_no long, text string", "doc_id long, para_no long, start long, end long, colour string"


def test_no_join_and_null_keys(spark):
    runs = spark.createDataFrame([(None, 1, 0, "abcd"), (None, 1, 1, "efgh"), (1, 1, 0, "xy")], RUN)
    spans = spark.createDataFrame([(None, 1, 2, 6, "cyan"), (None, 1, 4, 5, "yellow"), (1, 1, 0, 9, "green"), (1, 1, 1, 1, "yellow")], SPAN)
    out = segments.coloured(runs, spans)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r["doc_id"] or 0, r["run_no"], r["seg_no"], r["text"], r["colour"]) for r in out.collect()), key=lambda r: r[:3])
    assert got == [(0, 0, 0, "ab", None), (0, 0, 1, "cd", "cyan"), (0, 1, 0, "e", "yellow"), (0, 1, 1, "f", "cyan"), (0, 1, 2, "gh", None), (1, 0, 0, "xy", "green")]
