"""The queries of the thirteen operators, with production parameters over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chunks, decontam, linededup, middle, passages, quality, sampling, scoring, secrets, simhash, tokens
from .common import work_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.score_quality(documents(spark, sf_dir).select("doc_id", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return q.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in counts], "base_failed", "kept", "quality.n_lines", "quality.n_stop_words")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k, *_ in secrets.BASE]
    digest = F.sha2(secrets.span_text(base), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, secrets.span_text(F.col("spans")).alias("spans"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(documents(spark, sf_dir)).drop("text_key", "copy")


def op4_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    got = sampling.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_pieces", "ids_crc32", "lossless")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text_key")


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(documents(spark, sf_dir).select("doc_id", "text"), mixed_words=True)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_path(spark, "tokens")
    tokens.encode_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2, out=out)
    return tokens.decode_digests(tokens.read_files(spark, out))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.drop_boilerplate(documents(spark, sf_dir).select("doc_id", "source", "text"))
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5")
    return found.select("doc_id", "n_dropped", F.length("text").cast("long").alias("n_kept_chars"), digest)


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return centroids.assign(vectors, centroids.fit(vectors, k=16, rounds=3, dims=64, scale=64, seed=1), scale=64)


def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return passages.score(docs, passages.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality"), least=0.3)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.transform(documents(spark, sf_dir), seed=42, plain_percent=50, spm_percent=80)
    digests = [F.sha2(c, 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", middle.restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_quality_rules,
        op3_secret_scan,
        op4_sampled_segmentation,
        op5_simhash,
        op6_decontamination,
        op7_context_mixing,
        op8_token_files,
        op9_token_counts,
        op10_line_dedup,
        op11_centroids,
        op12_passage_quality,
        op13_fill_in_middle,
    )
}

def clustering_sql(k: int, rounds: int, dims: int, scale: int, seed: int) -> str:
    """Centroid clustering round by round, in integers, for whole tables of modest size."""
    steps = f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(e::DOUBLE * {scale})::HUGEINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v QUALIFY c < {k})"""
    for i in range(rounds + 1):
        steps += f""",
d{i} AS (SELECT r, c, list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::HUGEINT AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT r, arg_min(c, struct_pack(d := d, c := c)) AS c, min(d) AS d FROM d{i} GROUP BY r)"""
        if i < rounds:
            steps += f""",
e{i} AS (SELECT c, j, sum(e)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT a.c, unnest(range({dims})) AS j, unnest(v.x) AS e FROM a{i} a JOIN v USING (r)) GROUP BY c, j),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS x FROM e{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))"""
    return f"""WITH {steps}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (r) JOIN c{rounds} USING (c)"""


ORACLES: dict[str, str] = {
    "op11_centroids": clustering_sql(k=16, rounds=3, dims=64, scale=64, seed=1),
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in range(4)] AS w FROM d),
c AS (SELECT *, len(us)::BIGINT AS n, least(w[1] % (len(us) + 1), w[2] % (len(us) + 1)) AS i, greatest(w[1] % (len(us) + 1), w[2] % (len(us) + 1)) AS j FROM u),
p AS (SELECT doc_id, text, n, array_to_string(us[1:i], '') AS p, array_to_string(us[i + 1:j], '') AS m, array_to_string(us[j + 1:], '') AS s,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR w[3] % 100 >= 50 THEN 'plain' WHEN w[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p""",
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(range(len(ws) - 2)) AS i, ws FROM w WHERE len(ws) > 2),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) AS t(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: lower(rtrim(x, '.,')) IN ({', '.join(f"'{x}'" for x in dict.fromkeys(quality.STOP_WORDS))})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN r USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 3 AND 10
       AND n_symbols / n_words <= 0.1 AND n_stop_words / n_words >= 0.08 AND n_dup_lines / n_lines <= 0.4 AS kept FROM m""",
    "op10_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT row_id, source, unnest(ls) AS raw, unnest(range(len(ls))) AS i FROM d),
b AS (SELECT row_id, source, i, raw, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
bad AS (SELECT source, line FROM b WHERE line <> '' GROUP BY source, line
        HAVING count(DISTINCT row_id) >= 5 AND count(DISTINCT row_id) > 0.1 * (SELECT count(*) FROM d WHERE d.source IS NOT DISTINCT FROM b.source)),
k AS (SELECT b.*, bad.line IS NOT NULL AS gone FROM b LEFT JOIN bad ON b.line = bad.line AND b.source IS NOT DISTINCT FROM bad.source),
t AS (SELECT row_id, count(*) FILTER (WHERE gone) AS n_dropped, string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text FROM k GROUP BY row_id)
SELECT doc_id, coalesce(n_dropped, 0)::BIGINT AS n_dropped, CASE WHEN d.text IS NOT NULL THEN length(coalesce(t.text, ''))::BIGINT END AS n_kept_chars,
       md5(coalesce(t.text, '')) AS text_md5
FROM d LEFT JOIN t USING (row_id)""",
}
