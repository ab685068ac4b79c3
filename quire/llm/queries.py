"""Queries of the training-data operators over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, decontaminate, language, licenses, lines, mixing, quality_pu, simhash, sstable, suffix
from .common import crc32_of_id, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_suffix(spark: SparkSession, d: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, d, "documents"), digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op4_sstable(spark: SparkSession, d: str) -> DataFrame:
    read = sstable.token_table(table(spark, d, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    held_out = crc32_of_id() % 5 == 0
    learned = language.learn(docs.where(F.coalesce(~held_out, F.lit(True))))
    return language.identify(docs, learned).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_quality(spark: SparkSession, d: str) -> DataFrame:
    held_out = crc32_of_id() % 4 == 2
    scores = quality_pu.quality_scores(table(spark, d, "documents"), table(spark, d, "labels").where(~held_out))
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_licenses(spark: SparkSession, d: str) -> DataFrame:
    return licenses.scan(table(spark, d, "documents"))


def op9_nearest(spark: SparkSession, d: str) -> DataFrame:
    return ann.nearest(table(spark, d, "embeddings"))


def op10_lines(spark: SparkSession, d: str) -> DataFrame:
    left = lines.remove_repeated_lines(table(spark, d, "documents"))
    return left.select("doc_id", "n_lines", "n_deleted", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_decontaminate, op2_simhash, op3_suffix, op4_sstable, op5_language, op6_quality, op7_mix, op8_licenses, op9_nearest, op10_lines)
    return {f.__name__: f for f in all_}


#: A line goes if it lies in a run of eight words or more that also starts earlier. A run of that many
#: words is made of the shortest such runs that start, and those that end, at its lines.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
c AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
w AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM c),
f AS (SELECT w.doc_id, w.pos AS a, e.pos AS b FROM w ASOF JOIN (SELECT * FROM w WHERE n > 0) e ON w.doc_id = e.doc_id AND w.upto - w.n + 8 <= e.upto),
g AS (SELECT w.doc_id, s.pos AS a, w.pos AS b FROM w ASOF JOIN (SELECT *, upto - n AS before FROM w WHERE n > 0) s ON w.doc_id = s.doc_id AND w.upto - 8 >= s.before),
r AS (SELECT doc_id, a, b, 'f' AS kind FROM f UNION ALL SELECT doc_id, a, b, 'g' FROM g),
t AS (SELECT r.doc_id, a, b, min((r.doc_id, a)) OVER (PARTITION BY kind, list_slice(d.lines, a, b)) AS first FROM r JOIN d USING (doc_id)),
x AS (SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM t WHERE (doc_id, a) > first)
SELECT documents.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_deleted, 0) AS n_deleted, m.kept_md5 FROM documents LEFT JOIN (
  SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_deleted, md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL), '')) AS kept_md5
  FROM l LEFT JOIN x USING (doc_id, pos) GROUP BY l.doc_id) m USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_lines": OP10_SQL}
