"""Queries of the page-text operators over whole tables, each with the SQL that gives the same rows
where SQL can. Tables stand in for page logs, result logs and usage logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, response, text
from ..operators import assemble, evaluate, log, reconcile, select, usage
from ..sources.html import html_text

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a small file over all cores, for work that is heavy by row."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows._jdf.rdd().getNumPartitions() < cores else rows


def ascii_(c: str | Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as a page log with placeholders at some turns."""
    x = F.col("turn") % 5
    said = F.when(x == 1, "page.png: [No transcribable text]").when(x == 2, "[transcription error; status 500]").when(x == 3, "[Transcription not possible]").otherwise(F.col("text"))
    return t(spark, d, "conversations").withColumn("text", said)


TURNS = """turns AS (SELECT conv_id, turn, role, CASE turn % 5 WHEN 1 THEN 'page.png: [No transcribable text]'
  WHEN 2 THEN '[transcription error; status 500]' WHEN 3 THEN '[Transcription not possible]' ELSE text END AS text FROM conversations)"""
CAUSE = r"""CASE WHEN regexp_matches(trim(text), '(?i)^(?:[^\[]+?:\s*)?\[\s*transcription\s+error[^\n]*\]$') THEN 'api_error'
  WHEN regexp_matches(trim(text), '(?i)^(?:[^\[]+?:\s*)?\[\s*no\s+transcribable\s+text[^\n]*\]$') THEN 'no_text'
  WHEN regexp_matches(trim(text), '(?i)^(?:[^\[]+?:\s*)?\[\s*transcription\s+not\s+possible[^\n]*\]$') THEN 'not_possible' ELSE 'ok' END"""
SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS n_chars, sum(CASE WHEN {SQUEEZED} = '' THEN 0 ELSE len(string_split({SQUEEZED}, ' ')) END)::BIGINT AS n_words FROM documents GROUP BY ALL")
def flagship(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"), F.sum(F.size(text.words(F.col("text")))).alias("n_words"))


@query(f"SELECT doc_id, md5({SQUEEZED}) AS squeezed FROM documents")
def d12_collapse(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(text.collapse(F.col("text")).cast("binary")).alias("squeezed"))


@query(r"SELECT doc_id, md5(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b-\x1f\x7f]', '', 'g')) AS cleaned FROM documents")
def d1_unicode_clean(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(text.unicode_clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(r"SELECT doc_id, md5(regexp_replace(replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), ', ', '-' || chr(10)), '(\w{2,}[a-z])-\n([a-z]\w+)|(\w{3,}-\n\w{2,})', '\1\2\3', 'g')) AS joined FROM documents")
def d2_dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    broken = F.replace(F.lower(ascii_("text")), F.lit(", "), F.lit("-\n"))
    return t(spark, d, "documents").select("doc_id", F.md5(text.dehyphenate(broken).cast("binary")).alias("joined"))


@query(r"""WITH a AS (SELECT doc_id, string_split(chr(10) || chr(10) || chr(10) || replace(replace(text, '. ', '.    ' || chr(10) || '  ' || chr(10) || chr(10) || chr(10) || 'x   y '), ', ', ',' || chr(9)) || chr(10) || chr(10) || chr(10) || chr(10), chr(10)) AS l FROM documents),
b AS (SELECT doc_id, list_transform(l[:len(l) - 1], lambda x: regexp_replace(rtrim(list_reduce(string_split(x, chr(9)), lambda p, q: p || repeat(' ', 4 - length(p) % 4) || q), ' '), '([^ ]) {2,}', '\1  ', 'g')) AS l FROM a),
c AS (SELECT doc_id, list_transform(l, lambda x: CASE WHEN trim(x) = '' THEN '' ELSE x END) AS l FROM b),
d AS (SELECT doc_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN l[i] = '' AND i > 2 AND l[i - 1] = '' AND l[i - 2] = '' THEN NULL ELSE l[i] END), lambda x: x IS NOT NULL) AS l FROM c)
SELECT doc_id, md5(array_to_string(l, chr(10)) || chr(10)) AS spaced FROM d""")
def d3_spacing(spark: SparkSession, d: str) -> DataFrame:
    loose = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".    \n  \n\n\nx   y ")), F.lit(", "), F.lit(",\t"))
    return t(spark, d, "documents").select("doc_id", F.md5(text.spacing(F.concat(F.lit("\n\n\n"), loose, F.lit("\n\n\n\n"))).cast("binary")).alias("spaced"))


@query()
def d5_d6_wrapped(spark: SparkSession, d: str) -> DataFrame:
    w = text.postprocess(F.col("text"), merge_hyphens=True, wrap_width="auto")
    return spread(t(spark, d, "documents")).select("doc_id", w.alias("wrapped"))


@query("SELECT doc_id, md5(trim(regexp_replace(list_aggregate(list_transform(string_split(text, chr(10)), lambda x: trim(x)), 'string_agg', chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS lines FROM documents")
def d10_extractor_lines(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", F.md5(text.extractor_lines(F.col("text")).cast("binary")).alias("lines"))


@query()
def d14_d15_formatting(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.size(v).alias(f"n_{k}") for k, v in text.formatting(F.col("text")).items()]
    return t(spark, d, "documents").select("doc_id", F.length(text.strip_formatting(F.col("text"))).alias("content_chars"), *counts)


@query(f"WITH {TURNS} SELECT conv_id, turn, {CAUSE} AS cause FROM turns")
def c10_cause(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).select("conv_id", "turn", text.cause(F.col("text")).alias("cause"))


@query(f"WITH {TURNS} SELECT role, count(*) FILTER (starts_with(lower(ltrim(text)), '[transcription error')) AS n_failed, count(*) AS n FROM turns GROUP BY role")
def c6_failed_pages(spark: SparkSession, d: str) -> DataFrame:
    return turns(spark, d).groupBy("role").agg(F.count_if(text.is_error_placeholder(F.col("text"))).alias("n_failed"), F.count("*").alias("n"))


@query(f"WITH {TURNS} SELECT conv_id, md5(string_agg(CASE WHEN {CAUSE} = 'ok' THEN trim(text, E' \\n\\t') ELSE 'page_' || turn || '.png: ' || trim(text) END, chr(10) ORDER BY turn)) AS joined, count(*) AS n_pages FROM turns GROUP BY conv_id")
def b6_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = turns(spark, d).select("conv_id", "text", F.concat(F.lit("page_"), F.col("turn").cast("string"), F.lit(".png")).alias("image_name"), (F.col("turn") + 1).alias("page_number"), F.col("turn").alias("order_key"))
    return assemble.documents(pages, ["conv_id"]).select("conv_id", F.md5(F.col("text").cast("binary")).alias("joined"), "n_pages")


@query()
def b8_json_documents(spark: SparkSession, d: str) -> DataFrame:
    pages = turns(spark, d).select("conv_id", "text", F.col("role").alias("image_name"), (F.col("turn") + 1).alias("page_number"), F.col("turn").alias("order_key"))
    return assemble.json_documents(pages, ["conv_id"])


def page_log(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as raw log lines: a session line, then every turn, even ones a second time."""
    c = t(spark, d, "conversations")
    page = lambda x: F.to_json(F.struct(F.concat(F.lit("p"), F.col("turn").cast("string")).alias("image_name"), x.alias("text_chunk"), F.col("turn").cast("int").alias("order_index")))
    once = c.select(F.col("conv_id").cast("string").alias("source"), (F.col("turn") + 1).cast("int").alias("line_no"), page(F.col("text")).alias("raw"))
    again = c.where("turn % 2 = 0").select(F.col("conv_id").cast("string").alias("source"), (F.col("turn") + 1001).cast("int").alias("line_no"), page(F.concat(F.lit("again "), F.col("text"))).alias("raw"))
    session = c.select(F.col("conv_id").cast("string").alias("source")).distinct().select("source", F.lit(0).alias("line_no"), F.lit('{"batch_session": {"status": "submitted", "provider": "google"}}').alias("raw"))
    tracked = c.select(F.col("conv_id").cast("string").alias("source")).distinct().select("source", F.lit(5000).alias("line_no"), F.concat(F.lit('{"batch_tracking": {"batch_id": "b'), F.col("source"), F.lit('"}}')).alias("raw"))
    bad = session.select("source", F.lit(6000).alias("line_no"), F.lit('{"cut off').alias("raw"))
    return once.unionAll(again).unionAll(session).unionAll(tracked).unionAll(bad)


@query("""SELECT conv_id::VARCHAR AS source, kind, count(*) AS n FROM (SELECT conv_id, 'page' AS kind FROM conversations UNION ALL SELECT conv_id, 'page' FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT DISTINCT conv_id, unnest(['batch_session', 'batch_tracking', 'reject']) FROM conversations) GROUP BY ALL""")
def c1_record_kinds(spark: SparkSession, d: str) -> DataFrame:
    return log.kinds(page_log(spark, d)).groupBy("source", "kind").agg(F.count("*").alias("n"))


@query("SELECT conv_id::VARCHAR AS source, 'p' || turn AS image_name, md5(CASE WHEN turn % 2 = 0 THEN 'again ' || text ELSE text END) AS text, turn::INT + 1 AS first_pos FROM conversations")
def g1_last_per_image(spark: SparkSession, d: str) -> DataFrame:
    return log.last_per_image(log.pages(page_log(spark, d))).select("source", "image_name", F.md5(F.col("text_chunk").cast("binary")).alias("text"), "first_pos")


@query("SELECT conv_id::VARCHAR AS source, md5(string_agg(trim(CASE WHEN turn % 2 = 0 THEN 'again ' || text ELSE text END, E' \\n\\t'), chr(10) ORDER BY turn)) AS joined, count(*) AS n_pages FROM conversations GROUP BY conv_id")
def b10_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return assemble.rebuild(log.pages(page_log(spark, d))).select("source", F.md5(F.col("text").cast("binary")).alias("joined"), "n_pages")


@query("SELECT conv_id::VARCHAR AS source, 'b' || conv_id AS batch_ids, 'google' AS provider, 'submitted' AS status, count(*) + count(*) FILTER (turn % 2 = 0) AS n_pages, 1::BIGINT AS n_rejects, true AS is_batch_log FROM conversations GROUP BY conv_id")
def i18_file_summary(spark: SparkSession, d: str) -> DataFrame:
    return log.file_summary(page_log(spark, d)).select("source", F.array_join("batch_ids", ",").alias("batch_ids"), "provider", "status", "n_pages", "n_rejects", "is_batch_log")


@query("SELECT event_id, user_id FROM events e WHERE event_id > coalesce((SELECT max(event_id) FROM events f WHERE f.user_id = e.user_id AND f.event_type = 'error'), -1)")
def g5_after_last_marker(spark: SparkSession, d: str) -> DataFrame:
    return log.after_last(t(spark, d, "events"), F.col("event_type") == "error", "user_id", "event_id").select("event_id", "user_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f4_pending(spark: SparkSession, d: str) -> DataFrame:
    done = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return log.pending(t(spark, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("""SELECT user_id::VARCHAR AS custom_id, event_id AS seq, event_type = 'error' AS is_error FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'error', event_id DESC) = 1""")
def g2_one_per_id(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select(F.col("user_id").cast("string").alias("custom_id"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("is_error"))
    return reconcile.one_per_id(e, [])


@query("SELECT o_orderkey AS custom_id, o_orderstatus, l_partkey FROM orders LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) = 1) ON l_orderkey = o_orderkey")
def f2_with_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("custom_id"), F.struct("l_linenumber", "l_partkey").alias("line_no"), "l_partkey")
    return reconcile.with_metadata(t(spark, d, "orders").select(F.col("o_orderkey").alias("custom_id"), "o_orderstatus"), meta)


@query("SELECT c_custkey AS custom_id, '[transcription error; no result for this request]' AS transcription FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def f3_missing(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.missing(t(spark, d, "customer").select(F.col("c_custkey").alias("custom_id")), t(spark, d, "orders").select(F.col("o_custkey").alias("custom_id")), ["custom_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 1 WHEN o_orderkey % 4 = 2 THEN 2 ELSE 3 END AS tier, CASE o_orderkey % 4 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey + 5 WHEN 2 THEN o_custkey ELSE o_orderkey END AS value FROM orders")
def k2_order_key(spark: SparkSession, d: str) -> DataFrame:
    x, key = F.col("o_orderkey") % 4, F.col("o_custkey")
    o = t(spark, d, "orders").select("o_orderkey", F.when(x == 0, key).alias("i"), F.when(x == 1, key + 5).alias("p"), F.when(x == 2, F.concat(F.lit("req-"), (key + 1).cast("string"))).otherwise("other").alias("c"))
    return o.select("o_orderkey", reconcile.order_key(F.col("i"), F.col("p"), F.col("c"), F.col("o_orderkey")).alias("k")).select("o_orderkey", "k.tier", "k.value")


@query("""WITH o AS (SELECT l_orderkey, list(l_quantity::BIGINT ORDER BY l_linenumber, l_partkey, l_quantity) AS q FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, list_reduce(q, lambda a, x: CASE WHEN a // 1000000 % 1000 > 0 AND (a // 1000000 % 1000 >= 3 OR a % 1000000 + x > 60) THEN (a // 1000000000 + 1) * 1000000000 + 1000000 + x ELSE a + 1000000 + x END, 1000000000) // 1000000000 AS n_parts FROM o""")
def j6_pack(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).cast("long").alias("seq"), F.col("l_quantity").cast("long").alias("bytes"))
    return reconcile.pack(r, ["l_orderkey"], 3, 60).groupBy("l_orderkey").agg(F.max("part").cast("long").alias("n_parts"))


@query(f"""WITH {TURNS}, x AS (SELECT conv_id, string_agg(replace(text, chr(10), ' '), chr(10) ORDER BY turn) AS text FROM turns GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_index FROM x)
SELECT conv_id, line_index, {CAUSE} AS cause, CASE WHEN {CAUSE} = 'no_text' THEN 'page.png' END AS image_name FROM l WHERE {CAUSE} <> 'ok'""")
def c11_failure_lines(spark: SparkSession, d: str) -> DataFrame:
    flat = turns(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit(" ")))
    docs = flat.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda p: p["text"]), "\n").alias("text"))
    return reconcile.failure_lines(docs, ["conv_id"], no_text=True).select("conv_id", F.col("line_index").cast("long").alias("line_index"), "cause", "image_name")


@query("SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN 'new ' || text ELSE text END) AS line FROM conversations")
def f7_patch(spark: SparkSession, d: str) -> DataFrame:
    lines = t(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    fixed = lines.where("turn % 3 = 0").select("conv_id", "turn", F.concat(F.lit("new "), F.col("line")).alias("line"))
    return reconcile.patch(lines, fixed, ["conv_id", "turn"]).select("conv_id", "turn", F.md5(F.col("line").cast("binary")).alias("line"))


@query("SELECT DISTINCT l_suppkey AS batch_id, true AS tracked FROM lineitem WHERE l_shipdate < '1995-01-01' UNION SELECT s_suppkey, false FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < '1995-01-01')")
def f9_recovered(spark: SparkSession, d: str) -> DataFrame:
    tracked = t(spark, d, "lineitem").where("l_shipdate < '1995-01-01'").select(F.col("l_suppkey").alias("batch_id")).distinct()
    return reconcile.recovered(tracked, t(spark, d, "supplier").select(F.col("s_suppkey").alias("batch_id")))


@query("""SELECT coalesce(h.conv_id, r.conv_id) AS conv_id, coalesce(h.turn, r.turn) AS turn, CASE WHEN r.turn IS NULL THEN 'No ground truth for page' WHEN h.turn IS NULL THEN 'No model output for page' ELSE 'OK' END AS status
FROM (SELECT * FROM conversations WHERE turn % 3 > 0) h FULL JOIN (SELECT * FROM conversations WHERE turn % 5 > 0) r ON h.conv_id = r.conv_id AND h.turn = r.turn""")
def f1_align(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").withColumn("line_no", F.lit(0))
    return evaluate.align(c.where("turn % 3 > 0"), c.where("turn % 5 > 0"), ["conv_id", "turn"]).select("conv_id", "turn", "status")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pages of all documents against two damaged versions of them."""
    pages = assemble.split_pages(spread(t(spark, d, "documents").select("doc_id", "lang", ascii_("text").alias("text"))), ["doc_id", "lang"], 200)
    damaged = F.explode(F.array(F.struct(F.lit("light").alias("model"), F.replace("text", F.lit("th"), F.lit("t")).alias("hyp")), F.struct(F.lit("heavy").alias("model"), F.translate("text", "ei", "a").alias("hyp"))))
    return pages.select("doc_id", "lang", "page_index", F.col("text").alias("ref"), damaged.alias("x")).select("doc_id", "lang", "page_index", "ref", "x.*")


PAIRS = r"""p AS (SELECT doc_id, lang, t, unnest(generate_series(0, greatest(ceil(length(t) / 200)::BIGINT, 1) - 1)) AS page_index FROM (SELECT doc_id, lang, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS t FROM documents)),
q AS (SELECT doc_id, lang, page_index, substr(t, page_index * 200 + 1, 200) AS ref FROM p),
pairs AS (SELECT *, 'light' AS model, replace(ref, 'th', 't') AS hyp FROM q UNION ALL SELECT *, 'heavy', replace(translate(ref, 'ei', 'a'), 'i', '') FROM q),
n AS (SELECT doc_id, lang, page_index, model, trim(regexp_replace(ref, '\s+', ' ', 'g')) AS r, trim(regexp_replace(hyp, '\s+', ' ', 'g')) AS h FROM pairs)"""


@query(f"WITH {PAIRS} SELECT lang, model, count(*) AS n_pages, sum(levenshtein(r, h))::BIGINT AS char_distance, sum(length(r))::BIGINT AS ref_chars FROM n GROUP BY ALL")
def i1_char_distance(spark: SparkSession, d: str) -> DataFrame:
    p = distances(spark, d)
    return p.groupBy("lang", "model").agg(F.count("*").alias("n_pages"), F.sum("distance").alias("char_distance"), F.sum("ref_chars").alias("ref_chars"))


def distances(spark: SparkSession, d: str) -> DataFrame:
    """Pages' distances to each damaged version, over all tasks."""
    p = pairs(spark, d).select("lang", "model", text.collapse(F.col("ref")).alias("r"), text.collapse(F.col("hyp")).alias("h"))
    return p.select("lang", "model", evaluate.char_distance(F.col("r"), F.col("h")).alias("distance"), F.length("r").alias("ref_chars"))


@query(f"WITH {PAIRS}, s AS (SELECT model, round(sum(levenshtein(r, h)) / sum(length(r)), 9) AS cer FROM n GROUP BY model) SELECT model, cer, row_number() OVER (ORDER BY cer, model) AS rank FROM s")
def j1_rank(spark: SparkSession, d: str) -> DataFrame:
    s = distances(spark, d).groupBy("model").agg(F.round(F.sum("distance") / F.sum("ref_chars"), 9).alias("cer"))
    return evaluate.rank(s, "cer").select("model", "cer", F.col("rank").cast("long").alias("rank"))


@query()
def i6_micro_average(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.page_metrics(pairs(spark, d), ["doc_id", "lang", "model"])
    return evaluate.micro_average(m, ("lang", "model"), ("model",))


@query("WITH u AS (SELECT event_type AS model, floor(value * 100)::BIGINT AS i, floor(value * 10)::BIGINT AS o FROM events WHERE value IS NOT NULL), p(model, a, b, c) AS (VALUES ('click', 1.75, 14.0, 0.5), ('view', 0.25, 2.0, 0.5), ('purchase', 3.0, 15.0, 0.5)) SELECT model, count(*) AS pages, sum(i)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round((sum(i) / count(*) * a + sum(o) / count(*) * b) / 1e6, 10)::DOUBLE AS per_page, round((sum(i) / count(*) * a + sum(o) / count(*) * b) / 1e6 * (1 - c), 10)::DOUBLE AS per_page_batch FROM u JOIN p USING (model) GROUP BY model, a, b, c")
def i15_cost(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "events").where("value is not null").select(F.col("event_type").alias("model"), F.floor(F.col("value") * 100).cast("long").alias("input_tokens"), F.floor(F.col("value") * 10).cast("long").alias("output_tokens"))
    prices = spark.createDataFrame([("click", 1.75, 14.0, 0.5), ("view", 0.25, 2.0, 0.5), ("purchase", 3.0, 15.0, 0.5)], "model string, input_per_m double, output_per_m double, discount double")
    return usage.cost(u, prices).select("model", "pages", "tokens_in", "tokens_out", F.round("per_page", 10).alias("per_page"), F.round("per_page_batch", 10).alias("per_page_batch"))


@query("SELECT (ts - INTERVAL 1 MINUTE)::DATE AS day, event_type AS pool, user_id % 3 AS tool, sum(floor(value * 10)::BIGINT)::BIGINT AS tokens, count(*) AS calls FROM events WHERE value >= 0 GROUP BY ALL")
def i24_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("ts", F.col("event_type").alias("pool"), (F.col("user_id") % 3).alias("tool"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return usage.ledger(e, ["pool", "tool"])


@query("""WITH b AS (SELECT (ts - INTERVAL 1 MINUTE)::DATE AS day, CASE WHEN event_type <> 'error' THEN event_type END AS pool, user_id % 3 AS tool, floor(value * 10)::BIGINT AS tokens FROM events WHERE value >= 0)
SELECT day, sum(tokens)::BIGINT AS combined, coalesce(sum(tokens) FILTER (tool = 0), 0)::BIGINT AS own_total, coalesce(sum(tokens) FILTER (pool IS NULL), 0)::BIGINT AS unattributed FROM b GROUP BY day""")
def i22_snapshot(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("ts", F.when(F.col("event_type") != "error", F.col("event_type")).alias("pool"), (F.col("user_id") % 3).cast("string").alias("tool"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))
    return usage.snapshot(usage.ledger(e, ["pool", "tool"]), "0")


@query("WITH u AS (SELECT user_id AS pool, sum(floor(value * 10)::BIGINT)::BIGINT AS used FROM events WHERE value >= 0 GROUP BY user_id), c AS (SELECT c_custkey AS pool, (c_nationkey * 1000 + 1)::BIGINT AS cap FROM customer WHERE c_custkey % 2 = 0) SELECT pool, used, cap, greatest(cap - used, CASE WHEN cap IS NOT NULL THEN 0 END) AS remaining FROM u LEFT JOIN c USING (pool)")
def i26_budget(spark: SparkSession, d: str) -> DataFrame:
    u = t(spark, d, "events").where("value >= 0").groupBy(F.col("user_id").alias("pool")).agg(F.sum(F.floor(F.col("value") * 10).cast("long")).alias("used"))
    caps = t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("pool"), (F.col("c_nationkey") * 1000 + 1).cast("long").alias("cap"))
    return usage.budget(u, caps).select("pool", "used", "cap", "remaining")


@query("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda e, x: 0.3 * x + 0.7 * e, 25000.0::DOUBLE), 6) AS estimate FROM events WHERE value IS NOT NULL GROUP BY user_id")
def j4_smoothed(spark: SparkSession, d: str) -> DataFrame:
    return usage.smoothed(t(spark, d, "events").where("value is not null"), ["user_id"], "event_id", "value").select("user_id", F.round("estimate", 6).alias("estimate"))


@query("SELECT user_id, list_reduce(list(floor(value)::BIGINT ORDER BY event_id), lambda u, x: CASE WHEN u + x <= 500 THEN u + x ELSE u END, 0::BIGINT) AS used FROM events WHERE value >= 0 GROUP BY user_id")
def j5_admitted(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").where("value >= 0").select("user_id", "event_id", F.floor("value").cast("long").alias("cost"))
    return usage.admitted(e, ["user_id"], "event_id", "cost", 500).select("user_id", "used")


@query()
def j9_multiplier(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("user_id", "event_id", (F.col("event_type") == "error").alias("is_error"), (F.coalesce("value", F.lit(0.0)) > 50).alias("is_rate_limit"))
    return usage.multiplier(e, ["user_id"], "event_id")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) - 1 AS minute,
count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) - 1 AS hour FROM events""")
def j10_window_counts(spark: SparkSession, d: str) -> DataFrame:
    return usage.window_counts(t(spark, d, "events"), ["user_id"], "ts", {"minute": 60, "hour": 3600}).select("event_id", "minute", "hour")


MODELS = ["gpt-5-mini", "claude-sonnet", "models/gemma", "openrouter/x", "anthropic/y", "qwen-2", "o3", "own"]
PROVIDERS = ["openai", "anthropic", "google", "openrouter", "openrouter", "openrouter", "openai", "unknown"]


@query(f"SELECT c_custkey, {PROVIDERS}[c_custkey % 8 + 1] AS provider FROM customer")
def c24_provider(spark: SparkSession, d: str) -> DataFrame:
    model = F.get(F.array(*map(F.lit, MODELS)), (F.col("c_custkey") % 8).cast("int"))
    return t(spark, d, "customer").select("c_custkey", select.provider(model).alias("provider"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mini' ELSE 'main' END AS pool FROM part")
def c27_pool(spark: SparkSession, d: str) -> DataFrame:
    model = F.get(F.array(*map(F.lit, ["gpt-5-mini", "openai/gpt-5:free", "gpt-5.55x", "gpt-5-large"])), (F.col("p_partkey") % 4).cast("int"))
    rules = spark.createDataFrame([("gpt-5", "main"), ("gpt-5-mini", "mini"), ("gpt-5.5", "half")], "prefix string, pool string")
    return usage.pool_of(t(spark, d, "part").select("p_partkey", model.alias("model")), rules).select("p_partkey", "pool")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END::INT AS rule_no FROM part")
def c25_capabilities(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").select("p_partkey", F.get(F.array(*map(F.lit, ["gpt-5-mini", "GPT-5x-1", "other"])), (F.col("p_partkey") % 3).cast("int")).alias("model"))
    rules = spark.createDataFrame([(1, "gpt-5x"), (2, "gpt-5"), (3, "gpt")], "rule_no int, prefix string")
    return p.join(select.capabilities(p, rules), "model").select("p_partkey", "rule_no")


@query(r"""WITH p AS (SELECT doc_id, text, unnest(generate_series(0, greatest(ceil(length(text) / 500)::BIGINT, 1) - 1)) AS i FROM documents) SELECT doc_id, count(*) AS n, sum(length(substr(text, i * 500 + 1, 500)))::BIGINT AS n_chars FROM p WHERE i BETWEEN 1 AND 2 OR i >= 4 GROUP BY doc_id""")
def c20_page_range(spark: SparkSession, d: str) -> DataFrame:
    pages = assemble.split_pages(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"], 500)
    return select.PageRange.parse("2-3,5-").apply(pages, ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("SELECT o_custkey, bool_and(o_orderstatus = 'O') AS all_completed, count(*) FILTER (o_orderstatus = 'F') AS n_failed, count(*) AS n_batches FROM orders GROUP BY o_custkey")
def o5_all_completed(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "Completed").when(F.col("o_orderstatus") == "F", "FAILED").otherwise("running")
    return select.all_completed(t(spark, d, "orders").withColumn("status", status), ["o_custkey"])


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS n_failed, CASE WHEN count(*) > 1 AND count(*) FILTER (event_type = 'error') >= 2 AND count(*) FILTER (event_type = 'error') * 2 >= count(*) THEN 'raise' WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'warn' ELSE 'ok' END AS verdict FROM events GROUP BY user_id")
def h9_failure_guard(spark: SparkSession, d: str) -> DataFrame:
    return select.failure_guard(t(spark, d, "events").withColumn("failed", F.col("event_type") == "error"), ["user_id"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND n >= 10 THEN 'complete' WHEN n > 0 THEN 'partial' ELSE 'none' END AS state FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def o1_resume_state(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").join(t(spark, d, "orders"), F.expr("o_custkey = c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return c.select("c_custkey", select.resume_state(F.col("c_custkey") % 2 == 0, F.lit(10), F.col("n"), F.lit(0)).alias("state"))


@query(r"SELECT page_id, regexp_replace(substr(url, 1, 31), '[.\-_ ]+$', '') || '-' || substr(sha256(url), 1, 8) AS name FROM pages")
def d18_safe_name(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.safe_name(F.col("url"), 40).alias("name"))


@query(r"SELECT page_id, list_aggregate(list_transform(regexp_extract_all(lower(url), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(x, 20, '0') ELSE x END), 'string_agg', '') AS key FROM pages")
def k3_natural_key(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.natural_key(F.col("url")).alias("key"))


@query("SELECT page_id, page_id::INT AS index, 'page_' || lpad((page_id + 1)::VARCHAR, greatest(4, length((page_id + 1)::VARCHAR))::INT, '0') || '_pre_processed.jpg' AS name FROM pages")
def d20_page_names(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").select("page_id", text.virtual_page_name(F.col("page_id")).alias("name"))
    return p.select("page_id", text.page_index_of(F.col("name")).alias("index"), "name")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand) > 1 AS collides FROM part")
def g6_stem_collisions(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part").withColumn("name", F.concat("p_brand", F.lit(".jpg")))
    return select.stem_collisions(p).select("p_partkey", "collides")


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l WHERE length(line) > 10 GROUP BY ALL)
SELECT doc_id, max(n)::INT AS n FROM c GROUP BY doc_id HAVING max(n) >= 3""")
def h4_repeated_line(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", quality.repeated_line(F.col("text"), 3).alias("n")).where("n is not null")


@query("""SELECT doc_id, contains(substr(text, 1, 200), '"type": "object"') OR contains(substr(text, 1, 200), '"additionalProperties"') OR contains(substr(text, 1, 200), '"transcription_not_possible"') AS bleed,
CASE WHEN length(text) - length(replace(text, '?', '')) >= 10 AND length(text) - length(replace(text, '?', '')) > 0.05 * length(text) THEN 'questions' END AS marks FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"type": "object"} ' || text WHEN 1 THEN replace(text, 'e', '?') ELSE text END AS text FROM documents)""")
def h3_h5_marks(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"type": "object"} '), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.replace("text", F.lit("e"), F.lit("?"))).otherwise(F.col("text"))
    docs = t(spark, d, "documents").select("doc_id", x.alias("text"))
    return docs.select("doc_id", quality.prompt_bleed(F.col("text")).alias("bleed"), quality.invalid_marks(F.col("text")).alias("marks"))


@query()
def h6_first_failure(spark: SparkSession, d: str) -> DataFrame:
    pages = assemble.split_pages(spread(t(spark, d, "documents").select("doc_id", "text")), ["doc_id"])
    return pages.select("doc_id", "page_index", quality.first_failure(F.col("text"), marks=True).alias("failure"))


@query("SELECT doc_id, md5(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '[No transcribable text]' WHEN 2 THEN text WHEN 3 THEN '[transcription error]' ELSE text END) AS read FROM documents")
def e8_transcription(spark: SparkSession, d: str) -> DataFrame:
    obj = F.to_json(F.struct(F.col("text").alias("transcription"), F.lit(False).alias("no_transcribable_text"), F.lit(False).alias("transcription_not_possible")))
    x = F.col("doc_id") % 5
    raw = (
        F.when(x == 0, obj).when(x == 1, F.lit('{"transcription": null, "no_transcribable_text": true, "transcription_not_possible": false}'))
        .when(x == 2, F.to_json(F.struct(F.concat(F.lit("```json\n"), obj, F.lit("\n```")).alias("output_text"))))
        .when(x == 3, F.lit('{"error": {"code": "x"}}'))
        .otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(obj.alias("content")).alias("message"))).alias("choices"))))
    )
    r = spread(t(spark, d, "documents")).select("doc_id", raw.alias("raw"))
    return r.select("doc_id", "raw").transform(lambda x: response.transcribed(x, "raw", "text")).select("doc_id", F.md5(F.col("text").cast("binary")).alias("read"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 > 0 AND o_custkey > 0 THEN o_custkey::INT - 1 END AS i, '[transcription error; status ' || o_custkey || '; code c]' AS error FROM orders")
def e15_request_index(spark: SparkSession, d: str) -> DataFrame:
    c = F.concat(F.when(F.col("o_custkey") % 3 > 0, "req-").otherwise("x-"), F.col("o_custkey").cast("string"))
    return t(spark, d, "orders").select("o_orderkey", response.request_index(c).alias("i"), response.error_text(F.col("o_custkey"), F.lit("c"), F.lit(None).cast("string")).alias("error"))


@query("SELECT event_id, (event_id * 3)::BIGINT AS input_tokens, event_id AS output_tokens, (event_id * 4)::BIGINT AS total_tokens FROM events")
def e13_token_usage(spark: SparkSession, d: str) -> DataFrame:
    google = F.col("event_id") % 2 == 0
    a, b = (F.col("event_id") * 3).cast("string"), F.col("event_id").cast("string")
    raw = F.when(google, F.concat(F.lit('{"prompt_token_count": '), a, F.lit(', "candidates_token_count": '), b, F.lit("}"))).otherwise(F.concat(F.lit('{"input_tokens": '), a, F.lit(', "output_tokens": '), b, F.lit("}")))
    u = response.token_usage(F.when(google, "google").otherwise("openai"), raw)
    return t(spark, d, "events").select("event_id", *(v.alias(k) for k, v in u.items()))


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, 'p' || turn AS image_name, CASE WHEN turn % 3 <> 1 THEN md5(trim(text, E' \\n\\t')) END AS text, turn % 3 = 1 AS no_transcribable_text FROM conversations")
def b12_editable_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = assemble.running_index(t(spark, d, "conversations"), ["conv_id"], "turn")
    none = F.col("turn") % 3 == 1
    p = c.select("conv_id", "page_index", F.concat(F.lit("p"), F.col("turn").cast("string")).alias("image_name"), F.when(~none, F.col("text")).alias("text"), none.alias("no_transcribable_text"), F.lit(False).alias("transcription_not_possible"))
    back = assemble.from_editable(assemble.editable(p, ["conv_id"]), ["conv_id"])
    return back.select("conv_id", F.col("page_index").cast("long").alias("page_index"), "image_name", F.md5(F.col("text").cast("binary")).alias("text"), "no_transcribable_text")


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS joined FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def i21_page_text(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "conversations").withColumnRenamed("turn", "page_index")
    return assemble.page_text(p, ["conv_id"]).select("conv_id", F.md5(F.col("text").cast("binary")).alias("joined"))


@query()
def a16_html_text(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", html_text("html").alias("text"))


from . import more as _more  # noqa: E402, F401  registers its queries
