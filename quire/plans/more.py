"""Queries of the batch, repair, discovery and report operators, with SQL. Listings and records are
made from the tables' keys, so that both sides see the same ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality, text
from ..operators import assemble, batch, discover, evaluate, log, repair, report, select, usage
from ..sources import writers
from .queries import PAIRS, TURNS, pairs, query, spread, t, turns


def pick(key: Column, *names: str) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(key, F.lit(len(names))).cast("int"))


def json_of(**parts: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in parts.items())))


def files(spark: SparkSession, d: str) -> DataFrame:
    """A folder tree: parts 0 to 7 of every eight keys are different files of a folder of their own."""
    k = F.col("p_partkey")
    folder = F.concat(F.lit("/in/f"), F.floor(k / 8).cast("string"))
    name = pick(k, "a2.PNG", "a10.jpg", "b.pdf", "c.epub", "notes.txt", "notes_transcr_context.txt", "out.jsonl", "d.mobi")
    root = F.when(F.pmod(k, F.lit(8)) == 2, F.concat(F.lit("/in/r"), k.cast("string"), F.lit("_"))).otherwise(F.concat(folder, F.lit("/")))
    return t(spark, d, "part").select("p_partkey", F.concat(root, name).alias("path"))


FILES = """k AS (SELECT p_partkey, p_partkey % 8 AS m, '/in/f' || (p_partkey // 8) AS folder FROM part),
files AS (SELECT p_partkey, folder, m, CASE m WHEN 2 THEN '/in/r' || p_partkey || '_b.pdf' ELSE folder || '/' || ['a2.PNG', 'a10.jpg', 'b.pdf', 'c.epub', 'notes.txt', 'notes_transcr_context.txt', 'out.jsonl', 'd.mobi'][m + 1] END AS path FROM k)"""


@query(f"WITH {FILES} SELECT 'pdf' AS kind, path, 0::BIGINT AS n_images FROM files WHERE m = 2 UNION ALL SELECT 'image_folder', folder, count(*) FROM files WHERE m < 2 GROUP BY folder")
def a9_scan(spark: SparkSession, d: str) -> DataFrame:
    return discover.scanned(files(spark, d), "/in")


@query(f"WITH {FILES} SELECT folder, path, row_number() OVER (PARTITION BY folder ORDER BY m) - 1 AS order_index FROM files WHERE m < 2")
def a10_folder_images(spark: SparkSession, d: str) -> DataFrame:
    return discover.folder_images(files(spark, d))


@query(f"WITH {FILES} SELECT path, 'notes.txt' AS name FROM files WHERE m = 4")
def a11_texts(spark: SparkSession, d: str) -> DataFrame:
    return discover.texts(files(spark, d), "/in")


@query(f"WITH {FILES} SELECT path, split_part(path, '/', -1) AS name FROM files WHERE m = 3 UNION ALL SELECT DISTINCT folder, split_part(folder, '/', -1) FROM files WHERE m < 2 AND folder IN ('/in/f3', '/in/f5')")
def a12_items(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return discover.items(f, "epubs").unionByName(discover.items(f, "images", ["f3", "f5"], "/in"))


@query("""WITH s AS (SELECT p_partkey, 's' || lpad(p_partkey::VARCHAR, 9, '0') AS source FROM part) SELECT '/m' AS folder, source, CASE p_partkey % 6 WHEN 0 THEN '/m/' || source || '.jsonl' WHEN 1 THEN '/m/' || source || '/' || source || '.jsonl'
WHEN 2 THEN '/m/' || source || '/' || source || '_transcription.jsonl' WHEN 3 THEN '/m/' || source || '/any.jsonl' WHEN 4 THEN '/m/' || source || '-0123abcd/x.jsonl' END AS path FROM s WHERE p_partkey % 6 < 5""")
def a6_artifacts(spark: SparkSession, d: str) -> DataFrame:
    s = F.concat(F.lit("s"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    p = t(spark, d, "part").select(F.lit("/m").alias("folder"), s.alias("source"), F.pmod("p_partkey", F.lit(6)).alias("m"))
    at = lambda *x: F.concat(F.lit("/m/"), F.col("source"), *x)
    places = [at(F.lit(".jsonl")), at(F.lit("/"), F.col("source"), F.lit(".jsonl")), at(F.lit("/"), F.col("source"), F.lit("_transcription.jsonl")), at(F.lit("/any.jsonl")), at(F.lit("-0123abcd/x.jsonl"))]
    listed = p.select(F.explode(F.array_compact(F.array(*(F.when(F.col("m") <= i, x) for i, x in enumerate(places))))).alias("path"))
    return discover.artifacts(listed, p.select("folder", "source"))


@query("SELECT lang AS category, source AS model, count(DISTINCT doc_id) AS n_sources, count(*) AS n_files FROM documents GROUP BY ALL")
def a7_a8_available(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/eval/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, F.lit(".jsonl")).otherwise(F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".jsonl"))))
    return discover.available(discover.outputs(t(spark, d, "documents").select(path.alias("path")), "/eval"))


@query("""SELECT '/in/f' || (p_partkey % 7) || '/d' || p_partkey || '.pdf' AS path, CASE WHEN p_partkey % 5 = 0 THEN '/in/f' || (p_partkey % 7) || '/d' || p_partkey || '_transcr_context.txt' WHEN p_partkey % 7 < 3 THEN '/in/f' || (p_partkey % 7) || '_transcr_context.txt' ELSE '/ctx/transcr_context.txt' END AS context_path,
CASE WHEN p_partkey % 5 = 0 THEN p_name WHEN p_partkey % 7 < 3 THEN 'folder ' || (p_partkey % 7) ELSE 'general' END AS context, false AS is_long FROM part""")
def a21_contexts(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "part")
    base = F.concat(F.lit("/in/f"), (F.col("p_partkey") % 7).cast("string"), F.lit("/d"), F.col("p_partkey").cast("string"))
    own = p.select(F.concat(base, F.lit("_transcr_context.txt")).alias("path"), F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" "), "p_name")).otherwise("  ").alias("text"))
    shared = spark.createDataFrame([(f"/in/f{i}_transcr_context.txt", f"folder {i}") for i in range(3)] + [("/ctx/transcr_context.txt", "general\n ".strip())], "path string, text string")
    return discover.contexts(p.select(F.concat(base, F.lit(".pdf")).alias("path")), own.unionByName(shared), "/ctx")


@query("SELECT page_id, regexp_replace(url, '^https?://[^/]*', '/out') AS path FROM pages WHERE regexp_matches(url, '^https?://[^/]+/')")
def d19_mirror_path(spark: SparkSession, d: str) -> DataFrame:
    p = t(spark, d, "pages").where(F.rlike("url", F.lit("^https?://[^/]+/"))).select("page_id", F.regexp_replace("url", "^https?://[^/]*", "/in").alias("u"))
    return p.select("page_id", discover.mirror_path(F.col("u"), "/in", "/out").alias("path"))


@query("SELECT doc_id, sha256(text) AS sha256, strlen(text)::BIGINT AS length FROM documents")
def q8_provenance(spark: SparkSession, d: str) -> DataFrame:
    f = t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return discover.provenance(f).select(F.col("path").cast("long").alias("doc_id"), "sha256", "length")


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 4 <> 2) SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN turn * 10 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END AS page_index,
CASE WHEN turn % 2 = 0 THEN 'm' || turn WHEN turn % 4 = 1 THEN 'i' || turn || '.png' ELSE 'f' || turn END AS image_name, CASE WHEN turn % 4 < 2 THEN md5(text) END AS text, turn % 4 = 3 AS no_text, turn % 4 < 2 AS read FROM c""")
def a2_evaluation_pages(spark: SparkSession, d: str) -> DataFrame:
    c, m, n = t(spark, d, "conversations"), F.col("turn") % 4, F.col("turn").cast("string")
    record = F.struct(
        F.concat(F.lit("c"), n).alias("custom_id"), F.when(m == 0, "").when(m == 1, F.col("text")).alias("transcription"), F.when(m == 0, F.col("text")).alias("text_chunk"),
        F.when(m == 1, F.concat(F.lit("a\\b/i"), n, F.lit(".png"))).alias("pre_processed_image"), F.when(m == 3, F.concat(F.lit("f"), n)).alias("file_name"), F.when(m == 3, F.lit(True)).alias("no_transcribable_text"),
    )
    source = F.col("conv_id").cast("string").alias("source")
    rows = c.select(source, (F.col("turn") + 10).cast("int").alias("line_no"), F.to_json(record).alias("raw"))
    meta = json_of(image_metadata=F.struct(F.concat(F.lit("c"), n).alias("custom_id"), F.concat(F.lit("m"), n).alias("image_name"), (F.col("turn") * 10).alias("order_index")))
    rows = rows.unionByName(c.where("turn % 2 = 0").select(source, (F.col("turn") + 5000).cast("int").alias("line_no"), meta.alias("raw")))
    rows = rows.unionByName(c.where("turn = 0").select(source, F.lit(0).alias("line_no"), F.lit('{"batch_session": {}, "text_chunk": "no page"}').alias("raw")))
    p = report.evaluation_pages(rows)
    read = report.has_text(F.col("text"), F.col("no_transcribable_text"), F.col("transcription_not_possible"))
    return p.select(F.col("source").cast("long").alias("conv_id"), (F.col("line_no") - 10).cast("long").alias("turn"), F.col("page_index").cast("long").alias("page_index"), "image_name", F.md5(F.col("text").cast("binary")).alias("text"), F.col("no_transcribable_text").alias("no_text"), read.alias("read"))


def result_lines(spark: SparkSession, d: str) -> DataFrame:
    """Result lines of three providers, good and bad, from orders."""
    o, k = t(spark, d, "orders"), F.col("o_orderkey")
    m, said, cid = F.pmod(k, F.lit(9)), F.concat(F.lit("text "), k.cast("string")), F.concat(F.lit("req-"), k.cast("string"))
    obj = json_of(transcription=said, no_transcribable_text=F.lit(False), transcription_not_possible=F.lit(False))
    usage_ = F.struct(F.lit(7).alias("input_tokens"), F.lit(3).alias("output_tokens"))
    message = lambda x: F.array(F.struct(F.lit("message").alias("type"), F.array(F.struct(F.lit("output_text").alias("type"), x.alias("text"))).alias("content")))
    openai = lambda code, body: json_of(custom_id=cid, response=F.struct(F.lit(code).alias("status_code"), body.alias("body")))
    claude = lambda result: json_of(custom_id=cid, result=result)
    raw = (
        F.when(m == 0, openai(200, F.struct(message(obj).alias("output"), usage_.alias("usage"))))
        .when(m == 1, openai(429, F.struct(F.struct(F.lit("slow").alias("code"), F.lit("too fast").alias("message")).alias("error"))))
        .when(m == 2, openai(200, F.struct(F.struct(F.lit("bad").alias("type"), F.lit("no").alias("message")).alias("error"))))
        .when(m == 3, claude(F.struct(F.lit("succeeded").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), obj.alias("text"))).alias("content"), usage_.alias("usage")).alias("message"))))
        .when(m == 4, claude(F.struct(F.lit("errored").alias("type"), F.struct(F.lit("overloaded").alias("type"), F.lit("busy").alias("message")).alias("error"))))
        .when(m == 5, claude(F.struct(F.lit("expired").alias("type"))))
        .when(m == 6, json_of(key=cid, response=F.struct(F.array(F.struct(F.struct(F.array(F.struct(said.alias("text"))).alias("parts")).alias("content"))).alias("candidates"), F.struct(F.lit(7).alias("promptTokenCount"), F.lit(3).alias("candidatesTokenCount")).alias("usageMetadata"))))
        .when(m == 7, json_of(key=cid, error=F.struct(F.lit("13").alias("code"), F.lit("internal").alias("message"))))
        .otherwise(F.lit('{"cut off'))
    )
    provider = F.when(m < 3, "openai").when(m < 6, "anthropic").when(m < 8, "google").otherwise("openai")
    return o.select(k, provider.alias("provider"), raw.alias("raw"))


@query("""SELECT o_orderkey, 'req-' || o_orderkey AS custom_id, o_orderkey % 9 IN (0, 3, 6) AS success, CASE o_orderkey % 9 WHEN 1 THEN '[transcription error; status 429; code slow; too fast]' WHEN 2 THEN '[transcription error; code bad; no]' WHEN 4 THEN '[transcription error; code overloaded; busy]'
WHEN 5 THEN '[transcription error; code expired; Request expired]' WHEN 7 THEN '[transcription error; code 13; internal]' ELSE 'text ' || o_orderkey END AS text, CASE o_orderkey % 9 WHEN 1 THEN 'too fast' WHEN 2 THEN 'no' WHEN 4 THEN 'busy' WHEN 5 THEN 'Request expired' WHEN 7 THEN 'internal' END AS error,
CASE WHEN o_orderkey % 9 IN (0, 3, 6) THEN 7 ELSE 0 END::BIGINT AS input_tokens, CASE WHEN o_orderkey % 9 IN (0, 3, 6) THEN 3 ELSE 0 END::BIGINT AS output_tokens FROM orders WHERE o_orderkey % 9 < 8""")
def a19_results(spark: SparkSession, d: str) -> DataFrame:
    return batch.results(result_lines(spark, d)).select("o_orderkey", "custom_id", "success", "text", "error", "input_tokens", "output_tokens")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS line, l_partkey FROM lineitem) SELECT l_orderkey, line, CASE WHEN l_partkey % 3 = 0 THEN '[transcription error]' ELSE 'page ' || l_partkey END AS text, 'id-' || line AS custom_id FROM l""")
def e9_e12_output_texts(spark: SparkSession, d: str) -> DataFrame:
    body = json_of(response=F.struct(F.struct(F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("page "), F.col("l_partkey").cast("string"))).alias("output_text")).alias("body")))
    l = t(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), body.alias("raw"))  # noqa: E741
    held = l.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "raw"))), lambda x: x["raw"]).alias("r"))
    content = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))).otherwise(F.concat(F.array_join("r", "\n\n{broken\n"), F.lit("\n")))
    texts = batch.output_texts(held.select("l_orderkey", content.alias("content")), ["l_orderkey"])
    ids = texts.select("l_orderkey", "line", F.concat(F.lit("id-"), F.col("line").cast("string")).alias("custom_id"))
    return batch.fallback_entries(texts, ids, ["l_orderkey"]).select("l_orderkey", F.col("line").cast("long").alias("line"), "text", "custom_id")


@query("SELECT 'c' || o_custkey AS custom_id, '[transcription error; code ' || min(o_orderkey % 1) || '; late]' AS text FROM orders WHERE o_custkey % 3 > 0 GROUP BY o_custkey")
def e11_error_entries(spark: SparkSession, d: str) -> DataFrame:
    o, cid = t(spark, d, "orders"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    err = F.struct(F.lit("0").alias("code"), F.lit("late").alias("message"))
    raw = F.when(F.col("o_orderkey") % 2 == 0, json_of(custom_id=cid, error=err)).otherwise(json_of(custom_id=cid, response=F.struct(F.struct(err.alias("error")).alias("body"))))
    return batch.error_entries(o.select(raw.alias("raw")), o.where("o_custkey % 3 = 0").select(cid.alias("custom_id")))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'expired' ELSE 'unknown' END WHEN 1 THEN CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'in_progress' ELSE 'completed' END
ELSE CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' ELSE 'unknown' END END AS status FROM orders""")
def c29_status(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = F.when(k % 3 == 0, pick(k, "validating", "finalizing", "expired", "odd")).when(k % 3 == 1, pick(k, "ended", "ended", "in_progress", "ended")).otherwise(pick(k, "JOB_STATE_QUEUED", "JOB_STATE_CANCELLING", "JOB_STATE_SUCCEEDED", "JOB_STATE_PAUSED"))
    n = {c: F.lit(0) for c in batch.COUNTS} | {"errored": F.when(k % 4 == 0, 0).otherwise(2), "succeeded": F.when(k % 4 == 3, 1).otherwise(0)}
    return t(spark, d, "orders").select(k, batch.status(pick(k, "openai", "anthropic", "google"), state, n).alias("status"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'b' || o_custkey WHEN 1 THEN 'b' || o_custkey WHEN 2 THEN 'b' || o_custkey END AS id, CASE WHEN o_orderkey % 4 < 2 THEN 'done' ELSE 'unknown' END AS state, CASE o_orderkey % 3 WHEN 0 THEN 'x' || o_custkey WHEN 1 THEN 'x' || o_custkey ELSE 'x' || o_custkey END AS coerced FROM orders")
def q15_e14_ids(spark: SparkSession, d: str) -> DataFrame:
    k, b, x = F.col("o_orderkey"), F.concat(F.lit("b"), F.col("o_custkey").cast("string")), F.concat(F.lit("x"), F.col("o_custkey").cast("string"))
    raw = F.when(k % 4 == 0, json_of(batch_id=b, id=F.lit("other"), status=F.lit("DONE"))).when(k % 4 == 1, json_of(batch_id=F.lit(""), id=b, state=F.lit("Done"))).when(k % 4 == 2, json_of(batch_tracking=F.struct(b.alias("batch_id")))).otherwise(F.lit("{}"))
    given = F.when(k % 3 == 0, x).when(k % 3 == 1, json_of(id=x)).otherwise(F.to_json(F.array(F.struct(x.alias("id")))))
    return t(spark, d, "orders").select(k, raw.alias("raw"), given.alias("g")).select("o_orderkey", batch.batch_id().alias("id"), batch.batch_state().alias("state"), batch.coerced_id(F.col("g")).alias("coerced"))


@query("SELECT '{\"custom_id\":\"r' || o_orderkey || '\",\"method\":\"POST\",\"url\":\"/v1/responses\",\"body\":{\"model\":\"m\",\"n\":' || o_custkey || '}}' AS value FROM orders")
def b15_request_lines(spark: SparkSession, d: str) -> DataFrame:
    return batch.request_lines(t(spark, d, "orders").select(F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("custom_id"), F.struct(F.lit("m").alias("model"), F.col("o_custkey").alias("n")).alias("body")))


@query("""SELECT l_orderkey::VARCHAR AS source, count(DISTINCT l_linenumber) + CASE WHEN l_orderkey % 2 = 0 AND bool_or(l_linenumber = 1) THEN 0 ELSE 1 END + CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN l_orderkey % 2 = 0 AND bool_or(l_linenumber = 1) THEN 'first' ELSE 'version' END AS head, CASE WHEN l_orderkey % 3 = 0 THEN 'finalized' ELSE 'open' END AS tail FROM lineitem GROUP BY l_orderkey""")
def b3_b4_markers(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()  # noqa: E741
    raw = F.when((F.col("l_linenumber") == 1) & (F.col("l_orderkey") % 2 == 0), '{"resume_format": {"version": 1}, "a": "first"}').otherwise('{"a": 1}')
    rows = l.select(F.col("l_orderkey").cast("string").alias("source"), F.col("l_linenumber").cast("int").alias("line_no"), raw.alias("raw"))
    out = batch.with_markers(rows, 1, l.where("l_orderkey % 3 = 0").select(F.col("l_orderkey").cast("string").alias("source")))
    ends = out.groupBy("source").agg(F.count("*").alias("n"), F.min_by("raw", "line_no").alias("h"), F.max_by("raw", "line_no").alias("e"), F.count_if(F.contains("raw", F.lit("resume_format"))).alias("v"))
    return ends.where("v = 1").select("source", "n", F.when(F.contains("h", F.lit("first")), "first").otherwise("version").alias("head"), F.when(F.contains("e", F.lit("finalized")), "finalized").otherwise("open").alias("tail"))


@query("SELECT 'b' || l_suppkey AS batch_id, min(l_orderkey) AS source FROM lineitem GROUP BY l_suppkey")
def f10_first_tracking(spark: SparkSession, d: str) -> DataFrame:
    raw = json_of(batch_tracking=F.struct(F.concat(F.lit("b"), F.col("l_suppkey").cast("string")).alias("batch_id")))
    return batch.first_tracking(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("line_no"), raw.alias("raw"))).select("batch_id", "source")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS index, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_linenumber ELSE 'req-' || (l_linenumber + 1) END AS custom_id FROM lineitem")
def f12_inline_ids(spark: SparkSession, d: str) -> DataFrame:
    r = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("index"))
    ids = r.where("index % 2 = 0").distinct().withColumn("custom_id", F.concat(F.lit("c"), F.col("index").cast("string")))
    return batch.inline_ids(r, ids, ["l_orderkey"])


@query("SELECT lower(o_orderstatus) AS status, count(*) AS n FROM orders GROUP BY ALL")
def i17_by_status(spark: SparkSession, d: str) -> DataFrame:
    return batch.by_status(t(spark, d, "orders").select(F.col("o_orderstatus").alias("status")))


@query("WITH n AS (SELECT o_custkey, lower(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, string_agg(s || '=' || n, ', ' ORDER BY s) AS line FROM n GROUP BY o_custkey")
def i31_status_line(spark: SparkSession, d: str) -> DataFrame:
    return batch.status_line(t(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("status")), ["o_custkey"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'skipped' WHEN o_orderkey % 3 = 2 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'finalized' END AS outcome FROM orders")
def i19_outcome(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k, batch.run_outcome(k % 5 != 0, k % 7 == 0, k % 2 != 0, k % 3, F.lit(2)).alias("outcome"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Batch b was cancelled.' WHEN 1 THEN 'Batch b has status ''open''.' WHEN 2 THEN 'API quota exceeded. Check your usage limits.' ELSE 'Error checking batch b: Odd' END AS diagnosis,
CASE o_orderkey % 4 WHEN 0 THEN 'page 3 (i)' WHEN 1 THEN 'page 3' WHEN 2 THEN 'i' ELSE '[unknown image]' END AS label, CASE o_orderkey % 4 WHEN 0 THEN 'status=500 code=x message=m' WHEN 1 THEN 'code=x' ELSE '' END AS detail FROM orders""")
def q16_q18_texts(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_orderkey") % 4
    none = F.lit(None).cast("string")
    said = batch.diagnosis(F.lit("b"), F.when(m == 0, "Cancelled").when(m == 1, "open"), F.when(m == 2, "Over QUOTA now").when(m == 3, "Odd"))
    label = batch.page_label(F.when(m < 2, 3), F.when(m % 2 == 0, "i"))
    return t(spark, d, "orders").select("o_orderkey", said.alias("diagnosis"), label.alias("label"), batch.error_detail(F.when(m == 0, 500), F.when(m < 2, "x"), F.when(m == 0, "m").otherwise(none)).alias("detail"))


def repair_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a run log by order: metadata at every second line, requests at every third, own records."""
    l, n = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p")), F.col("l_linenumber")  # noqa: E741
    source = F.col("l_orderkey").cast("string").alias("source")
    image = F.concat(F.lit("p"), n.cast("string"), F.lit(".png"))
    own = json_of(method=F.lit("gpt"), order_index=n, image_name=image, source_file=F.when(n % 4 == 1, "own.pdf"), page_index=n)
    meta = json_of(image_metadata=F.struct(n.alias("order_index"), image.alias("image_name"), F.lit("m").alias("custom_id"), (n * 100).alias("page_number")))
    request = json_of(batch_request=F.struct(F.lit("r").alias("custom_id"), F.struct(n.alias("order_index"), image.alias("image_name"), (n * 1000).alias("page_number")).alias("image_info")))
    run = l.select(source).distinct().select("source", F.lit(0).alias("line_no"), F.lit('{"file_provenance": {"source_file": "run.pdf"}}').alias("raw"))
    rows = l.select(source, n.cast("int").alias("line_no"), own.alias("raw"))
    rows = rows.unionByName(l.where("l_linenumber % 2 = 0").select(source, (n + 100).cast("int").alias("line_no"), meta.alias("raw")))
    return rows.unionByName(l.where("l_linenumber % 3 = 0").select(source, (n + 200).cast("int").alias("line_no"), request.alias("raw"))).unionByName(run)


ENTRIES = """e AS (SELECT DISTINCT l_orderkey::VARCHAR AS source, l_linenumber AS order_index, 'p' || l_linenumber || '.png' AS image_name, CASE WHEN l_linenumber % 3 = 0 THEN 'r' WHEN l_linenumber % 2 = 0 THEN 'm' END AS custom_id,
CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber * 1000 WHEN l_linenumber % 2 = 0 THEN l_linenumber * 100 END AS page_number, CASE WHEN l_linenumber % 3 > 0 AND l_linenumber % 2 > 0 AND l_linenumber % 4 = 1 THEN 'own.pdf' ELSE 'run.pdf' END AS source_file FROM lineitem)"""


@query(f"WITH {ENTRIES} SELECT * FROM e")
def f8_entries(spark: SparkSession, d: str) -> DataFrame:
    return repair.entries(repair_log(spark, d)).select("source", "order_index", "image_name", "custom_id", "page_number", "source_file")


@query(f"WITH {ENTRIES} SELECT source, order_index AS line_index, coalesce(page_number, order_index + 1) AS page_number, image_name FROM e WHERE order_index IN (1, 2, 3) UNION ALL SELECT o_orderkey::VARCHAR, 9, NULL, '[unknown]' FROM orders")
def f6_targets(spark: SparkSession, d: str) -> DataFrame:
    known = repair.entries(repair_log(spark, d))
    lost = known.where("order_index in (1, 2, 3)").select("source", F.col("order_index").alias("line_index"), "image_name", F.lit("api_error").alias("cause"))
    nameless = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("source"), F.lit(9).alias("line_index"), F.lit(None).cast("string").alias("image_name"), F.lit("not_possible").alias("cause"))
    failures = repair.chosen(lost.unionByName(nameless), not_possible=True, indices=[1, 2, 3, 9])
    return repair.targets(failures, known).select("source", "line_index", "page_number", "image_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 > 0")
def f6_of_requests(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("source"), "o_orderkey", "o_custkey", (F.col("o_orderkey") % 5).cast("int").alias("target_no"))
    sent = o.where("o_orderkey % 3 > 0").select("source", F.concat(F.lit("req-"), (F.col("target_no") + 1).cast("string")).alias("custom_id"))
    return repair.of_requests(sent, o).select("o_orderkey", "o_custkey")


@query(f"WITH {TURNS} SELECT conv_id, count(*) FILTER (turn % 5 IN (1, 2, 3)) AS n_placeholders, count(*) FILTER (turn % 5 IN (2, 3)) AS n_unrepaired, count(*) AS n_lines FROM turns GROUP BY conv_id")
def i28_unrepaired(spark: SparkSession, d: str) -> DataFrame:
    return repair.unrepaired(turns(spark, d).select("conv_id", F.col("text").alias("line")), ["conv_id"])


@query(f"WITH {TURNS} SELECT conv_id, count(*) AS n_pages, coalesce(string_agg((turn + 1)::VARCHAR, ',' ORDER BY turn) FILTER (turn % 5 = 2), '') AS failed_pages, count(*) FILTER (turn % 5 = 3) AS n_not_possible, count(*) FILTER (turn % 5 = 1) AS n_no_text, CASE WHEN count(*) FILTER (turn % 5 = 2) = 0 THEN 'complete' WHEN count(*) FILTER (turn % 5 = 2) = count(*) THEN 'failed' ELSE 'partial' END AS outcome FROM turns GROUP BY conv_id")
def q30_failures(spark: SparkSession, d: str) -> DataFrame:
    r = report.failure_summary(turns(spark, d).withColumn("page_number", F.col("turn") + 1), ["conv_id"])
    return r.withColumn("failed_pages", F.array_join("failed_pages", ","))


@query(f"WITH {TURNS} SELECT count(*) FILTER (turn % 5 = 2 OR turn % 7 = 0) AS n FROM turns")
def c13_failed_pages(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).withColumn("text", F.when(F.col("turn") % 7 != 0, F.col("text")))
    return p.agg(F.count_if(repair.failed_page(F.col("text"))).alias("n"))


@query("SELECT o_orderkey, 'out' || o_orderkey AS raw FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def q2_completed_outputs(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("batch_id"), F.when(F.col("o_orderstatus") == "F", "Completed").otherwise("open").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, json_of(x=F.concat(F.lit("out"), F.col("o_orderkey").cast("string")))).otherwise("{cut").alias("raw"))
    r = repair.completed_outputs(o.select("batch_id", "status"), o.select("batch_id", "raw"))
    return r.select(F.col("batch_id").alias("o_orderkey"), F.get_json_object("raw", "$.x").alias("raw"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '/rec/x.png' WHEN 1 THEN '/job/x.png' WHEN 2 THEN '/job/preprocessed_images/a_pre_processed.jpg' WHEN 3 THEN '/job/doc' || p_partkey || '/a.tif' END AS image_path FROM part")
def q3_images(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    doc, m = F.concat(F.lit("doc"), k.cast("string")), k % 5
    recorded = F.when(m == 0, "/rec/x.png").when(m == 1, "/gone/x.png")
    c = repair.image_candidates(recorded, F.lit("/job"), doc, F.when(m == 3, "a_preprocessed.jpg").when(m != 4, "a_pre_processed.jpg"))
    p = t(spark, d, "part").select(k, F.when((m == 3) | (m == 4), F.filter(c, lambda x: ~F.contains(x, F.lit("preprocessed_images")))).otherwise(c).alias("candidates"))
    there = spark.createDataFrame([("/rec/x.png",), ("/job/x.png",), ("/job/preprocessed_images/a_pre_processed.jpg",)], "path string")
    own = t(spark, d, "part").select(F.concat(F.lit("/job/"), doc, F.lit("/a.tif")).alias("path"))
    return repair.found_images(p, there.unionByName(own), ["p_partkey"]).select("p_partkey", "image_path")


@query("SELECT '/o/d' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '/t_transcription.txt' ELSE '/t.md' END AS path, CASE p_partkey % 4 WHEN 0 THEN '/o/d' || p_partkey || '/t.jsonl' WHEN 1 THEN '/o/d' || p_partkey || '/t_transcription.jsonl' WHEN 2 THEN '/o/d' || p_partkey || '/t/t.jsonl' END AS log_path FROM part")
def a4_a5_jobs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    at = lambda x: F.concat(F.lit("/o/d"), k.cast("string"), F.lit("/"), x)
    names = F.array(at(F.when(k % 2 == 0, "t_transcription.txt").otherwise("t.md")), at(F.lit("t.bak.txt")), at(F.lit("t.cleaned.txt")), at(F.when(k % 4 == 0, "t.jsonl").when(k % 4 == 1, "t_transcription.jsonl").when(k % 4 == 2, "t/t.jsonl").otherwise("u.jsonl")))
    return repair.jobs(t(spark, d, "part").select(F.explode(names).alias("path"))).select("path", "log_path")


@query("SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, count(*) FILTER (o_orderstatus = 'O') AS remaining, round(100.0 * count(*) FILTER (o_orderstatus <> 'O') / count(*), 6) AS percent, CASE WHEN count(*) FILTER (o_orderstatus <> 'O') > 0 AND count(*) FILTER (o_orderstatus = 'O') > 0 THEN round(count(*) FILTER (o_orderstatus = 'O') * 60.0 / count(*) FILTER (o_orderstatus <> 'O'), 6) END::DOUBLE AS seconds_left FROM orders GROUP BY o_custkey")
def i27_progress(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "failed").otherwise("open")
    r = report.progress(t(spark, d, "orders").select("o_custkey", state.alias("state"), F.lit(60.0).alias("seconds")), ["o_custkey"])
    return r.select("o_custkey", "total", "done", "failed", "remaining", F.round("percent", 6).alias("percent"), F.round("seconds_left", 6).alias("seconds_left"))


@query("SELECT user_id, sum(event_id % 10)::BIGINT AS cached, sum(event_id % 3)::BIGINT AS created, sum(event_id % 100)::BIGINT AS input, CASE WHEN sum(event_id % 100) = 0 THEN 0 ELSE round(sum(event_id % 10) / sum(event_id % 100), 9) END AS hit_rate FROM events GROUP BY user_id")
def i30_cache_totals(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    r = report.cache_totals(t(spark, d, "events").select("user_id", (e % 10).alias("cached_tokens"), (e % 3).alias("created_tokens"), (e % 100).alias("input_tokens")), ["user_id"])
    return r.withColumn("hit_rate", F.round("hit_rate", 9))


@query("SELECT (ts - INTERVAL 1 MINUTE)::DATE AS day, sum(CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE event_id % 50 END)::BIGINT AS tokens FROM events WHERE event_id % 4 > 0 OR event_id % 7 > 0 GROUP BY 1")
def i29_with_discarded(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 7).otherwise(F.col("event_id") % 50).alias("tokens"))
    parts = [e.where(f"event_id % 4 {op} 0").select("ts", "tokens") for op in (">", "=")]
    return usage.ledger(report.with_discarded(*parts), []).select("day", "tokens")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'openai|K' || (o_orderkey % 2) || '|' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'big' END END AS bucket, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN 'big' END AS pool FROM orders")
def q14_buckets(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = report.bucket_text(F.when(k % 3 > 0, "openai"), F.concat(F.lit("K"), (k % 2).cast("string")), F.when(k % 5 > 0, "big"))
    return t(spark, d, "orders").select(k, b.alias("bucket")).select("o_orderkey", "bucket", report.bucket_of(F.col("bucket"))["pool"].alias("pool"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN NULL WHEN ts - INTERVAL 1 MINUTE < DATE '2024-01-05' AND ts - INTERVAL 1 MINUTE >= DATE '2024-01-04' THEN event_id ELSE 0 END::BIGINT AS tokens FROM events")
def q26_ledger_today(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    s = t(spark, d, "events").select("event_id", F.when(m == 2, "no day").otherwise(F.date_format(F.col("ts") - F.expr("INTERVAL 1 MINUTE"), "yyyy-MM-dd")).alias("day"), F.when(m == 3, "x").otherwise(F.col("event_id").cast("string")).alias("tokens"))
    return report.ledger_today(s, F.lit("2024-01-04 12:00:00").cast("timestamp"), ["event_id"])


@query("""WITH b AS (SELECT s_suppkey, s_nationkey AS pool, 'k' || s_suppkey AS key_env, s_suppkey % 3 AS m FROM supplier) SELECT pool, key_env, coalesce((SELECT string_agg(o.key_env, ',' ORDER BY o.key_env) FROM b o WHERE o.pool = b.pool AND o.m = 1), '') AS siblings FROM b WHERE m = 0""")
def q27_exhausted(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("s_suppkey") % 3
    b = t(spark, d, "supplier").select(F.lit("openai").alias("provider"), F.concat(F.lit("k"), F.col("s_suppkey").cast("string")).alias("key_env"), F.col("s_nationkey").alias("pool"), F.when(m == 0, 20).otherwise(5).alias("used"), F.when(m < 2, 10).alias("cap"))
    return report.exhausted(b).select("pool", "key_env", F.array_join("siblings", ",").alias("siblings"))


@query("""SELECT o_orderkey, coalesce(o_orderkey % 2 = 0 AND o_orderkey % 100 + 5 + o_custkey % 50 > 60, false) AS blocked, o_orderkey % 2 = 0 AND o_custkey % 50 > 60 AS never_fits, o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AS pool_gate, o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 2 = 0 AS combined_gate FROM orders""")
def c32_c33_gates(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cap = F.when(k % 2 == 0, 60)
    a = report.may_call(k % 100, F.lit(5), F.col("o_custkey") % 50, cap)
    g = report.gates(F.when(k % 5 == 0, "all").otherwise("pooled"), k % 7 != 0, F.when(k % 2 == 0, "big"), F.when(k % 3 == 0, 10))
    return t(spark, d, "orders").select(k, *(v.alias(n) for n, v in {**a, **g}.items()))


@query("SELECT tool, greatest(total, held)::BIGINT AS tokens, greatest(total - held, 0)::BIGINT AS unattributed FROM (SELECT c_nationkey AS tool, count(*) * 10 AS total, sum(c_custkey % 20) AS held FROM customer GROUP BY c_nationkey)")
def i23_reconciled(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "customer").withColumnRenamed("c_nationkey", "tool")
    return usage.reconciled(c.select("tool", F.lit(10).alias("tokens")), c.select("tool", (F.col("c_custkey") % 20).alias("tokens")), ["tool"])


@query(f"WITH {PAIRS} SELECT model, round(CASE WHEN sum(length(r)) > 0 THEN sum(levenshtein(r, h)) / sum(length(r)) ELSE 0 END, 4) AS cer FROM n GROUP BY model")
def i7_derived(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.page_metrics(pairs(spark, d), ["doc_id", "model"])
    sums = m.groupBy("model").agg(*(F.sum(c).alias(c) for c in evaluate.SUMS))
    return report.derived(sums, ["model"]).select("model", "cer")


@query(f"WITH {PAIRS}, e AS (SELECT doc_id, page_index, model, length(r) AS n, length(h) AS m, levenshtein(r, h) AS d FROM n) SELECT doc_id, page_index::INT AS page_index, model, round(CASE WHEN n > 0 THEN d / n ELSE m END, 9)::DOUBLE AS cer FROM e")
def i2_page_rates(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.page_metrics(pairs(spark, d), ["doc_id", "page_index", "model"])
    return evaluate.page_rates(m, ["doc_id", "page_index", "model"]).select("doc_id", "page_index", "model", F.round("cer", 9).alias("cer"))


@query("SELECT o_custkey::VARCHAR AS customer, count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY o_custkey UNION ALL SELECT 'TOTAL', count(*), sum(o_orderkey) FROM orders")
def i13_totals(spark: SparkSession, d: str) -> DataFrame:
    o = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
    return evaluate.with_total(o, "customer", ["n", "keys"])


@query("WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT doc_id, line, count(*) AS n, min(pos) AS pos FROM l WHERE length(line) > 10 GROUP BY ALL) SELECT doc_id, md5(line) AS line, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos)::INT AS rank FROM n QUALIFY rank <= 3")
def k5_top_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.top_lines(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).withColumn("line", F.md5(F.col("line").cast("binary")))


@query("WITH d AS (SELECT p_brand AS method, p_partkey AS position, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT method, count(*) AS n, min(position) AS first, string_agg(name, ';' ORDER BY position) FILTER (r <= 5) AS names FROM d GROUP BY method")
def i20_decisions(spark: SparkSession, d: str) -> DataFrame:
    r = discover.first_of_each(t(spark, d, "part").select(F.col("p_brand").alias("method"), F.col("p_partkey").alias("position"), F.col("p_name").alias("name")))
    return r.withColumn("names", F.array_join("names", ";"))


@query("""SELECT '{"items_total":' || count(*) || ',"items_ok":' || count(*) FILTER (o_orderstatus <> 'P') || ',"items_failed":' || count(*) FILTER (o_orderstatus = 'P') || ',"exit_code":' || CASE WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 1 ELSE 0 END || '}' AS value FROM orders""")
def b18_run_summary(spark: SparkSession, d: str) -> DataFrame:
    return report.run_summary(t(spark, d, "orders").select((F.col("o_orderstatus") == "P").alias("failed")))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), b AS (SELECT *, count(*) FILTER (trim(line, ' ') = '') OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM l) SELECT doc_id, block, min(pos)::INT AS first, count(*) AS n_lines, round(avg(length(line)), 6) AS mean_length FROM b WHERE trim(line, ' ') <> '' GROUP BY doc_id, block")
def j7_blocks(spark: SparkSession, d: str) -> DataFrame:
    return report.blocks(t(spark, d, "documents").select("doc_id", "text"), ["doc_id"]).withColumn("mean_length", F.round("mean_length", 6))


@query(f"WITH {TURNS}, x AS (SELECT conv_id, turn, CASE WHEN turn % 5 IN (0, 4) THEN trim(text, E' \\n\\t') ELSE 'p' || turn || ': ' || trim(text) END AS line FROM turns) SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'md' ELSE 'txt' END AS format, md5(CASE WHEN conv_id % 2 = 0 THEN string_agg(line, chr(10) || chr(10) ORDER BY turn) ELSE string_agg(line, chr(10) ORDER BY turn) END) AS content FROM x GROUP BY conv_id")
def b5_b7_rendered(spark: SparkSession, d: str) -> DataFrame:
    p = turns(spark, d).select("conv_id", "text", F.concat(F.lit("p"), F.col("turn").cast("string")).alias("image_name"), F.lit(1).alias("page_number"), F.col("turn").alias("order_key"), F.when(F.col("conv_id") % 2 == 0, "MD").otherwise("doc").alias("format"))
    return writers.rendered(p, ["conv_id"]).withColumn("content", F.md5(F.col("content").cast("binary")))


@query("SELECT conv_id, turn, '{\"page_index\":' || turn || ',\"image_name\":\"p\",\"transcription\":' || CASE WHEN turn % 3 = 1 THEN 'null' ELSE '\"x' || turn || '\"' END || ',\"no_transcribable_text\":' || (turn % 3 = 1) || ',\"transcription_not_possible\":false' || CASE WHEN turn % 2 = 0 THEN ',\"custom_id\":\"c' || turn || '\"' ELSE '' END || '}' AS value FROM conversations")
def b13_ground_truth(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("turn").cast("string")
    p = t(spark, d, "conversations").select("conv_id", "turn", F.col("turn").alias("page_index"), F.lit("p").alias("image_name"), F.when(F.col("turn") % 3 != 1, F.concat(F.lit("x"), n)).alias("text"), (F.col("turn") % 3 == 1).alias("no_transcribable_text"), F.lit(False).alias("transcription_not_possible"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("c"), n)).alias("custom_id"))
    return assemble.ground_truth(p).select("conv_id", "turn", "value")


@query("SELECT event_id, event_id % 20 > 0 AND event_id % 20 < 12 AS low_input, event_id % 4 < 3 AS cut FROM events")
def h7_h8_flags(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("event_id") % 4
    meta = F.when(m == 0, '{"incomplete_details": {"reason": "max_output_tokens"}}').when(m == 1, '{"stop_reason": "max_tokens"}').when(m == 2, '{"finish_reason": "MAX_TOKENS"}').otherwise('{"stop_reason": "end_turn"}')
    return t(spark, d, "events").select("event_id", quality.low_input(F.col("event_id") % 20, 12).alias("low_input"), quality.output_truncated(meta).alias("cut"))


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'custom' ELSE 'openai' END AS kind, CASE c_custkey % 5 WHEN 0 THEN 'google_image_processing' WHEN 1 THEN 'anthropic_image_processing' WHEN 2 THEN 'custom_image_processing' ELSE 'api_image_processing' END AS section, c_custkey % 2 = 0 AND c_custkey % 3 > 0 AS refused, CASE WHEN c_custkey % 2 = 0 THEN 'top_p' ELSE '' END AS disabled FROM customer")
def c26_c30_models(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    kind = select.model_type(pick(k, "openrouter", "Anthropic", "custom", "unknown", "openai"), pick(k, "google/gemini-3", "x", "y", "o3-mini", "claude"))
    off = select.disabled({"temperature": F.lit(True), "top_p": k % 2 > 0})
    return t(spark, d, "customer").select(k, kind.alias("kind"), select.image_section(kind).alias("section"), select.images_refused(k % 2 == 0, F.when(k % 3 == 0, F.lit(True))).alias("refused"), F.array_join(off, ",").alias("disabled"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'an')")
def c34_named_like(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").where(select.named_like(F.col("p_name"), F.lit(" AN "))).select("p_partkey")


@query("SELECT page_id, 'data:text/html;base64,' || to_base64(encode(html)) AS url FROM pages")
def e16_data_url(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", text.data_url(F.col("html").cast("binary"), F.lit("text/html")).alias("url"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Read {s}' || chr(10) || 'About: ' || p_name || chr(10) || 'end' ELSE 'Read {s}' || chr(10) || 'end' END AS prompt FROM part")
def d17_prompt(spark: SparkSession, d: str) -> DataFrame:
    template = F.lit("Read {{SCHEMA}}\nAbout: {{CONTEXT}}\nend")
    return t(spark, d, "part").select("p_partkey", text.prompt(template, F.lit("{s}"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_name"))).alias("prompt"))


@query("SELECT doc_id, '/t/' || n AS folder, '/t/' || n || '/' || n || '.jsonl' AS log_path FROM (SELECT doc_id, regexp_replace(substr(k, 1, 71), '[.\\-_ ]+$', '') || '-' || substr(sha256(k), 1, 8) AS n FROM (SELECT doc_id, 'key ' || doc_id AS k FROM documents))")
def q9_output_folder(spark: SparkSession, d: str) -> DataFrame:
    parts = discover.output_folder(F.concat(F.lit("key "), F.col("doc_id").cast("string")), "/t")
    return t(spark, d, "documents").select("doc_id", parts["folder"].alias("folder"), parts["log_path"].alias("log_path"))


@query("SELECT conv_id::VARCHAR AS source, turn::INT AS order_index, CASE WHEN conv_id % 2 = 0 THEN 'file_name' ELSE 'folder_name' END AS named, md5(text) AS said FROM conversations WHERE text IS NOT NULL AND turn % 4 > 0")
def q7_page_records(spark: SparkSession, d: str) -> DataFrame:
    c = t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("image_name"), F.when(F.col("turn") % 4 > 0, F.col("text")).alias("text"), F.col("turn").cast("int").alias("order_index"), F.lit("gpt").alias("method"))
    r = discover.page_records(c, F.when(F.col("source").cast("long") % 2 == 0, "file").otherwise("folder"))
    keys = F.json_object_keys("raw")
    return r.select("source", "order_index", F.when(F.array_contains(keys, "file_name"), "file_name").when(F.array_contains(keys, "folder_name"), "folder_name").alias("named"), F.md5(F.get_json_object("raw", "$.text_chunk").cast("binary")).alias("said"))


@query("SELECT c_custkey FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) WHERE n < 10")
def o2_to_do(spark: SparkSession, d: str) -> DataFrame:
    n = t(spark, d, "customer").join(t(spark, d, "orders"), F.expr("o_custkey = c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    states = n.select("c_custkey", select.resume_state(F.lit(True), F.lit(10), F.col("n"), F.lit(0)).alias("state"))
    return discover.to_do(states).select("c_custkey")


@query("SELECT conv_id::VARCHAR AS source, 'p' || turn AS image_name FROM conversations WHERE turn % 5 <> 2 OR turn % 2 = 0")
def c5_processed_names(spark: SparkSession, d: str) -> DataFrame:
    c = turns(spark, d).select(F.col("conv_id").cast("string").alias("source"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("image_name"), F.col("turn").cast("int").alias("line_no"), F.col("text").alias("text_chunk"))
    again = c.where("line_no % 2 = 0").withColumn("line_no", F.col("line_no") + 1000).withColumn("text_chunk", F.lit("read now"))
    return log.processed_names(c.unionByName(again), exclude_errors=True)


@query("SELECT l_orderkey::VARCHAR AS source, l_linenumber::INT AS line_no, 'c' || l_linenumber AS custom_id, '' AS image_name, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE -1 END::INT AS order_index FROM lineitem")
def c3_image_metadata(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber").cast("int")
    raw = json_of(image_metadata=F.struct(F.concat(F.lit("c"), n.cast("string")).alias("custom_id"), F.when(n % 2 == 0, n).alias("order_index")))
    return log.image_metadata(t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), n.alias("line_no"), raw.alias("raw")))


@query("SELECT l_orderkey::VARCHAR AS source, CASE WHEN l_orderkey % 3 = 1 THEN 2 END::INT AS version FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY l_orderkey")
def c8_c9_incompatible(spark: SparkSession, d: str) -> DataFrame:
    l = t(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("source"), F.col("l_linenumber").cast("int").alias("line_no"), (F.col("l_orderkey") % 3).alias("m"))  # noqa: E741
    page = l.select("source", "line_no", F.lit('{"image_name": "p", "text_chunk": "x"}').alias("raw"))
    version = l.where("m < 2").select("source", F.lit(0).alias("line_no"), F.when(F.col("m") == 0, '{"resume_format": {"version": 1}}').otherwise('{"resume_format": {"version": 2}}').alias("raw"))
    return log.reject_incompatible(page.unionByName(version))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'google' ELSE 'openai' END AS provider, CASE p_partkey % 4 WHEN 0 THEN 'native' WHEN 1 THEN 'gpt' WHEN 2 THEN 'native' ELSE 'tesseract' END AS method FROM part")
def c23_c28_methods(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(spark, d, "part").select(k, select.batch_provider(pick(k, "msgbatch_1", "batches/2", "batch_3")).alias("provider"), select.method(pick(k, "epub", "image", "pdf", "pdf"), k % 4 == 2, k % 4 == 1).alias("method"))


@query("SELECT doc_id, length(text) < 400 AS short FROM documents WHERE text <> ''")
def h2_truncated(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("  "), F.regexp_replace("text", r"\s", "x"), F.lit("\n "))
    return t(spark, d, "documents").where("text <> ''").select("doc_id", quality.truncated(x, 400).alias("short"))


@query(r"SELECT doc_id, line_index, trim(line, ' ') = '' OR starts_with(ltrim(line, ' '), '#') OR regexp_matches(line, '^[^:]{0,49}:\s*\[.*\]\s*$') OR contains(lower(line), '[transcription error') AS kept FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1)::INT - 1 AS line_index FROM (SELECT doc_id, replace(replace(regexp_replace(text, '[^\x00-\x7F]|[\[\]|!<#]', '', 'g'), '. ', chr(10) || ' # '), ', ', chr(10) || 'a: [x]' || chr(10) || 'some [transcription error] here' || chr(10) || '[1] note') AS t FROM documents))")
def d4_unwrappable(spark: SparkSession, d: str) -> DataFrame:
    x = F.regexp_replace("text", r"[^\x00-\x7F]|[\[\]|!<#]", "")
    x = F.replace(F.replace(x, F.lit(". "), F.lit("\n # ")), F.lit(", "), F.lit("\na: [x]\nsome [transcription error] here\n[1] note"))
    lines = spread(t(spark, d, "documents")).select("doc_id", F.posexplode(F.split(x, "\n")).alias("line_index", "line"))
    return lines.select("doc_id", "line_index", text.is_unwrappable(F.col("line")).alias("kept"))
