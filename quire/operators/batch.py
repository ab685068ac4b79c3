"""Provider batches: requests, results, their status and what a run came to (A19, B3, B4, B15, B17,
C29, E9-E12, E14, F10, F12, I17, I19, I31, O2-O4, Q15, Q16, Q18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.response import transcribed

ERROR = "error struct<code:string,type:string,message:string,error:string>"
#: States of a batch by provider. Fixed values.
OPENAI = {"validating": "pending", "in_progress": "in_progress", "finalizing": "in_progress", "completed": "completed", "failed": "failed", "cancelled": "cancelled", "expired": "expired"}
GOOGLE = {"QUEUED": "pending", "PENDING": "pending", "RUNNING": "in_progress", "CANCELLING": "in_progress", "SUCCEEDED": "completed", "FAILED": "failed", "CANCELLED": "cancelled", "EXPIRED": "expired"}
COUNTS = ("processing", "succeeded", "errored", "canceled", "expired")


def _first(*paths: str) -> Column:
    """The first of some paths into raw that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object("raw", p), F.lit("")) for p in paths))


def _lookup(c: Column, names: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), F.lit("unknown"))


def status(provider: Column, state: Column, counts: dict[str, Column]) -> Column:
    """One of seven states; an ended batch of Anthropic is what all of its requests came to, and
    completed if they came to different things or there are none (C29)."""
    total = sum((F.coalesce(counts[k], F.lit(0)) for k in COUNTS), F.lit(0))
    all_are = lambda k: (total > 0) & (F.coalesce(counts[k], F.lit(0)) == total)
    ended = F.when(all_are("errored"), "failed").when(all_are("canceled"), "cancelled").when(all_are("expired"), "expired").otherwise("completed")
    own = F.when(state == "in_progress", "in_progress").when(state == "ended", ended).otherwise("pending")
    google = _lookup(F.regexp_replace(F.coalesce(state, F.lit("")), "^JOB_STATE_", ""), GOOGLE)
    return F.when(provider == "anthropic", own).when(provider == "google", google).otherwise(_lookup(F.coalesce(state, F.lit("")), OPENAI))


def batch_id() -> Column:
    """The id of a tracking record under any of its names (Q15)."""
    return F.trim(_first("$.batch_id", "$.id", "$.batch_tracking.batch_id"))


def batch_state() -> Column:
    """The state of a listing record in lower case (Q15)."""
    return F.lower(F.coalesce(_first("$.status", "$.state"), F.lit("unknown")))


def diagnostic(status: Column | None, code: Column, message: Column) -> Column:
    """A placeholder that says what failed."""
    parts = [] if status is None else [F.concat(F.lit("; status "), status.cast("string"))]
    parts += [F.concat(F.lit("; code "), F.nullif(code, F.lit(""))), F.concat(F.lit("; "), F.nullif(message, F.lit("")))]
    return F.concat(F.lit("[transcription error"), *(F.coalesce(p, F.lit("")) for p in parts), F.lit("]"))


def results(lines: DataFrame) -> DataFrame:
    """Entries of batch result lines(provider, raw): custom_id, success, text, error, error_code and
    tokens, one for every line that parses (A19, E10)."""
    keys = F.json_object_keys("raw")
    body = F.coalesce(F.get_json_object("raw", "$.response.body"), F.when(F.array_contains(keys, "choices"), F.col("raw")))
    openai_error = F.from_json(body, ERROR)["error"]
    code = F.get_json_object("raw", "$.response.status_code").cast("int")
    kind, parts = F.get_json_object("raw", "$.result.type"), F.from_json(F.get_json_object("raw", "$.result.message.content"), "array<struct<type:string,text:string>>")
    said = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    candidates = F.from_json(F.get_json_object("raw", "$.response.candidates"), "array<struct<content:struct<parts:array<struct<text:string>>>>>")
    drawn = F.array_join(F.transform(F.get(candidates, 0)["content"]["parts"], lambda p: p["text"]), "")
    p = F.col("provider")
    r = lines.where(keys.isNotNull())
    failed = F.when(p == "anthropic", kind != "succeeded").when(p == "google", F.get_json_object("raw", "$.error").isNotNull()).otherwise((F.coalesce(code, F.lit(200)) != 200) | openai_error.isNotNull())
    error = (
        F.when(p == "anthropic", F.when(kind == "errored", F.coalesce(_first("$.result.error.message", "$.result.error.error.message"), F.lit("Unknown error"))).when(kind == "canceled", "Request was canceled").when(kind == "expired", "Request expired").otherwise(F.concat(F.lit("Unknown result type: "), F.coalesce(kind, F.lit("")))))
        .when(p == "google", F.coalesce(_first("$.error.message"), F.get_json_object("raw", "$.error")))
        .otherwise(F.coalesce(openai_error["message"], openai_error["error"], F.when(code != 200, F.concat(F.lit("HTTP "), code.cast("string"))), F.lit("Unknown error")))
    )
    error_code = F.when(p == "anthropic", F.when(kind == "errored", _first("$.result.error.type")).otherwise(kind)).when(p == "google", _first("$.error.code")).otherwise(F.coalesce(openai_error["code"], openai_error["type"]))
    # Anthropic and Google hold the answer itself; as a chat body it takes the same way as OpenAI's
    answer = F.when(p == "anthropic", said).when(p == "google", drawn)
    chat = F.to_json(F.struct(F.array(F.struct(F.struct(answer.alias("content")).alias("message"))).alias("choices")))
    number = lambda a, g, o: F.coalesce(F.when(p == "anthropic", F.get_json_object("raw", a)).when(p == "google", F.get_json_object("raw", g)).otherwise(F.get_json_object("raw", o)).cast("long"), F.lit(0).cast("long"))
    r = r.select(
        *lines.columns, F.coalesce(_first("$.custom_id", "$.key"), F.lit(None)).alias("custom_id"), F.coalesce(failed, F.lit(False)).alias("_failed"), error.alias("_error"), error_code.alias("_code"), code.alias("_status"),
        F.when(p.isin("anthropic", "google"), chat).otherwise(body).alias("_body"),
        number("$.result.message.usage.input_tokens", "$.response.usageMetadata.promptTokenCount", "$.response.body.usage.input_tokens").alias("input_tokens"),
        number("$.result.message.usage.output_tokens", "$.response.usageMetadata.candidatesTokenCount", "$.response.body.usage.output_tokens").alias("output_tokens"),
    )
    r = transcribed(r, "_body", "_text")
    text = F.when(F.col("_failed"), diagnostic(F.when(F.col("_status") != 200, F.col("_status")), F.col("_code"), F.col("_error"))).otherwise(F.coalesce(F.nullif("_text", F.lit("")), F.lit("[transcription error]")))
    text = F.when(F.col("_failed") & ~F.coalesce(F.col("_status") != 200, F.lit(False)), diagnostic(None, F.col("_code"), F.col("_error"))).otherwise(text)
    return r.select(*lines.columns, "custom_id", (~F.col("_failed")).alias("success"), text.alias("text"), F.when(F.col("_failed"), F.col("_error")).alias("error"), F.when(F.col("_failed"), F.col("_code")).alias("error_code"), "input_tokens", "output_tokens")


def output_lines(files: DataFrame, by: list[str]) -> DataFrame:
    """``(by, line, raw)`` of batch outputs(content): a JSON array's items or the lines of a text; the
    lines that don't parse are left out, and line counts those that do (E9)."""
    s = F.trim("content")
    items = F.when(F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]")), F.from_json(s, "array<string>"))
    rows = files.select(*by, F.posexplode(F.coalesce(items, F.split(s, r"\r?\n"))).alias("_at", "raw")).where(F.json_object_keys("raw").isNotNull())
    return rows.select(*by, (F.row_number().over(Window.partitionBy(*by).orderBy("_at")) - 1).alias("line"), "raw")


def output_texts(files: DataFrame, by: list[str]) -> DataFrame:
    """``(by, line, text)``: one text for each parsed line of an output, a placeholder where there is none."""
    r = results(output_lines(files, by).withColumn("provider", F.lit("openai")))
    return r.select(*by, "line", F.when(F.col("success"), F.col("text")).otherwise("[transcription error]").alias("text"))


def fallback_entries(texts: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """Texts of an output with the custom_id that stands at the same place of its requests."""
    return texts.join(ids, [*by, "line"], "left")


def error_entries(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """Placeholders for the custom_ids of error lines(raw) that no result has, once each."""
    top, inner = F.from_json("raw", ERROR)["error"], F.from_json(F.get_json_object("raw", "$.response.body"), ERROR)["error"]
    e = F.coalesce(top, inner)
    r = lines.select(_first("$.custom_id").alias("custom_id"), diagnostic(None, F.coalesce(e["code"], e["type"]), F.coalesce(e["message"], e["error"])).alias("text"))
    return r.where("custom_id is not null").join(seen.select("custom_id").distinct(), "custom_id", "left_anti").groupBy("custom_id").agg(F.min("text").alias("text"))


def request_lines(requests: DataFrame, url: str = "/v1/responses") -> DataFrame:
    """``value``: a line of a batch request file for each of requests(custom_id, body), body a JSON
    object or a struct (B15)."""
    is_text = dict(requests.dtypes)["body"] == "string"
    body = F.col("body") if is_text else F.to_json("body")
    head = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url")))
    return requests.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"body":'), body, F.lit("}")).alias("value"))


def with_markers(log: DataFrame, version: int = 1, finalized: DataFrame | None = None) -> DataFrame:
    """log(source, line_no, raw) with a version line in front of every file that states none, and a
    finalized line behind those of ``finalized``(source) (B3, B4)."""
    stated = log.where(F.array_contains(F.json_object_keys("raw"), "resume_format")).select("source").distinct()
    ends = log.groupBy("source").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    head = ends.join(stated, "source", "left_anti").select("source", (F.col("first") - 1).alias("line_no"), F.lit('{"resume_format":{"version":%d}}' % version).alias("raw"))
    out = log.select("source", "line_no", "raw").unionByName(head)
    if finalized is None:
        return out
    tail = ends.join(finalized.select("source").distinct(), "source", "left_semi")
    return out.unionByName(tail.select("source", (F.col("last") + 1).alias("line_no"), F.lit('{"batch_session":{"status":"finalized"}}').alias("raw")))


def error_file_name(batch: Column) -> Column:
    """Where the errors of a batch are kept."""
    return F.concat(F.lit("errors_"), F.substring(batch, 1, 16), F.lit(".jsonl"))


def first_tracking(log: DataFrame) -> DataFrame:
    """The first tracking record of each batch id: batch_id, source, line_no, raw."""
    tracked = log.withColumn("batch_id", F.nullif(F.get_json_object("raw", "$.batch_tracking.batch_id"), F.lit(""))).where("batch_id is not null")
    first = tracked.groupBy("batch_id").agg(F.min(F.struct("source", "line_no", "raw")).alias("r"))
    return first.select("batch_id", "r.*")


def inline_ids(responses: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """Inline responses(by, index) with the custom_id of their place, req-{index + 1} without one."""
    known = ids.groupBy(*by, "index").agg(F.min("custom_id").alias("custom_id"))
    own = F.concat(F.lit("req-"), (F.col("index") + 1).cast("string"))
    return responses.join(known, [*by, "index"], "left").withColumn("custom_id", F.coalesce("custom_id", own))


def by_status(batches: DataFrame) -> DataFrame:
    """How many batches are in each state, in lower case."""
    return batches.groupBy(F.lower(F.coalesce("status", F.lit("unknown"))).alias("status")).agg(F.count("*").alias("n"))


def status_line(batches: DataFrame, by: list[str]) -> DataFrame:
    """States and their counts as one line, sorted by state."""
    n = batches.groupBy(*by, F.lower(F.coalesce("status", F.lit("unknown"))).alias("status")).agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.concat("status", F.lit("="), F.col("n").cast("string"))))
    return n.groupBy(*by).agg(F.array_join(pairs, ", ").alias("line"))


def run_outcome(is_batch: Column, finalized: Column, complete: Column, n_failed: Column, n_batches: Column) -> Column:
    """What a check of a log comes to: no batch log or done before is skipped, open batches leave it
    pending, only failed ones fail it (I19, O3, O4)."""
    return F.when(~is_batch | finalized, "skipped").when((n_batches > 0) & (n_failed >= n_batches), "failed").when(~complete, "pending").otherwise("finalized")


def diagnosis(batch: Column, state: Column, message: Column) -> Column:
    """What to tell about a failed batch, from its state or the error of asking for it (Q16)."""
    s, e = F.lower(state), F.lower(message)
    asked = F.when(F.contains(e, F.lit("not found")), F.concat(F.lit("Batch "), batch, F.lit(" not found in OpenAI. It may have been deleted or belong to a different API key."))).when(F.contains(e, F.lit("unauthorized")), "API key unauthorized. Check your OpenAI API key permissions.").when(F.contains(e, F.lit("quota")), "API quota exceeded. Check your usage limits.").otherwise(F.concat(F.lit("Error checking batch "), batch, F.lit(": "), message))
    known = F.when(s == "failed", " failed. Check your OpenAI dashboard for specific error details.").when(s == "cancelled", " was cancelled.").when(s == "expired", " expired (not completed within 24 hours).").otherwise(F.concat(F.lit(" has status '"), s, F.lit("'.")))
    return F.when(message.isNotNull(), asked).otherwise(F.concat(F.lit("Batch "), batch, known))


def page_label(page_number: Column, image_name: Column) -> Column:
    """A page as 'page n (image)', or what is known of the two (Q18)."""
    n = F.concat(F.lit("page "), page_number.cast("string"))
    return F.coalesce(F.concat(n, F.lit(" ("), image_name, F.lit(")")), n, image_name, F.lit("[unknown image]"))


def error_detail(status: Column, code: Column, message: Column) -> Column:
    """What is known of an error, as key=value (Q18)."""
    part = lambda k, c: F.concat(F.lit(k + "="), F.nullif(c.cast("string"), F.lit("")))
    return F.concat_ws(" ", part("status", status), part("code", code), part("message", message))


def coerced_id(raw: Column) -> Column:
    """An id given as a string, an object with an id, or a list of either."""
    s = F.trim(raw)
    inner = F.coalesce(F.get_json_object(s, "$.id"), F.get_json_object(s, "$[0].id"), F.get_json_object(s, "$[0]"))
    return F.nullif(F.when(F.rlike(s, F.lit(r"^[\[{]")), inner).otherwise(F.regexp_replace(s, '^"|"$', "")), F.lit(""))

