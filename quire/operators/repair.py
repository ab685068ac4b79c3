"""Repair of failed pages: what to repair, from which entry, and where the new text goes (A4, A5,
C31, F6, F8, F14, I28, Q2, Q3, Q11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.response import request_index
from ..functions.text import base_name, cause

CAUSES = ("api_error", "no_text", "not_possible")
FOLDERS = ("preprocessed_images", "preprocessed_images_tesseract")
SUFFIXES, EXTENSIONS = ("_pre_processed", "_preprocessed"), ("", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".jp2")
ENTRY = "custom_id string, image_name string, page_number int, source_file string, page_index int, order_index int, pre_processed_image string, method string, image_info struct<order_index:int,image_name:string,page_number:int>"


def chosen(lines: DataFrame, errors: bool = True, not_possible: bool = False, no_text: bool = False, indices: list[int] | None = None) -> DataFrame:
    """Failure lines(line_index, cause) of the kinds asked for, of the line numbers asked for."""
    kinds = [c for c, on in zip(CAUSES, (errors, no_text, not_possible)) if on]
    out = lines.where(F.col("cause").isin(kinds))
    return out if indices is None else out.where(F.col("line_index").isin(indices))


def entries(log: DataFrame) -> DataFrame:
    """``(source, order_index, image_name, custom_id, page_number, source_file, page_index,
    pre_processed_image)``: one entry a page, from log(source, line_no, raw). The last metadata or
    request record of a page counts, a page's own record where it has neither, and the first run's
    source file where an entry names none (F8)."""
    keys = F.json_object_keys("raw")
    has = lambda k: F.coalesce(F.array_contains(keys, k), F.lit(False))
    kind = F.when(has("image_metadata"), "image_metadata").when(has("batch_request"), "batch_request").when(F.get_json_object("raw", "$.method") == "gpt", "page")
    inner = F.when(F.col("kind") == "page", F.col("raw")).otherwise(F.coalesce(F.get_json_object("raw", "$.image_metadata"), F.get_json_object("raw", "$.batch_request")))
    r = log.select("source", "line_no", "raw", kind.alias("kind")).where("kind is not null").withColumn("e", F.from_json(inner, ENTRY))
    info = F.col("e.image_info")
    is_request = F.col("kind") == "batch_request"
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    r = r.select(
        "source", "line_no", (F.col("kind") != "page").alias("batch"),
        F.when(is_request, info["order_index"]).otherwise(F.col("e.order_index")).alias("order_index"),
        F.coalesce(F.trim(F.when(is_request, info["image_name"]).otherwise(F.col("e.image_name"))), F.lit("")).alias("image_name"),
        F.when(F.col("kind") != "page", text(F.col("e.custom_id"))).alias("custom_id"),
        F.when(is_request, info["page_number"]).when(F.col("kind") == "image_metadata", F.col("e.page_number")).alias("page_number"),
        F.when(~is_request, text(F.col("e.source_file"))).alias("source_file"), F.when(~is_request, F.col("e.page_index")).alias("page_index"),
        F.when(~is_request, text(F.col("e.pre_processed_image"))).alias("pre_processed_image"),
    ).where("order_index is not null")
    fields = ["image_name", "custom_id", "page_number", "source_file", "page_index", "pre_processed_image"]
    last, first = F.max_by(F.struct(*fields), F.when(F.col("batch"), F.col("line_no"))), F.min_by(F.struct(*fields), F.when(~F.col("batch"), F.col("line_no")))
    one = r.groupBy("source", "order_index").agg(F.coalesce(last, first).alias("e")).select("source", "order_index", "e.*")
    runs = log.select("source", "line_no", F.nullif(F.trim(F.get_json_object("raw", "$.file_provenance.source_file")), F.lit("")).alias("run")).where("run is not null").groupBy("source").agg(F.min_by("run", "line_no").alias("run"))
    return one.join(runs, "source", "left").withColumn("source_file", F.coalesce("source_file", "run")).drop("run")


def targets(failures: DataFrame, known: DataFrame) -> DataFrame:
    """Failure lines(source, line_index, image_name) with the entry of their image; its page number,
    or the place of its order index (F6)."""
    e = known.where("image_name <> ''").groupBy("source", "image_name").agg(F.min(F.struct("order_index", "page_number")).alias("e"))
    r = failures.join(e, ["source", "image_name"], "left").select(*failures.columns, "e.*")
    place = F.when(F.col("order_index") >= 0, F.col("order_index") + 1)
    return r.withColumn("page_number", F.coalesce("page_number", place)).withColumn("image_name", F.coalesce("image_name", F.lit("[unknown]")))


def of_requests(requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Submitted custom_ids with their target by the number they hold, not by their place: a request
    that was never sent shifts nothing (F6); wanted: source, target_no and more."""
    numbered = requests.withColumn("target_no", request_index(F.col("custom_id")))
    return numbered.join(wanted, ["source", "target_no"])


def unrepaired(lines: DataFrame, by: list[str]) -> DataFrame:
    """How many lines of a text are still placeholders of an error or a refusal."""
    c = cause(F.col("line"))
    return lines.groupBy(*by).agg(F.count_if(c != "ok").alias("n_placeholders"), F.count_if(c.isin("api_error", "not_possible")).alias("n_unrepaired"), F.count("*").alias("n_lines"))


def failed_page(text: Column) -> Column:
    """A page without text or with an error in its place."""
    return text.isNull() | (cause(text) == "api_error")


def completed_outputs(batches: DataFrame, lines: DataFrame) -> DataFrame:
    """Output lines(batch_id, raw) of batches(batch_id, status) that are done; lines that don't parse
    are left out (Q2)."""
    done = batches.where(F.lower("status") == "completed").select("batch_id").distinct()
    return lines.where(F.json_object_keys("raw").isNotNull()).join(done, "batch_id", "left_semi")


def image_candidates(recorded: Column, folder: Column, identifier: Column, image_name: Column) -> Column:
    """Where a page's image may lie, most likely first: where it was recorded, beside its document, in
    the two folders of prepared images, and under the document's own folder as its source (Q3)."""
    join = lambda *parts: F.concat_ws("/", *parts)
    stem = F.regexp_replace(image_name, r"\.[^.]*$", "")
    for s in SUFFIXES:
        stem = F.replace(stem, F.lit(s), F.lit(""))
    named = [join(folder, F.lit(f), image_name) for f in FOLDERS] + [join(folder, identifier, F.concat(stem, F.lit(x))) for x in EXTENSIONS]
    own = [F.nullif(recorded, F.lit("")), F.when(F.coalesce(recorded, F.lit("")) != "", join(folder, base_name(recorded)))]
    return F.array_compact(F.array(*own, *(F.when(F.coalesce(image_name, F.lit("")) != "", c) for c in named)))


def found_images(pages: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """pages(by, candidates) with the first candidate that files(path) holds (Q3). Listings compress so
    well that adaptive plans take millions of paths for a small table, so none is broadcast."""
    each = pages.select(*by, F.posexplode("candidates").alias("_n", "path"))
    best = each.join(files.select("path").distinct().hint("merge"), "path").groupBy(*by).agg(F.min_by("path", "_n").alias("image_path"))
    return pages.join(best.hint("merge"), by, "left")


def jobs(files: DataFrame) -> DataFrame:
    """Final texts among files(path) that can be repaired, each with the log beside it: not backups or
    cleaned copies; logs in the text's folder, in one of its name there, and with either ending of the
    name, in this order (A4, A5)."""
    name, folder = base_name(F.col("path")), F.regexp_replace("path", r"/[^/]*$", "")
    f = files.select("path", name.alias("name"), folder.alias("folder"))
    texts = f.where(F.rlike(F.lower("name"), F.lit(r"\.(txt|md)$")) & ~F.rlike("name", F.lit(r"\.(bak|cleaned)\.")))
    identifier = F.regexp_replace(F.regexp_replace("name", r"\.[^.]*$", ""), "_transcription$", "")
    texts = texts.withColumn("identifier", identifier)
    between = (F.lit("/"), F.concat(F.lit("/"), F.col("identifier"), F.lit("/")))
    places = F.array(*(F.concat(F.col("folder"), b, F.col("identifier"), F.lit(e)) for b in between for e in (".jsonl", "_transcription.jsonl")))
    each = texts.select("path", F.posexplode(places).alias("_n", "log_path"))
    logs = f.select(F.col("path").alias("log_path")).where(F.endswith("log_path", F.lit(".jsonl")))
    best = each.join(logs, "log_path").groupBy("path").agg(F.min_by("log_path", "_n").alias("log_path"))
    return texts.select("path", "folder", "identifier").join(best, "path", "left")
