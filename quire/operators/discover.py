"""What lies in a folder tree: documents, artifacts, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base_name, natural_key, safe_name

#: Image files by ending. Fixed values.
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "webp", "bmp", "gif", "jp2")
CONTEXT = r"_(transcr|summary|line_ranges)_context\.txt$"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``(path, name, folder, ext, length)`` of all files under a folder; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "length")
    return named(f)


def named(files: DataFrame) -> DataFrame:
    """files(path, ...) with the parts of their path."""
    name = base_name(F.col("path"))
    return files.withColumn("name", name).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", "")).withColumn("ext", F.lower(F.nullif(F.regexp_extract("name", r"\.([^.]+)$", 1), F.lit(""))))


def scanned(files: DataFrame, root: str) -> DataFrame:
    """``(kind, path, n_images)``: documents directly under a root, folders that hold images, and the
    images that lie loose in the root (A9)."""
    f = named(files.select("path"))
    docs = f.where((F.col("folder") == root) & F.col("ext").isin("pdf", "epub", "mobi")).select(F.col("ext").alias("kind"), "path", F.lit(0).cast("long").alias("n_images"))
    images = f.where(F.col("ext").isin(*IMAGES)).groupBy("folder").agg(F.count("*").alias("n_images"))
    kind = F.when(F.col("folder") == root, "loose_images").otherwise("image_folder")
    return docs.unionByName(images.select(kind.alias("kind"), F.col("folder").alias("path"), "n_images"))


def folder_images(files: DataFrame) -> DataFrame:
    """Images with their place in their folder, in natural order (A10)."""
    f = named(files.select("path")).where(F.col("ext").isin(*IMAGES))
    return f.select("folder", "path", (F.row_number().over(Window.partitionBy("folder").orderBy(natural_key(F.col("name")), "name")) - 1).alias("order_index"))


def texts(files: DataFrame, root: str, recursive: bool = True) -> DataFrame:
    """Text files under a root that hold transcriptions, not contexts."""
    f = named(files.select("path")).where((F.col("ext") == "txt") & ~F.rlike("name", F.lit(CONTEXT)))
    return f.where(F.startswith("folder", F.lit(root)) if recursive else F.col("folder") == root).select("path", "name")


def items(files: DataFrame, kind: str, only: list[str] | None = None, root: str | None = None) -> DataFrame:
    """Files of a kind (pdfs, epubs, mobis) or image folders (images), of the names asked for and
    directly under the root if one is given (A12)."""
    f = named(files.select("path"))
    if kind == "images":
        out = f.where(F.col("ext").isin(*IMAGES)).select(F.col("folder").alias("path")).distinct()
        out = out.withColumn("name", base_name(F.col("path"))).withColumn("folder", F.regexp_replace("path", r"/[^/]*$", ""))
    else:
        out = f.where(F.col("ext") == kind[:-1])
    out = out if root is None else out.where(F.col("folder") == root)
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return (out if only is None else out.where(F.col("name").isin(*only) | stem.isin(*only))).select("path", "name")


def artifacts(files: DataFrame, sources: DataFrame) -> DataFrame:
    """``(folder, source, path)``: the log of each of sources(folder, source). In order: the source's
    name in the folder; in a folder of that name; with the older ending there; any log in that folder;
    a folder of the name cut short with a hash (A6). Names are looked up by equality: a source's own
    name, and its beginnings of the lengths that cut names have. Listings compress well and are small
    only to look at, so they are never broadcast."""
    f = named(files.select("path")).where("ext = 'jsonl'").select(F.col("path"), F.col("name"), F.col("folder").alias("at"))
    parent, own = F.regexp_replace("at", r"/[^/]*$", ""), base_name(F.col("at"))
    f = f.withColumn("parent", parent).withColumn("own", own)
    f = f.withColumn("hashed", F.when(F.rlike("own", F.lit("-[0-9a-f]{8}$")), F.regexp_replace("own", "-[0-9a-f]{8}$", "")))
    nested = F.when(F.col("name") == F.concat("own", F.lit(".jsonl")), 2).when(F.col("name") == F.concat("own", F.lit("_transcription.jsonl")), 3).otherwise(4)
    direct = F.when(F.endswith("name", F.lit(".jsonl")), F.regexp_replace("name", r"\.jsonl\z", ""))
    place = lambda folder, cut, key, rule: F.struct(F.col(folder).alias("folder"), F.lit(cut).alias("is_cut"), key.alias("key"), rule.alias("rule"))
    places = F.array(place("at", False, direct, F.lit(1)), place("parent", False, F.col("own"), nested), place("parent", True, F.col("hashed"), F.lit(5)))
    held = f.select("path", F.explode(places).alias("p")).select("p.*", "path").where("key is not null").groupBy("folder", "is_cut", "key").agg(F.min(F.struct("rule", "path")).alias("b"))
    sizes = f.where("hashed is not null").agg(F.collect_set(F.length("hashed")).alias("sizes"))
    s = sources.select("folder", "source").crossJoin(F.broadcast(sizes))
    cuts = F.filter("sizes", lambda n: n <= F.length("source"))
    keys = F.concat(F.array(F.struct(F.lit(False).alias("is_cut"), F.col("source").alias("key"))), F.transform(cuts, lambda n: F.struct(F.lit(True).alias("is_cut"), F.substring("source", F.lit(1), n).alias("key"))))
    each = s.select("folder", "source", F.explode(keys).alias("k")).select("folder", "source", "k.*")
    best = each.join(held.hint("merge"), ["folder", "is_cut", "key"]).groupBy("folder", "source").agg(F.min("b").alias("b"))
    return best.select("folder", "source", F.col("b.path").alias("path"))


def outputs(files: DataFrame, root: str) -> DataFrame:
    """``(category, model, source, path)`` of logs under root/category/model/source."""
    parts = F.split(F.substring("path", F.lit(len(root) + 2), F.length("path")), "/")
    f = files.where(F.startswith("path", F.lit(root + "/")) & F.endswith("path", F.lit(".jsonl"))).select("path", parts.alias("p")).where("size(p) >= 3")
    source = F.when(F.size("p") > 3, F.get("p", F.lit(2))).otherwise(F.regexp_replace(F.get("p", F.lit(2)), r"\.jsonl$", ""))
    return f.select(F.get("p", F.lit(0)).alias("category"), F.get("p", F.lit(1)).alias("model"), source.alias("source"), "path")


def available(found: DataFrame) -> DataFrame:
    """How many sources each model has in each category."""
    return found.groupBy("category", "model").agg(F.count_distinct("source").alias("n_sources"), F.count("*").alias("n_files"))


def contexts(documents: DataFrame, files: DataFrame, general: str, explicit: str | None = None, suffix: str = "transcr_context", ends: tuple[str, ...] = ("txt",)) -> DataFrame:
    """documents(path) with their context: a file that is named, one of the document's name beside it,
    of its folder's name beside the folder, and the general one; files(path, text), texts stripped,
    empty ones ignored (A21, A22, Q1, F13)."""
    held = files.select("path", F.trim("text").alias("text")).where("text <> ''")
    folder, stem = F.regexp_replace("path", r"/[^/]*$", ""), F.regexp_replace(F.col("path"), r"\.[^./]*$", "")
    places = [F.concat(p, F.lit(f"_{suffix}.{e}")) for p in (stem, folder) for e in ends] + [F.lit(f"{general}/{suffix}.{e}") for e in ends]
    places = ([F.lit(explicit)] if explicit else []) + places
    each = documents.select(F.col("path").alias("document"), F.posexplode(F.array(*places)).alias("_n", "path"))
    best = each.join(held, "path").groupBy("document").agg(F.min(F.struct("_n", "path", "text")).alias("b"))
    return documents.join(best.select(F.col("document").alias("path"), F.col("b.path").alias("context_path"), F.col("b.text").alias("context"), (F.length("b.text") > 4000).alias("is_long")), "path", "left")


def mirror_path(path: Column, root: str, target: str) -> Column:
    """The path under another root."""
    return F.when(F.startswith(path, F.lit(root + "/")), F.concat(F.lit(target), F.substring(path, F.lit(len(root) + 1), F.length(path)))).otherwise(F.concat(F.lit(target + "/"), base_name(path)))


def output_folder(key: Column, target: str, limit: int = 80) -> dict[str, Column]:
    """Folder, text and log of a document, the same in every run (Q9)."""
    name = safe_name(key, limit)
    folder = F.concat(F.lit(target + "/"), name)
    return {"folder": folder, "text_path": F.concat(folder, F.lit("/"), name, F.lit(".txt")), "log_path": F.concat(folder, F.lit("/"), name, F.lit(".jsonl"))}


def provenance(files: DataFrame) -> DataFrame:
    """``(path, sha256, length)`` of files(path, content); null for one without content (Q8)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("length"))


def page_records(results: DataFrame, kind: Column) -> DataFrame:
    """Log lines from results(source, image_name, text, order_index, method): null texts make none, and
    the source stands under the key of its kind (Q7)."""
    r = results.where("text is not null")
    of = lambda name: F.when(kind == name, F.col("source"))
    record = F.struct("image_name", F.col("text").alias("text_chunk"), "order_index", "method", of("file").alias("file_name"), of("folder").alias("folder_name"))
    return r.select("source", "order_index", F.to_json(record).alias("raw"))


def first_of_each(decisions: DataFrame, by: str = "method", order: str = "position", most: int = 5) -> DataFrame:
    """Decisions by method: how many, and the first few of each."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    head = decisions.withColumn("_n", nth).where(F.col("_n") <= most).groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("name")))).alias("h"))
    n = decisions.groupBy(by).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return n.join(head, by).select(by, "n", "first", F.transform("h", lambda x: x["name"]).alias("names"))


def to_do(states: DataFrame) -> DataFrame:
    """Items that aren't complete (O2)."""
    return states.where("state <> 'complete'")
