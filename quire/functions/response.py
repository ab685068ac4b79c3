"""Parsing of model responses held as JSON strings (E)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import NO_TEXT, NOT_POSSIBLE, strip

SHAPE = "transcription string, no_transcribable_text boolean, transcription_not_possible boolean"


ENVELOPE = SHAPE + ", output_text string, output array<struct<type:string,content:array<struct<type:string,text:string>>>>, choices array<struct<message:struct<content:string,parsed:string>>>, error string"
MOST_BRACES = 1000


def is_object(c: Column) -> Column:
    """Parses as one JSON object (E1); as the only item of an array, as what follows a value is ignored."""
    v = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.coalesce(F.startswith(F.ltrim(c), F.lit("{")), F.lit(False)) & v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull()


def strip_fences(c: Column) -> Column:
    """Content of the last code block of a text that starts with one; a block that is an object as a
    whole keeps the blocks inside it (E2)."""
    s = strip(c)
    outer = F.regexp_extract(s, r"(?s)\A```[A-Za-z0-9_-]*\s*(\{.*\})\s*```\z", 1)
    last = F.try_element_at(F.regexp_extract_all(s, F.lit(r"(?s)```[A-Za-z0-9_-]*[ \t]*\n?(.*?)```"), F.lit(1)), F.lit(-1))
    return F.when(F.startswith(s, F.lit("```")), F.when(is_object(outer), outer).otherwise(F.coalesce(strip(last), s))).otherwise(s)


def last_object(text: str) -> str | None:
    """The object that ends at the last closing brace and starts nearest to it, of the last thousand
    opening braces."""
    end = text.rfind("}") + 1
    starts = [m.start() for m in re.finditer(r"\{", text[:end])]
    for at in reversed(starts[-MOST_BRACES:]):
        try:
            if isinstance(json.loads(text[at:end]), dict):
                return text[at:end]
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(T.StringType())
def _salvage(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else last_object(x))


def salvage(c: Column) -> Column:
    """The last object of a malformed text (E4); texts without braces aren't searched."""
    return _salvage(F.when(F.contains(c, F.lit("}")) & F.contains(c, F.lit("{")), c))


def flagged(o: Column, keys: Column) -> Column:
    """Text of a parsed response object, or what its flags say; null if it has no text field (E5)."""
    said = F.when(F.coalesce(o["no_transcribable_text"], F.lit(False)), NO_TEXT).when(F.coalesce(o["transcription_not_possible"], F.lit(False)), NOT_POSSIBLE).otherwise(F.coalesce(o["transcription"], F.lit("")))
    return F.when(F.coalesce(F.array_contains(keys, "transcription"), F.lit(False)), said)


def responses_text(o: Column) -> Column:
    """Text of a responses body: output_text, or its messages' texts joined."""
    parts = F.flatten(F.transform(F.filter(o["output"], lambda x: x["type"] == "message"), lambda m: F.transform(m["content"], lambda t: t["text"])))
    return F.coalesce(F.nullif(o["output_text"], F.lit("")), F.nullif(F.array_join(parts, ""), F.lit("")))


def chat_text(o: Column) -> Column:
    """Text of a chat body's first choice: what was parsed of it, or its content."""
    m = F.get(o["choices"], 0)["message"]
    return F.coalesce(F.nullif(m["parsed"], F.lit("")), m["content"])


def transcribed(rows: DataFrame, raw: str, into: str) -> DataFrame:
    """rows with the text of their response bodies, by shape in order: error, object, responses, chat,
    else a placeholder (E8). Every step is a column of its own, so each text is parsed once a step."""
    names = ["_t_body", "_t_keys", "_t_own", "_t_inner", "_t_bare", "_t_part", "_t_found"]
    r = rows.withColumn("_t_body", F.from_json(raw, ENVELOPE)).withColumn("_t_keys", F.json_object_keys(raw))
    r = r.withColumn("_t_own", flagged(F.col("_t_body"), F.col("_t_keys"))).withColumn("_t_inner", F.coalesce(responses_text(F.col("_t_body")), chat_text(F.col("_t_body"))))
    r = r.withColumn("_t_bare", strip_fences(F.col("_t_inner"))).withColumn("_t_part", F.regexp_extract("_t_bare", r"(?s)\{.*\}", 0))
    r = r.withColumn("_t_found", F.coalesce(F.when(is_object(F.col("_t_part")), F.col("_t_part")), salvage(F.when(~F.coalesce(is_object(F.col("_t_part")), F.lit(False)), F.col("_t_bare")))))
    read = F.coalesce(flagged(F.from_json("_t_found", SHAPE), F.json_object_keys("_t_found")), F.col("_t_bare"))
    out = F.when(F.col("_t_body.error").isNotNull(), "[transcription error]").otherwise(F.coalesce("_t_own", read, F.lit("[transcription error]")))
    return r.withColumn(into, out).drop(*names)


def error_text(status: Column, code: Column, message: Column) -> Column:
    """Diagnostic placeholder of a failed request."""
    parts = F.array_compact(F.array(F.lit("transcription error"), F.concat(F.lit("status "), status.cast("string")), F.concat(F.lit("code "), code), message))
    return F.concat(F.lit("["), F.array_join(parts, "; "), F.lit("]"))


def request_index(c: Column) -> Column:
    """n - 1 of req-n; null if it isn't one or n is below 1."""
    n = F.nullif(F.regexp_extract(c, r"^req-(\d+)$", 1), F.lit("")).cast("int")
    return F.when(n >= 1, n - 1)


def token_usage(provider: Column, c: Column) -> dict[str, Column]:
    """Input, output and total tokens under each provider's names; the total defaults to the sum."""
    path = lambda p: F.get_json_object(c, p).cast("long")
    given = F.when(provider == "google", path("$.prompt_token_count")).otherwise(F.coalesce(path("$.input_tokens"), path("$.prompt_tokens")))
    made = F.when(provider == "google", path("$.candidates_token_count")).otherwise(F.coalesce(path("$.output_tokens"), path("$.completion_tokens")))
    zero = F.lit(0).cast("long")
    given, made = F.coalesce(given, zero), F.coalesce(made, zero)
    return {"input_tokens": given, "output_tokens": made, "total_tokens": F.coalesce(path("$.total_tokens"), given + made)}
