"""Quality validators of a page's text; the first that fails names the reason (H)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

#: What only a leaked prompt says. Fixed values.
BLEED = ('"type": "object"', '"additionalProperties"', '"transcription_not_possible"')
#: Descriptions in place of text. Fixed values.
ICON_WORDS = ("!icon:", "(icon)", "(no icon", "[see image", "[see attached", "[image of", "[figure", "[picture", "(building icon)", "(hotel icon)", "(restaurant icon)", "(fork and spoon)", "(knife and fork)", "(telephone symbol)", "(phone icon)", "(parking icon)", "(wheelchair icon)", "(star symbol)", "(bib gourmand)", "[no visible", "[cannot transcribe")
#: Marks that are fine in small numbers. Fixed values.
GENERIC, DAMAGED = ("[icon]", "[symbol]", "[character]", "[unknown]", "[placeholder]", "[?]", "[marker]"), ("[unreadable", "[omitted")


def count_of(text: Column, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def char_run(text: Column, most: int = 75) -> Column:
    """A character repeated so often."""
    return F.rlike(text, F.lit(r"(?d)(.)\1{%d,}" % (most - 1)))


def loops(text: str, least: int = 30, most: int = 80, step: int = 4, times: int = 15, letters: int = 15) -> bool:
    """Whether a window of some size recurs often enough; windows are compared by rolling hashes of the
    whole text at once, and those that seem to recur by their characters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = np.full(len(code) + 1, 0xD1342543DE82EF95, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * power[:-1], dtype=np.uint64)])
    alnum = np.concatenate([[0], np.cumsum([c.isalnum() for c in text])])
    for size in range(least, min(most, len(text) // times) + 1, step):
        h = (before[size:] - before[:-size]) * power[len(code) - size :: -1]
        ok = alnum[size:] - alnum[:-size] >= letters
        at = np.flatnonzero(ok)
        _, first, of, n = np.unique(h[at], return_index=True, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(n >= times).tolist():
            part = text[at[first[k]] : at[first[k]] + size]
            if sum(text.startswith(part, i) for i in at[of == k].tolist()) >= times:
                return True
    return False


@F.pandas_udf(T.BooleanType())
def _substring_loop(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t is not None and loops(t))


def substring_loop(text: Column) -> Column:
    """A window of 30 to 80 characters seen 15 times; only texts that are long enough are searched."""
    return F.coalesce(_substring_loop(F.when(F.length(text) >= 450, text)), F.lit(False))


def truncated(text: Column, least: int = 0) -> Column:
    """Fewer characters than a page should have; 0 switches it off (H2)."""
    return F.length(strip(text)) < least


def prompt_bleed(text: Column, head: int = 200) -> Column:
    """Words of the prompt near the start (H3)."""
    first, out = F.substring(text, 1, head), F.lit(False)
    for p in BLEED:
        out = out | F.contains(first, F.lit(p))
    return out


def repeated_line(text: Column, most: int = 18, longer_than: int = 10) -> Column:
    """How often the most frequent line that is long enough occurs, if often enough (H4)."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > longer_than)
    top = F.aggregate(F.array_sort(lines), F.struct(F.lit("").alias("x"), F.lit(0).alias("n"), F.lit(0).alias("top")), lambda a, x: F.struct(x.alias("x"), F.when(a["x"] == x, a["n"] + 1).otherwise(1).alias("n"), F.greatest(a["top"], F.when(a["x"] == x, a["n"] + 1).otherwise(1)).alias("top")))
    return F.when(top["top"] >= most, top["top"])


def invalid_marks(text: Column) -> Column:
    """Which rule on marks fails: icons, generic, damaged, questions; null if none (H5)."""
    low = F.lower(text)
    icons = F.lit(False)
    for p in ICON_WORDS:
        icons = icons | F.contains(low, F.lit(p))
    generic = sum((count_of(low, p) for p in GENERIC), F.lit(0))
    damaged = sum((count_of(low, p) for p in DAMAGED), F.lit(0))
    asked = count_of(text, "?")
    return F.when(icons, "icons").when(generic > 3, "generic").when(damaged > 3, "damaged").when((asked >= 10) & (asked > 0.05 * F.length(text)), "questions")


def low_input(tokens: Column, least: int) -> Column:
    """A call that counted fewer input tokens than its image takes (H7)."""
    return (tokens > 0) & (tokens < least)


def output_truncated(metadata: Column) -> Column:
    """One of the three signs that a provider cut an answer off, in its metadata as JSON (H8)."""
    m = F.from_json(metadata, "incomplete_details struct<reason:string>, stop_reason string, finish_reason string")
    return F.coalesce(m["incomplete_details"]["reason"] == "max_output_tokens", F.lit(False)) | F.coalesce(m["stop_reason"] == "max_tokens", F.lit(False)) | F.coalesce(m["finish_reason"] == "MAX_TOKENS", F.lit(False))


def first_failure(text: Column, skip: Column | None = None, marks: bool = False, least: int = 0) -> Column:
    """Name of the first validator that fails, null if none does or the page is flagged (H6)."""
    t = F.coalesce(text, F.lit(""))
    out = F.when(char_run(t), "char_run").when(substring_loop(t), "substring_loop").when(truncated(t, least), "truncated").when(prompt_bleed(t), "prompt_bleed").when(repeated_line(t).isNotNull(), "repeated_line")
    if marks:
        out = out.when(invalid_marks(t).isNotNull(), "invalid_marks")
    return out if skip is None else F.when(~F.coalesce(skip, F.lit(False)), out)
