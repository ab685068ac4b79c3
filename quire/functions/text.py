"""Text normalisation, formatting and naming as Column functions.

White space and words are Unicode classes, lines end at \\n only, lengths are code points. What no
built-in expresses (NFC, tab stops, wrapping) is an Arrow UDF that gets NULL for text it can't change.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, fields
from itertools import groupby

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"(?U)[\s\x1c-\x1f]"
#: Legacy numeral icons that become bullets. Fixed values.
ICONS, BULLET = "\U00010101\U00010102\U00010103\U00010104\U00010105", "•"
NO_TEXT, NOT_POSSIBLE = "[No transcribable text]", "[Transcription not possible]"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(c: Column, lower: bool = False) -> Column:
    """Stripped, runs of white space as one space, null as empty."""
    out = strip(F.regexp_replace(F.coalesce(c, F.lit("")), WS + "+", " "))
    return F.lower(out) if lower else out


def words(c: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def cause(c: Column) -> Column:
    """What a line stands for: api_error, no_text, not_possible or ok."""
    s = strip(F.coalesce(c, F.lit("")))
    head = r"(?iUd)^(?:[^\[]+?:\s*)?\[\s*"
    return (
        F.when(F.rlike(s, F.lit(head + r"transcription\s+error.*\]$")), "api_error")
        .when(F.rlike(s, F.lit(head + r"no\s+transcribable\s+text.*\]$")), "no_text")
        .when(F.rlike(s, F.lit(head + r"transcription\s+not\s+possible.*\]$")), "not_possible")
        .otherwise("ok")
    )


def is_error_placeholder(c: Column) -> Column:
    """Starts as an error placeholder."""
    return F.coalesce(F.startswith(F.lower(F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+", "")), F.lit("[transcription error")), F.lit(False))


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def unicode_clean(c: Column) -> Column:
    """NFC, numeral icons as bullets, no control, format or unassigned characters but \\n and \\t."""
    plain = F.rlike(c, F.lit(r"\A\p{ASCII}*\z"))
    composed = F.coalesce(_nfc(F.when(~plain, c)), c)
    return F.regexp_replace(F.translate(composed, ICONS, BULLET * len(ICONS)), r"[\p{C}&&[^\n\t]]", "")


def dehyphenate(c: Column) -> Column:
    """Joins words hyphenated over a line break between lower-case letters; a pair that isn't joined
    still uses up its right word (D2)."""
    return F.regexp_replace(c, r"(?U)(\w{2,}\p{javaLowerCase})-\n(\p{javaLowerCase}\w+)|(\w{3,}-\n\w{2,})", "$1$2$3")


#: Where lines end. Fixed values.
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def lines_of(c: Column) -> Column:
    """Lines of a text; a final line end starts no line."""
    parts = F.split(c, BREAKS)
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def expand_tabs(line: Column, size: int = 4) -> Column:
    """Tabs of a line as spaces up to the next stop."""
    parts = F.split(line, "\t")
    stop = lambda a, p: F.concat(F.rpad(a, F.length(a) + (size - F.length(a) % size), " "), p)
    return F.when(F.contains(line, F.lit("\t")), F.aggregate(F.slice(parts, 2, F.size(parts)), F.get(parts, 0), stop)).otherwise(line)


def spacing(c: Column, blank_lines: int = 2, tab_size: int = 4, collapse_inner: bool = True) -> Column:
    """Tabs to stops, no spaces at line ends, inner runs of spaces at most two, at most so many blank
    lines in a row, a newline behind every line (D3)."""
    def one(line: Column) -> Column:
        out = F.regexp_replace(expand_tabs(line, tab_size), " +$", "")
        out = F.regexp_replace(out, r"(?U)(?<=[^\s\x1c-\x1f]) {2,}(?=[^\s\x1c-\x1f])", "  ") if collapse_inner else out
        return F.concat(F.when(strip(out) == "", "").otherwise(out), F.lit("\n"))

    text = F.array_join(F.transform(lines_of(c), one), "")
    capped = F.regexp_replace(text, r"(?<=[^\n])\n{%d,}" % (blank_lines + 2), "\n" * (blank_lines + 1))
    return F.when(text == "", "\n").otherwise(F.regexp_replace(capped, r"\A\n{%d,}" % (blank_lines + 1), "\n" * blank_lines))


#: What wrapping leaves alone besides blank lines: headings, page marks, images, image notes, failure
#: placeholders, table rows and placeholders behind an image's name. Fixed values.
UNWRAPPABLE = (
    r"(?s)\A(?:#|<page_number>|!\[)|\A\[(?=.*Image:).*\]\Z|\A\|(?:.*\|)?\Z"
    r"|(?i:\[transcription error|\[no transcribable text|\[transcription not possible)"
    r"|\A[^:]{0,49}:[\s\x1c-\x1f]*\[(?:.*\])?[\s\x1c-\x1f]*\Z"
)
_UNWRAPPABLE = re.compile(UNWRAPPABLE)


def is_unwrappable(line: Column) -> Column:
    """Lines that wrapping leaves alone."""
    s = F.regexp_replace(line, r"(?U)\A[\s\x1c-\x1f]+", "")
    return (s == "") | F.rlike(s, F.lit("(?U)" + UNWRAPPABLE.replace(r"\Z", r"\z")))


@F.pandas_udf(T.IntegerType())
def auto_width(s: pd.Series) -> pd.Series:
    """Mean over blocks of three lines or more of their mean line length, 20 at least, 80 if none."""
    def width(text: str) -> int:
        blocks = ([len(x) for x in b] for some, b in groupby(text.splitlines(), lambda x: bool(x.strip())) if some)
        means = [sum(b) / len(b) for b in blocks if len(b) >= 3]
        return max(20, round(sum(means) / len(means))) if means else 80

    return s.map(lambda x: None if x is None else width(x))


def _wrapped(line: str, width: int) -> list[str]:
    """A line as lines of the width: broken at the last space within it, or within a longer word."""
    bare = line.lstrip()
    if len(line) <= width or not bare or _UNWRAPPABLE.search(bare):
        return [line]
    indent = line[: len(line) - len(line.lstrip(" "))]
    rest, room, out = line[len(indent) :].strip(), max(1, width - len(indent)), []
    while len(rest) > room:
        at = rest.rfind(" ", 1, room + 1)
        at = room if at < 0 else at
        out.append(indent + rest[:at].rstrip())
        rest = rest[at:].lstrip()
    return [*out, indent + rest]


@F.pandas_udf(T.StringType())
def wrap(s: pd.Series, width: pd.Series) -> pd.Series:
    """Long lines broken, their indent kept; a width of 0 or less changes nothing."""
    def one(text: str, n: int) -> str:
        return text if n <= 0 else "\n".join(x for line in text.splitlines() for x in _wrapped(line, n)) + "\n"

    return pd.Series([None if t is None or n is None else one(t, int(n)) for t, n in zip(s, width)], dtype=object)


@dataclass(frozen=True)
class Postprocess:
    """Settings of post-processing; a width switches wrapping on unless it is switched off."""

    enabled: bool = True
    merge_hyphens: bool = False
    collapse_inner: bool = True
    blank_lines: int = 2
    tab_size: int = 4
    wrap_lines: bool = False
    wrap_width: int | None = None

    @classmethod
    def of(cls, config: dict | None = None, **explicit: object) -> Postprocess:
        """From a configuration; explicit values that aren't None go first, unknown names are ignored."""
        known = {f.name for f in fields(cls)}
        merged = {k: v for k, v in {**(config or {}), **{k: v for k, v in explicit.items() if v is not None}}.items() if k in known}
        if explicit.get("wrap_width") is not None and explicit.get("wrap_lines") is None:
            merged["wrap_lines"] = True
        if merged.get("wrap_width") is not None:
            merged["wrap_width"] = int(merged["wrap_width"])
        return cls(**merged)

    def apply(self, c: Column) -> Column:
        """The steps in order: clean, merge hyphens, spacing, wrap at the width or one found."""
        if not self.enabled:
            return c
        out = unicode_clean(c)
        out = dehyphenate(out) if self.merge_hyphens else out
        out = spacing(out, self.blank_lines, self.tab_size, self.collapse_inner)
        if self.wrap_lines:
            out = wrap(out, F.lit(self.wrap_width) if self.wrap_width else auto_width(out))
        return out


def postprocess(c: Column, merge_hyphens: bool = False, wrap_width: int | str | None = None, blank_lines: int = 2) -> Column:
    """Post-processing at a width, at one found by itself ('auto'), or without wrapping."""
    return Postprocess(merge_hyphens=merge_hyphens, blank_lines=blank_lines, wrap_lines=bool(wrap_width), wrap_width=None if wrap_width in (None, "auto") else int(wrap_width)).apply(c)


def extractor_lines(c: Column) -> Column:
    """Stripped lines, one blank line at most in a row, none at the ends."""
    lines = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    return F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"\A\n+|\n+\z", "")


def ebook_text(title: Column, authors: Column, sections: Column) -> Column:
    """Title and author lines, a blank line, then the sections with a blank line between."""
    names = F.array_join(F.filter(F.transform(authors, strip), lambda a: a != ""), ", ")
    head = F.array_join(F.array_compact(F.array(F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# Title: "), strip(title))), F.when(F.coalesce(names, F.lit("")) != "", F.concat(F.lit("# Author(s): "), names)))), "\n")
    body = F.array_join(F.filter(F.transform(sections, extractor_lines), lambda s: s != ""), "\n\n")
    out = F.concat_ws("\n\n", F.nullif(head, F.lit("")), F.nullif(body, F.lit("")))
    return F.when(out == "", "").otherwise(F.concat(out, F.lit("\n")))


PAGE_MARK = r"(?id)<page_number>.*?</?page_number>"
BOLD, ITALIC, HEADING = r"\*\*([^*]+)\*\*", r"(?<!\*)\*([^*]+)\*(?!\*)", r"(?md)^#{1,6}"
FOOTNOTE, LATEX, IMAGE = r"\[\^\d+\]:?", r"\$\$([^$]+)\$\$", r"\[Image:[^\]]+\]"


def strip_formatting(c: Column) -> Column:
    """Text without page marks, emphasis, heading marks, footnotes, formula and image marks."""
    out = F.coalesce(c, F.lit(""))
    for pattern, to in ((PAGE_MARK, ""), (BOLD, "$1"), (ITALIC, "$1"), (HEADING + r"(?U:[\s\x1c-\x1f])*", ""), (r"\[\^[^\]]*\]:?", ""), (LATEX, "$1"), (r"!\[Image:[^\]]*\]", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def formatting(c: Column) -> dict[str, Column]:
    """Formatting elements by kind."""
    kinds = {"page": PAGE_MARK, "bold": BOLD, "italic": ITALIC, "heading": HEADING, "footnote": FOOTNOTE, "latex": LATEX, "image": IMAGE}
    return {k: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(0)) for k, p in kinds.items()}


def page_line(text: Column, image_name: Column, page_number: Column) -> Column:
    """A page as a line: a placeholder gets a header with its image or page, other text stands bare."""
    s = strip(F.coalesce(text, F.lit("")))
    head = F.coalesce(F.nullif(image_name, F.lit("")), F.concat(F.lit("Page "), page_number.cast("string")), F.lit("[unknown image]"))
    return F.when(cause(s) == "ok", s).otherwise(F.concat(head, F.lit(": "), s))


def safe_name(c: Column, limit: int = 80) -> Column:
    """A name of bounded length that stays unique: cut, trimmed of ' .-_', and 8 digits of its sha256."""
    cut = F.regexp_replace(F.substring(c, 1, limit - 9), r"[.\-_ ]+$", "")
    return F.concat(cut, F.lit("-"), F.substring(F.sha2(c, 256), 1, 8))


def virtual_page_name(index: Column) -> Column:
    """File name of a rendered page; index from 0."""
    return F.format_string("page_%04d_pre_processed.jpg", index + 1)


def page_index_of(name: Column) -> Column:
    """Index from 0 of a page's file name, null if it has none."""
    return F.try_subtract(F.nullif(F.regexp_extract(name, r"page_(\d+)_(?:tess_preprocessed|pre_processed)\.", 1), F.lit("")).cast("int"), F.lit(1))


def natural_key(c: Column) -> Column:
    """Sort key that orders digit runs as numbers, without regard to case (K3)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d")), F.lpad(p, 20, "0")).otherwise(p)), "")


def data_url(content: Column, kind: Column) -> Column:
    """Bytes as a data URL."""
    return F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def prompt(template: Column, schema: Column, context: Column) -> Column:
    """A prompt with the schema at its mark, or behind it where it has none, and the context at its mark;
    without a context the whole line of the mark goes (D17)."""
    with_schema = F.when(F.contains(template, F.lit("{{SCHEMA}}")), F.replace(template, F.lit("{{SCHEMA}}"), schema)).when(schema.isNotNull(), F.concat(template, F.lit("\n\n"), schema)).otherwise(template)
    known = F.coalesce(strip(context), F.lit("")) != ""
    return F.when(known, F.replace(with_schema, F.lit("{{CONTEXT}}"), strip(context))).otherwise(F.regexp_replace(with_schema, r"(?m)^[^\n]*\{\{CONTEXT\}\}[^\n]*\n?", ""))


def base_name(c: Column) -> Column:
    """Last part of a path with either kind of slash (C17)."""
    return F.element_at(F.split(c, r"[/\\]"), -1)
