"""Page ranges, provider rules and resume decisions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PageRange:
    """Pages wanted: the first or last so many, or spans from 0, both ends included."""

    first: int | None = None
    last: int | None = None
    spans: tuple[tuple[int, int | None], ...] = ()

    @classmethod
    def parse(cls, spec: str) -> PageRange:
        """'5', 'first:5', 'last:5', '3-7', '3-', '-7' or a list of these; pages count from 1."""
        s = spec.strip().lower()
        if m := re.fullmatch(r"(?:first:)?(\d+)", s):
            return cls(first=_page(m[1]))
        if m := re.fullmatch(r"last:(\d+)", s):
            return cls(last=_page(m[1]))
        spans = []
        for part in s.split(","):
            m = re.fullmatch(r"(\d*)(-?)(\d*)", part.strip())
            if not m or not (m[1] or m[3]):
                raise ValueError(f"not a page range: {spec!r}")
            a = _page(m[1]) if m[1] else 1
            b = (_page(m[3]) if m[3] else None) if m[2] else a
            if b is not None and b < a:
                raise ValueError(f"reversed page range: {spec!r}")
            spans.append((a - 1, None if b is None else b - 1))
        return cls(spans=tuple(merge(spans)))

    def predicate(self, index: Column, total: Column) -> Column:
        """Whether a page of a document of so many is wanted (C20)."""
        if self.first is not None:
            return index < self.first
        if self.last is not None:
            return index >= total - self.last
        out = F.lit(False)
        for a, b in self.spans:
            out = out | ((index >= a) if b is None else index.between(a, b))
        return out

    @property
    def is_empty(self) -> bool:
        """Asks for nothing."""
        return self.first is None and self.last is None and not self.spans

    def describe(self) -> str:
        """The range in words."""
        if self.first is not None or self.last is not None:
            return f"first {self.first} pages" if self.first is not None else f"last {self.last} pages"
        one = lambda a, b: f"{a + 1}-" if b is None else f"{a + 1}" if a == b else f"{a + 1}-{b + 1}"
        return "pages " + ", ".join(one(a, b) for a, b in self.spans) if self.spans else "no pages"

    def apply(self, pages: DataFrame, by: list[str], index: str = "page_index") -> DataFrame:
        return pages.withColumn("_total", F.count("*").over(Window.partitionBy(*by))).where(self.predicate(F.col(index), F.col("_total"))).drop("_total")


def _page(s: str) -> int:
    if int(s) < 1:
        raise ValueError("pages count from 1")
    return int(s)


def merge(spans: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """Sorted spans with those that overlap or adjoin joined."""
    out: list[tuple[int, int | None]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], s[1] is None, s[1] or 0)):
        if out and (out[-1][1] is None or a <= out[-1][1] + 1):
            end = None if b is None or out[-1][1] is None else max(b, out[-1][1])
            out[-1] = (out[-1][0], end)
        else:
            out.append((a, b))
    return out


def parse_indices(spec: str) -> list[int]:
    """'0,5,12' or '1-5' as sorted numbers."""
    out: set[int] = set()
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)(?:-(\d+))?\s*", part)
        if not m:
            raise ValueError(f"not an index: {part!r}")
        out |= set(range(int(m[1]), int(m[2] or m[1]) + 1))
    return sorted(out)


def provider(model: Column) -> Column:
    """Who serves a model, by ordered rules on its name."""
    m = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    starts = lambda *p: F.rlike(m, F.lit("^(?:" + "|".join(p) + ")"))
    return (
        F.when(starts("openrouter/", "(?:openai|anthropic|google|meta|mistral)/"), "openrouter")
        .when(starts("claude") | F.contains(m, F.lit("anthropic")), "anthropic")
        .when(starts("gemini", "gemma", "models/") | F.contains(m, F.lit("google")), "google")
        .when(starts("gpt", "o1", "o3", "o4", "chatgpt", "text-"), "openai")
        .when(F.rlike(m, F.lit("llama|mistral|mixtral|qwen|deepseek|/")), "openrouter")
        .otherwise("unknown")
    )


def capabilities(models: DataFrame, rules: DataFrame) -> DataFrame:
    """The first rule whose prefix a model has; rules(rule_no, prefix, ...) are a small dimension."""
    m = models.select("model").distinct().join(rules, F.startswith(F.lower("model"), F.col("prefix")), "left")
    return m.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy("rule_no"))).where("_n = 1").drop("_n")


def model_type(provider: Column, model: Column) -> Column:
    """Whose images settings a model takes: its provider's, or its name's behind a router."""
    p, m = F.lower(provider), F.lower(F.coalesce(model, F.lit("")))
    return (
        F.when(p.isin("custom", "google", "anthropic", "openai"), p)
        .when(F.contains(m, F.lit("gemini")) | F.contains(m, F.lit("google/")), "google")
        .when(F.contains(m, F.lit("claude")) | F.contains(m, F.lit("anthropic/")), "anthropic")
        .otherwise("openai")
    )


def image_section(kind: Column) -> Column:
    """The section of the settings that holds a model type's image settings."""
    return F.when(kind.isin("custom", "google", "anthropic"), F.concat(kind, F.lit("_image_processing"))).otherwise("api_image_processing")


def images_refused(needs_images: Column, takes_images: Column) -> Column:
    """A model that can't do what is asked of it."""
    return needs_images & ~F.coalesce(takes_images, F.lit(False))


def disabled(flags: dict[str, Column]) -> Column:
    """Names of the parameters that a model doesn't take (Q23)."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(on, F.lit(True)), F.lit(k)) for k, on in flags.items())))


def named_like(name: Column, part: Column) -> Column:
    """A name with this part, whatever the case."""
    return F.contains(F.lower(name), F.lower(F.trim(part)))


def batch_provider(batch_id: Column) -> Column:
    """Who issued a batch id."""
    return F.when(F.startswith(batch_id, F.lit("msgbatch_")), "anthropic").when(F.startswith(batch_id, F.lit("batches/")), "google").otherwise("openai")


def method(kind: Column, native: Column, has_key: Column) -> Column:
    """How a document is read: its own text, a model, or OCR without a key."""
    return F.when(kind.isin("epub", "mobi") | ((kind == "pdf") & native), "native").when(has_key, "gpt").otherwise("tesseract")


def resume_state(has_output: Column, n_pages: Column, n_done: Column, n_errors: Column, retry_errors: bool = False) -> Column:
    """complete, partial or none (O1); errors reopen a document when they are to be tried again."""
    done = F.when(has_output & (n_done >= n_pages), "complete").when(n_done > 0, "partial").otherwise("none")
    return F.when((done == "complete") & (n_errors > 0), "partial").otherwise(done) if retry_errors else done


def all_completed(batches: DataFrame, by: list[str]) -> DataFrame:
    """Whether all batches are done, and how many failed for good."""
    s = F.lower("status")
    return batches.groupBy(*by).agg(F.bool_and(s == "completed").alias("all_completed"), F.count_if(s.isin("failed", "expired", "cancelled")).alias("n_failed"), F.count("*").alias("n_batches"))


def failure_guard(pages: DataFrame, by: list[str]) -> DataFrame:
    """Documents in which too many pages fail: over one page, two failures and half of all (H9)."""
    r = pages.groupBy(*by).agg(F.count("*").alias("total"), F.count_if("failed").alias("n_failed"))
    return r.withColumn("verdict", F.when((F.col("total") > 1) & (F.col("n_failed") >= 2) & (F.col("n_failed") * 2 >= F.col("total")), "raise").when(F.col("n_failed") > 0, "warn").otherwise("ok"))


def stem_collisions(files: DataFrame, name: str = "name") -> DataFrame:
    """Files whose name without its extension isn't unique."""
    staged = files.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", ""))
    shared = staged.groupBy("stem").agg((F.count("*") > 1).alias("collides"))
    return staged.join(shared, "stem")
