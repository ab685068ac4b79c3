"""Tokens, budgets, rates and cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_day(ts: Column) -> Column:
    """The day whose budget counts: days begin at 00:01 UTC."""
    return F.to_date(ts - F.expr("INTERVAL 1 MINUTE"))


def ledger(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens by day and bucket; malformed or negative rows are dropped."""
    fine = usage.where("tokens is not null and tokens >= 0")
    return fine.groupBy(budget_day(F.col("ts")).alias("day"), *keys).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("calls"))


def snapshot(buckets: DataFrame, tool: str) -> DataFrame:
    """Per day: all tokens, this tool's, and those without a bucket."""
    return buckets.groupBy("day").agg(F.sum("tokens").alias("combined"), F.sum(F.when(F.col("tool") == tool, F.col("tokens")).otherwise(0)).alias("own_total"), F.sum(F.when(F.col("pool").isNull(), F.col("tokens")).otherwise(0)).alias("unattributed"))


def reconciled(totals: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """``(by, tokens, unattributed)``: what each tool used, no less than its rows hold, and what of that
    no row accounts for (I23); totals(by, tokens), rows(by, tokens)."""
    held = rows.groupBy(*by).agg(F.sum("tokens").alias("held"))
    both = totals.groupBy(*by).agg(F.sum("tokens").alias("total")).join(held, by, "full_outer")
    total, own = F.coalesce("total", F.lit(0)), F.coalesce("held", F.lit(0))
    return both.select(*by, F.greatest(total, own).alias("tokens"), F.greatest(total - own, F.lit(0)).alias("unattributed"))


def budget(used: DataFrame, caps: DataFrame, key: str = "pool") -> DataFrame:
    """Used, remaining and share of each pool's cap; pools without a cap have none."""
    r = used.join(caps, key, "left")
    return r.withColumn("remaining", F.when(F.col("cap").isNotNull(), F.greatest(F.col("cap") - F.col("used"), F.lit(0)))).withColumn("share", F.try_divide(F.col("used") * 100.0, "cap"))


def pool_of(usage: DataFrame, rules: DataFrame, model: str = "model") -> DataFrame:
    """Pool by the longest prefix that ends at a separator; a vendor prefix is dropped.
    Rules are a small dimension."""
    bare = F.regexp_replace(F.lower(model), "^.*/", "")
    u = usage.withColumn("_m", bare)
    models = u.select("_m").distinct()
    after = F.substring(F.col("_m"), F.length("prefix") + 1, F.lit(1))
    fits = F.startswith(F.col("_m"), F.col("prefix")) & after.isin("", "-", ".", ":", "@")
    best = models.join(rules, fits).groupBy("_m").agg(F.max_by("pool", F.length("prefix")).alias("pool"))
    return u.join(best, "_m", "left").drop("_m")


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.3, seed: float = 25_000.0) -> DataFrame:
    """Exponentially weighted tokens per call after the last call (J4), as the sum of weights that fall
    with the number of later calls."""
    later = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order))) - 1
    w = rows.select(*by, F.col(value).cast("double").alias("_x"), later.alias("_later"))
    return w.groupBy(*by).agg((F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("_later")) * F.col("_x")) + seed * F.pow(F.lit(1 - alpha), F.count("*"))).alias("estimate"))


def admitted(calls: DataFrame, by: list[str], order: str, cost: str, cap: int) -> DataFrame:
    """Which calls fit a cap in order, rejected ones using nothing."""
    held = calls.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, F.col(cost).alias("cost")))).alias("r"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0).alias("rejected"))

    def step(a: Column, x: Column) -> Column:
        ok = a["used"] + x["cost"] <= cap
        return F.struct((a["used"] + F.when(ok, x["cost"]).otherwise(0)).cast("long").alias("used"), (a["n"] + ok.cast("int")).alias("n"), (a["rejected"] + (~ok).cast("int")).alias("rejected"))

    return held.select(*by, F.aggregate("r", zero, step).alias("a")).select(*by, F.col("a.used").alias("used"), F.col("a.n").alias("n_admitted"), F.col("a.rejected").alias("n_rejected"))


def window_counts(calls: DataFrame, by: list[str], ts: str, seconds: dict[str, int]) -> DataFrame:
    """Earlier calls within trailing windows, their boundaries included."""
    at = F.col(ts).cast("timestamp").cast("double")
    w = lambda n: Window.partitionBy(*by).orderBy(at).rangeBetween(-n, 0)
    return calls.select("*", *((F.count("*").over(w(n)) - 1).alias(k) for k, n in seconds.items()))


def multiplier(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Wait multiplier after a run of successes and errors (J9): x1.5 on a rate limit, x1.2 on other
    errors beyond two in a row, x0.9 on success, from 1 to 5."""
    held = events.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "is_error", "is_rate_limit"))).alias("r"))
    zero = F.struct(F.lit(1.0).alias("m"), F.lit(0).alias("run"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x["is_error"], a["run"] + 1).otherwise(0)
        m = F.when(~x["is_error"], a["m"] * 0.9).when(x["is_rate_limit"], a["m"] * 1.5).when(run > 2, a["m"] * 1.2).otherwise(a["m"])
        return F.struct(F.greatest(F.lit(1.0), F.least(F.lit(5.0), m)).alias("m"), run.alias("run"))

    return held.select(*by, F.aggregate("r", zero, step)["m"].alias("multiplier"))


def cost(usage: DataFrame, prices: DataFrame, assumed: tuple[int, int] = (2000, 700)) -> DataFrame:
    """Cost per page from mean tokens, in batches too, and against assumed tokens (I14-I16, F11);
    usage: model, input_tokens, output_tokens; prices: model, input_per_m, output_per_m, discount."""
    mean = usage.where("input_tokens is not null and output_tokens is not null").groupBy("model").agg(F.count("*").alias("pages"), F.sum("input_tokens").alias("tokens_in"), F.sum("output_tokens").alias("tokens_out"))
    of = lambda i, o: (i * F.col("input_per_m") + o * F.col("output_per_m")) / 1e6
    r = mean.join(prices, "model").withColumn("per_page", of(F.col("tokens_in") / F.col("pages"), F.col("tokens_out") / F.col("pages")))
    r = r.withColumn("per_page_batch", F.col("per_page") * (1 - F.col("discount"))).withColumn("per_page_assumed", of(F.lit(float(assumed[0])), F.lit(float(assumed[1]))))
    return r.withColumn("ratio", F.try_divide("per_page", "per_page_assumed")).select("model", "pages", "tokens_in", "tokens_out", "per_page", "per_page_batch", "per_page_assumed", "ratio")
