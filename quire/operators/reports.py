"""Report DataFrames (A1-A8, A10, A11) replacing the reference's printed
diagnostics. Every report is an aggregate (partial aggregation map-side);
results are small and ordered for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as tx


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    """A1: counts by one or more columns, descending."""
    return df.groupBy(*cols).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cols)


def distribution(df: DataFrame, dims: dict[str, Column | str]) -> DataFrame:
    """A5: one (dimension, value, n) listing for several dimensions,
    ordered by (dimension, -n, value) like the reference's printout."""
    pairs = [F.struct(F.lit(name).alias("dimension"), (F.col(c) if isinstance(c, str) else c)
                      .cast("string").alias("value")) for name, c in dims.items()]
    long = df.select(F.explode(F.array(*pairs)).alias("d")).select("d.dimension", "d.value")
    return long.groupBy("dimension", "value").agg(F.count("*").alias("n")).orderBy(
        "dimension", F.desc("n"), "value")


def length_summary(df: DataFrame, text: str, by: str) -> DataFrame:
    """A2: count, mean, min, interpolated median, max of text length."""
    x = df.withColumn("_len", F.length(text))
    return x.groupBy(by).agg(
        F.count("*").alias("n"), F.avg("_len").alias("mean_len"), F.min("_len").cast("bigint").alias("min_len"),
        F.percentile(F.col("_len"), F.lit(0.5)).cast("double").alias("median_len"),
        F.max("_len").cast("bigint").alias("max_len"))


def length_min_median_max(df: DataFrame, text: str, by: list[str] | None = None) -> DataFrame:
    """A3: min, upper median (sorted[n // 2]) and max of text length."""
    x = df.withColumn("_len", F.length(text))
    return x.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.min("_len").cast("bigint").alias("min_len"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _len DESC)").cast("bigint").alias("median_len"),
        F.max("_len").cast("bigint").alias("max_len"))


def surface_counts(df: DataFrame, text: str, question_marker: str = "?") -> DataFrame:
    """A4: posts with a question marker, hashtag, mention, likely emoji."""
    t = F.col(text)
    return df.agg(F.count("*").alias("n"), F.count_if(t.contains(question_marker)).alias("n_question"),
                  F.count_if(t.contains("#")).alias("n_hashtag"), F.count_if(t.contains("@")).alias("n_mention"),
                  F.count_if(tx.has_emoji(t)).alias("n_emoji"))


def repeated_openings(df: DataFrame, text: str, min_count: int = 2) -> DataFrame:
    """Non-empty three-word openings used at least ``min_count`` times."""
    o = df.select(tx.opening_key(text).alias("opening")).filter(F.col("opening") != "")
    return o.groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count).orderBy(
        F.desc("n"), "opening")


def failure_rate(batches: DataFrame, failed: Column) -> DataFrame:
    """Failed / batches * 100, 0 when there are no batches."""
    c = batches.agg(F.count("*").alias("n_batches"), F.count_if(failed).alias("n_failed"))
    return c.withColumn("failure_rate", F.when(F.col("n_batches") > 0,
                                               F.lit(100.0) * F.col("n_failed") / F.col("n_batches")).otherwise(0.0))


def shortfall(requested: DataFrame, available: DataFrame, keys: list[str]) -> DataFrame:
    """Requested vs available per key; ``short`` = missing rows."""
    j = requested.join(available, keys, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return j.withColumn("short", F.greatest(F.col("requested") - F.col("available"), F.lit(0)).cast("bigint"))


class QuotaNotMet(RuntimeError):
    pass


def require_no_shortfall(report: DataFrame, what: str) -> None:
    """A11 hard failure: raise when any requested quota is unmet (reads the
    small report only)."""
    bad = report.filter(F.col("short") > 0).limit(5).collect()
    if bad:
        raise QuotaNotMet(f"{what}: quota not met for {[r.asDict() for r in bad]}")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """An empty input is an error (one-row probe, not a count)."""
    if df.isEmpty():
        raise RuntimeError(f"no usable rows: {what}")
    return df
