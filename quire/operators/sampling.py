"""Sampling, balancing and splitting.

Sizes that drive later steps (class counts, per-source quotas) stay in
small DataFrames joined back (one row per group or a single row), never
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import constants as K
from quire.functions.hashing import md5_order
from quire.operators.ranking import first_wins, hash_rank, join_groups


def _one_row(df: DataFrame) -> DataFrame:
    """A one-row parameter table, broadcast to every task."""
    return F.broadcast(df)


def dedup_first(df: DataFrame, key_col: Column, seq: str, per: list[str] | None = None) -> DataFrame:
    """Keep the first row (by ``seq``) per (``per``, key)."""
    return first_wins(df.withColumn("dedup_key", key_col), [*(per or []), "dedup_key"], [seq])


def exclude_sources(df: DataFrame, source_col: str, holdout: list[str]) -> DataFrame:
    """Drop holdout sources."""
    return df.filter(~F.col(source_col).isin(holdout))


def prefix_until_target(df: DataFrame, seq: str, usable: Column, chunk_rows: int, target: Column | int | DataFrame,
                        group: list[str] | None = None) -> DataFrame:
    """Read in chunks of ``chunk_rows`` consecutive ``seq`` values, keep
    usable rows, stop after the chunk where the running usable total reaches
    ``target`` (the whole last chunk is kept), separately per ``group``
    (e.g. per source file). Two passes over per-chunk counts instead of a
    sequential scan. ``target`` (positive, as ``oversample_target`` always
    is) may be a one-row DataFrame with ``_target``."""
    group = group or []
    tagged = df.withColumn("chunk", F.floor(F.col(seq) / chunk_rows).cast("bigint")).filter(usable)
    counts = tagged.groupBy(*group, "chunk").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group).orderBy("chunk") if group else Window.orderBy("chunk")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before)
    if isinstance(target, DataFrame):
        counts, tgt = counts.crossJoin(F.broadcast(target.select("_target"))), F.col("_target")
    else:
        tgt = target if isinstance(target, Column) else F.lit(target)
    keep = counts.filter(F.col("_before") < tgt).select(*group, "chunk")
    return join_groups(tagged, keep, [*group, "chunk"], "left_semi")


FIRST_CHUNKS = 8   # chunks of the first step of a progressive read; each step reads as much as all before


def progressive_bound(raw: DataFrame, seq: str, rows: Callable[[DataFrame], DataFrame], chunk_rows: int, target: int) -> int | None:
    """Where reading may stop. Ranges of ``seq`` are read in growing steps
    until ``rows`` (the usable rows of a range) reach ``target`` or none are
    left; the range is a filter of the scan, so files and row groups beyond it
    are not read. What was read at most doubles what was needed. None: no rows."""
    first = raw.agg(F.min(seq)).first()[0]
    if first is None:
        return None
    at = first // chunk_rows * chunk_rows
    step, total = FIRST_CHUNKS * chunk_rows, 0
    while True:
        total += rows(raw.filter((F.col(seq) >= at) & (F.col(seq) < at + step))).count()
        at += step
        if total >= target or raw.filter(F.col(seq) >= at).isEmpty():
            return at
        step *= 2


def progressive_prefix(raw: DataFrame, seq: str, rows: Callable[[DataFrame], DataFrame], chunk_rows: int, target: int) -> DataFrame:
    """S5 with an early stop: ``prefix_until_target`` over the part of a stored
    table, ordered by ``seq``, that has to be read. ``rows`` maps a part of
    ``raw`` to its usable rows, which keep ``seq``."""
    bound = progressive_bound(raw, seq, rows, chunk_rows, target)
    part = raw.filter(F.col(seq) < bound) if bound is not None else raw
    return prefix_until_target(rows(part), seq, F.lit(True), chunk_rows, target)


def oversample_target(n: Column | int, k: Column | int) -> Column:
    """int(n / k * 1.7) + 100."""
    n = n if isinstance(n, Column) else F.lit(n)
    k = k if isinstance(k, Column) else F.lit(k)
    return (F.floor(n / k * K.OVERSAMPLE_FACTOR) + K.OVERSAMPLE_EXTRA).cast("bigint")


def even_source_sample(cand: DataFrame, key: str, source: str, seq: str, n: Column | DataFrame,
                       seed: int = K.SEED) -> DataFrame:
    """O2 + O3: ``n // k`` rows per source (first ``n % k`` sources in
    first-appearance order get one more), each source sampled with seed
    ``seed + index``; any shortfall is filled from unused candidates (J1)
    sampled with ``seed``. ``n`` is a Column over ``_avail`` (the candidate
    count), e.g. ``floor(_avail * 0.9)``."""
    # the candidates feed six branches (sizes, sources, quotas, ranks, the
    # unused pool); compute them once
    cand = cand.persist()
    total = cand.agg(F.count("*").alias("_avail"))
    sources = cand.groupBy(source).agg(F.min(seq).alias("_first"))
    sources = sources.withColumn("_idx", (F.row_number().over(Window.orderBy("_first", source)) - 1).cast("bigint"))
    k = sources.agg(F.count("*").alias("_k"))
    params = total.crossJoin(k)
    if isinstance(n, DataFrame):  # a one-row table holding the requested size in _n_req
        params, n = params.crossJoin(n.select("_n_req")), F.col("_n_req")
    params = params.select(F.least(n, F.col("_avail")).alias("_n"), "_k")
    params = params.select("_n", "_k", (F.col("_n") / F.col("_k")).cast("bigint").alias("_base"),
                           F.pmod(F.col("_n"), F.col("_k")).alias("_rem"))
    quotas = sources.crossJoin(_one_row(params)).select(
        source, "_idx", "_n",
        (F.col("_base") + F.when(F.col("_idx") < F.col("_rem"), 1).otherwise(0)).alias("_req"))
    with_q = join_groups(cand, quotas, [source])
    ranked = hash_rank(with_q, [source], key, F.lit(seed) + F.col("_idx"))
    picked = ranked.filter(F.col("rnk") <= F.col("_req")).drop("rnk", "h", "_req", "_idx")
    # fill from the unused pool
    picked_n = picked.agg(F.count("*").alias("_got"))
    rest = cand.join(picked.select(key), key, "left_anti")
    rest = hash_rank(rest, [], key, seed, rank_col="_fr")
    need = picked_n.crossJoin(_one_row(params.select("_n"))).select((F.col("_n") - F.col("_got")).alias("_need"))
    fill = rest.crossJoin(_one_row(need)).filter(F.col("_fr") <= F.col("_need")).drop("_fr", "h", "_need")
    cols = cand.columns
    return picked.select(*cols).unionByName(fill.select(*cols))


def balance_classes(df: DataFrame, key: str, label: str, seed: int = K.SEED) -> DataFrame:
    """O4 + A10: every class downsampled to the smallest class size."""
    df = df.persist()  # read by the size count and by the ranking
    sizes = df.groupBy(label).agg(F.count("*").alias("_c"))
    target = sizes.agg(F.min("_c").alias("_m"))
    ranked = hash_rank(df, [label], key, seed)
    return ranked.crossJoin(_one_row(target)).filter(F.col("rnk") <= F.col("_m")).drop("_m", "rnk", "h")


def _largest_remainder(counts: DataFrame, label: str, count_col: str, total_col: str, take_col: str, out_col: str) -> DataFrame:
    """Per-label share of ``take`` rows out of ``total``: floor of the exact
    share, then +1 by largest remainder (ties by label)."""
    exact = F.col(count_col) * F.col(take_col)
    base = F.expr(f"({count_col} * {take_col}) div {total_col}").cast("bigint")
    rem_num = exact - base * F.col(total_col)
    c = counts.withColumn("_base", base).withColumn("_remnum", rem_num)
    left = F.col(take_col) - F.sum("_base").over(Window.partitionBy(F.lit(1)))
    order = Window.orderBy(F.col("_remnum").desc(), F.col(label))
    c = c.withColumn("_left", left).withColumn("_ord", F.row_number().over(order))
    return c.withColumn(out_col, F.col("_base") + F.when(F.col("_ord") <= F.col("_left"), 1).otherwise(0)).drop(
        "_base", "_remnum", "_left", "_ord")


def stratified_split(df: DataFrame, key: str, label: str, seed: int = K.SEED,
                     train_frac: float = K.TRAIN_FRAC, val_frac: float = K.VAL_FRAC,
                     test_frac: float = K.TEST_FRAC) -> DataFrame:
    """O5 + O6: seeded stratified train/val/test split, two steps as in
    ``train_test_split``: train = floor(0.8 n), then val = floor(rel * rest)
    with rel = val / (val + test); per-label sizes by largest remainder."""
    if abs(train_frac + val_frac + test_frac - 1.0) > 1e-9:
        raise ValueError("split fractions must sum to 1")
    rel = val_frac / (val_frac + test_frac)
    df = df.persist()  # read by the per-label counts and by the ranking
    counts = df.groupBy(label).agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_n", F.sum("_c").over(Window.partitionBy(F.lit(1))))
    counts = counts.withColumn("_ntrain", F.floor(F.col("_n") * F.lit(train_frac)).cast("bigint"))
    counts = _largest_remainder(counts, label, "_c", "_n", "_ntrain", "_t")
    counts = counts.withColumn("_c2", F.col("_c") - F.col("_t"))
    counts = counts.withColumn("_n2", F.col("_n") - F.col("_ntrain"))
    counts = counts.withColumn("_nval", F.floor(F.col("_n2") * F.lit(rel)).cast("bigint"))
    counts = _largest_remainder(counts, label, "_c2", "_n2", "_nval", "_v")
    quotas = counts.select(label, "_t", "_v")
    ranked = hash_rank(df, [label], key, seed)
    split = (F.when(F.col("rnk") <= F.col("_t"), F.lit("train"))
             .when(F.col("rnk") <= F.col("_t") + F.col("_v"), F.lit("val"))
             .otherwise(F.lit("test")))
    return join_groups(ranked, F.broadcast(quotas), [label]).withColumn("split", split).drop("_t", "_v", "rnk", "h")
