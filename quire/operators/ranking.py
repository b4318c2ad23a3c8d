"""Ranking primitives that stay distributed when a group is huge.

* ``first_n``: ``row_number() <= n`` with a literal n. Spark inserts a
  partial ``WindowGroupLimit`` before the shuffle, so a hot group sends at
  most n rows per map task across the network.
* ``hash_rank``: the exact rank of every row inside its group in md5 order.
  A single window over a group of a third of all rows would sort it in one
  task; instead rows are cut into order-preserving hash buckets, ranked per
  (group, bucket) in parallel, and offset by the prefix sum of the bucket
  counts (a table of groups x buckets rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import hex_bucket, md5_order

HASH_BUCKET_DIGITS = 3  # 4096 buckets per group


def join_groups(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on group columns in which a null group is a group too."""
    on = F.lit(True)
    for c in cols:
        on = on & left[c].eqNullSafe(F.col(f"_r_{c}"))
    named = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    return left.join(named, on, how).drop(*[f"_r_{c}" for c in cols])


def first_n(df: DataFrame, group: list[str], order: list[Column | str], n: int,
            rank_col: str | None = None) -> DataFrame:
    """Keep the first ``n`` rows per group in ``order`` (ties must be broken
    by the caller with a unique column)."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    col = rank_col or "_rn"
    out = df.withColumn(col, F.row_number().over(w)).filter(F.col(col) <= n)
    return out if rank_col else out.drop(col)


def first_wins(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each group (``dropDuplicates`` keeps an
    arbitrary row, so it is not used)."""
    return first_n(df, group, order, 1)


def hash_rank(df: DataFrame, group: list[str], key: str, seed: int | Column,
              rank_col: str = "rnk", hash_col: str = "h") -> DataFrame:
    """Add ``h = md5(seed:key)`` and the 1-based rank of each row within
    ``group`` ordered by (h, key). Exact, and no window spans a whole group."""
    b = "_hb"
    df = df.withColumn(hash_col, md5_order(seed, key)).withColumn(b, hex_bucket(hash_col, HASH_BUCKET_DIGITS))
    local = df.withColumn("_lr", F.row_number().over(
        Window.partitionBy(*group, b).orderBy(hash_col, key)))
    counts = local.groupBy(*group, b).agg(F.max("_lr").alias("_n"))
    wo = Window.partitionBy(*group).orderBy(b) if group else Window.orderBy(b)
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    return (
        join_groups(local, offsets, [*group, b])
        .withColumn(rank_col, (F.col("_off") + F.col("_lr")).cast("bigint"))
        .drop("_off", "_lr", b)
    )


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """O1: the first n rows in md5(seed:key) order (a distributed top-k)."""
    h = md5_order(seed, key)
    return df.withColumn("h", h).orderBy("h", key).limit(n)
