"""Deterministic randomness contract.

Every sample, shuffle, split and "random" choice orders or picks by
``md5(concat_ws(':', seed, key))``. The same expression exists in DuckDB, so
results are oracle-checkable and independent of partitioning and retries.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def md5_order(seed: int | Column, key: Column | str) -> Column:
    """Hex md5 of ``seed:key``; ordering by it (then key) is the shuffle."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", s.cast("string"), _col(key).cast("string")))


def md5_int(seed: int | Column, key: Column | str) -> Column:
    """First 32 bits of the md5 as a non-negative BIGINT (uniform)."""
    return F.conv(F.substring(md5_order(seed, key), 1, 8), 16, 10).cast("bigint")


def hex_bucket(h: Column | str, digits: int = 3) -> Column:
    """Order-preserving bucket of a hex hash: its first ``digits`` hex
    characters (16**digits buckets). Ranges of the hash map to ranges of the
    bucket, so ranks can be computed per bucket and offset by prefix sums."""
    return F.conv(F.substring(_col(h), 1, digits), 16, 10).cast("int")


def pick(options: list[str], h: Column) -> Column:
    """Uniform choice from a fixed list by a hash integer."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (F.pmod(h, F.lit(len(options))) + 1).cast("int"))


def weighted_pick(weights: list[tuple[str, float]], h: Column) -> Column:
    """Weighted choice. Weights become integer basis points so the
    cumulative comparison is exact in every engine."""
    bp = [(name, int(round(w * 10000))) for name, w in weights]
    total = sum(v for _, v in bp)
    u = F.pmod(h, F.lit(total))
    out = None
    acc = 0
    for name, v in bp[:-1]:
        acc += v
        out = F.when(u < acc, F.lit(name)) if out is None else out.when(u < acc, F.lit(name))
    return out.otherwise(F.lit(bp[-1][0]))
