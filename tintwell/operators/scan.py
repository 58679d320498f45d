"""Ordered scans over logs in which one key may hold a large part of all rows.

A window over a whole key would walk it in one task. These helpers cut each key
into blocks of consecutive order values: rows are scanned within (key, block),
one summary row per block carries what the next block needs, and only summaries
are walked per key. Where the order is a unique running number, `width` is a
hard limit on the rows of a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order values per block.
WIDTH = 1 << 16


def with_block(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / width).cast("bigint"))


def _inner(keys: list[str], order: str):
    return Window.partitionBy(*keys, "_block").orderBy(order)


def _outer(keys: list[str]):
    return Window.partitionBy(*keys).orderBy("_block")


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Adds the sum of `value` over all rows of the key up to and including this one."""
    rows = with_block(df.withColumn("_v", value), order, width)
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    before = F.coalesce(F.sum("_s").over(_outer(keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(*keys, "_block", before.alias("_carry"))
    local = F.sum("_v").over(_inner(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scanned = rows.withColumn("_local", local).join(carried, [*keys, "_block"])
    return scanned.withColumn(out, F.col("_carry") + F.col("_local")).drop("_v", "_block", "_local", "_carry")


def previous(df: DataFrame, keys: list[str], order: str, values: dict[str, str], width: int = WIDTH) -> DataFrame:
    """Adds, for each `values[name] = source`, the source of the key's previous row (null at its first)."""
    rows = with_block(df, order, width)
    state = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
    lasts = rows.groupBy(*keys, "_block").agg(F.max_by(state, order).alias("_last"))
    carried = lasts.select(*keys, "_block", F.lag("_last").over(_outer(keys)).alias("_carry"))
    scanned = rows.withColumn("_prev", F.lag(state).over(_inner(keys, order))).join(carried, [*keys, "_block"])
    found = F.coalesce("_prev", "_carry")
    return scanned.select(*df.columns, *[found[n].alias(n) for n in values])


def last_known(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = WIDTH) -> DataFrame:
    """Adds the latest non-null `value` of the key up to and including this row (an as-of join over a union)."""
    rows = with_block(df.withColumn("_v", value), order, width)
    lasts = rows.where(F.col("_v").isNotNull()).groupBy(*keys, "_block").agg(F.max_by("_v", order).alias("_last"))
    every = rows.select(*keys, "_block").distinct().join(lasts, [*keys, "_block"], "left")
    before = F.last("_last", ignorenulls=True).over(_outer(keys).rowsBetween(Window.unboundedPreceding, -1))
    carried = every.select(*keys, "_block", before.alias("_carry"))
    local = F.last("_v", ignorenulls=True).over(_inner(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    scanned = rows.withColumn("_local", local).join(carried, [*keys, "_block"])
    return scanned.select(*df.columns, F.coalesce("_local", "_carry").alias(out))
