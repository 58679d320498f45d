"""Layer options on coverage columns c0..c3, and ink usage reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tintwell.functions.color import num
from tintwell.operators.curves import lookup
from tintwell.operators.spatial import trap
from tintwell.operators.split import MAX_INKS

#: Limits from here up mean "no limit".
NO_LIMIT = 3.995


def knockout(cov: list[Column], flags: list[bool]) -> list[Column]:
    """Each knockout layer, from the top down, clears the layers printed before it where it has ink."""
    out = list(cov)
    for i in range(len(out) - 1, 0, -1):
        if flags[i]:
            out[:i] = [c * (num(1) - out[i]) for c in out[:i]]
    return out


def ink_limit(cov: list[Column], limit: float) -> list[Column]:
    """Scales all inks where their sum passes the limit."""
    if limit >= NO_LIMIT:
        return list(cov)
    total = cov[0]
    for c in cov[1:]:
        total = total + c
    return [F.when(total > limit, c * num(limit) / total).otherwise(c) for c in cov]


def layer_options(cov: DataFrame, tone: list[list[float]] | None, flags: list[bool], radius: list[float], limit: float) -> DataFrame:
    """Tone tables, then knockout, then choke or spread, then the total ink limit."""
    names = [f"c{k}" for k in range(MAX_INKS)]
    keep = [c for c in cov.columns if c not in names]
    if tone:
        cov = cov.select(*keep, *[lookup(tone[k], F.col(n)).alias(n) for k, n in enumerate(names)])
    cleared = knockout([F.col(n) for n in names], flags)
    # Separate projections keep each step's columns from being expanded into the next.
    cov = cov.select(*keep, *[c.alias(n) for c, n in zip(cleared, names)])
    if any(abs(r) > 0.01 for r in radius):
        cov = trap(cov, radius)
    return cov.select(*keep, *[c.alias(n) for c, n in zip(ink_limit([F.col(n) for n in names], limit), names)])


def mask_alpha(cov: list[Column], alpha: Column) -> list[Column]:
    """Transparent pixels take no ink (alpha 0..1)."""
    return [c * alpha for c in cov]


def visible_inks(settings: DataFrame, keys: list[str]) -> DataFrame:
    """Inks shown: the soloed ones if there are any, else those not muted.

    `settings`: keys, ink, solo, mute. One aggregation finds palettes with a
    solo; inks join back on the same keys.
    """
    solos = settings.groupBy(*keys).agg(F.bool_or("solo").alias("_any"))
    shown = F.when(F.col("_any"), F.col("solo")).otherwise(~F.col("mute"))
    return settings.join(solos, keys).where(shown).select(*keys, "ink")


def to_long(cov: DataFrame) -> DataFrame:
    """Wide coverage (c0..c3) to rows (…, ink, c)."""
    keep = [c for c in cov.columns if c not in {f"c{k}" for k in range(MAX_INKS)}]
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias("ink"), F.col(f"c{k}").alias("c")) for k in range(MAX_INKS)]))
    return cov.select(*keep, stacked.alias("_s")).select(*keep, "_s.ink", "_s.c")


def to_wide(cov: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, ink, c) to c0..c3, absent inks 0."""
    return cov.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("ink") == k, F.col("c"))), num(0)).alias(f"c{k}") for k in range(MAX_INKS)])


def ink_usage(cov: DataFrame, keys: list[str], rollup: bool = False) -> DataFrame:
    """Mean, maximum and inked share of every ink, and the largest total.

    All inks of a pixel are aggregated in place (no explode before the shuffle);
    only one row per group is turned into one row per ink. Partial aggregation
    makes a hot image cost no more than any other.
    """
    names = [f"c{k}" for k in range(MAX_INKS)]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    grouped = cov.rollup(*keys) if rollup else cov.groupBy(*keys)
    stats = grouped.agg(
        F.count("*").alias("pixels"),
        F.max(total).alias("max_total"),
        *[F.avg(n).alias(f"mean_{n}") for n in names],
        *[F.max(n).alias(f"max_{n}") for n in names],
        *[F.avg((F.col(n) > 0).cast("double")).alias(f"inked_{n}") for n in names],
    )
    inks = F.array(
        *[
            F.struct(F.lit(k).alias("ink"), F.col(f"mean_{n}").alias("mean"), F.col(f"max_{n}").alias("max"), F.col(f"inked_{n}").alias("inked"))
            for k, n in enumerate(names)
        ]
    )
    return stats.select(*keys, "pixels", "max_total", F.explode(inks).alias("s")).select(*keys, "s.ink", "pixels", "max_total", "s.mean", "s.max", "s.inked")
