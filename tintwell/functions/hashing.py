"""Keyed 32-bit hashes as Column expressions, for draws that do not depend on row order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwell.functions.color import let

MASK = 0xFFFFFFFF


def _u32(v: Column) -> Column:
    return v.bitwiseAND(F.lit(MASK).cast("bigint"))


def wrap_mul(a: Column, b: Column | int) -> Column:
    """32-bit product that wraps; halves keep every step inside 63 bits."""
    m = b.cast("bigint") if isinstance(b, Column) else F.lit(b & MASK).cast("bigint")
    a = a.cast("bigint")
    low = a.bitwiseAND(F.lit(0xFFFF).cast("bigint")) * m
    high = _u32(F.shiftright(a, 16) * m).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    return _u32(low + F.shiftleft(high, 16))


def pcg(v: Column) -> Column:
    """One PCG-style permutation of an unsigned 32-bit value."""

    def permute(s: Column) -> Column:
        shift = (F.shiftright(s, 28) + 4).cast("double")
        # Integer division by a power of two is the unsigned shift by a column.
        mixed = F.floor(s / F.pow(F.lit(2.0), shift)).cast("bigint").bitwiseXOR(s)
        return let(mixed, lambda m: let(wrap_mul(m, 277803737), lambda w: F.shiftright(w, 22).bitwiseXOR(w)))

    return let(_u32(v.cast("bigint")), lambda u: let(_u32(wrap_mul(u, 747796405) + 2891336453), permute))


def pcg_uniform(base: Column, k: int) -> Column:
    """Draw number k of a keyed stream, uniform in [0, 1)."""
    mixed = _u32(base.cast("bigint") + ((k * 0x9E3779B9) & MASK))
    return F.shiftright(pcg(mixed), 8) / 16777216.0


def pcg_array(v: np.ndarray) -> np.ndarray:
    """`pcg` of an array."""
    mask = np.uint64(MASK)
    s = ((v.astype(np.uint64) & mask) * np.uint64(747796405) + np.uint64(2891336453)) & mask
    w = (((s >> ((s >> np.uint64(28)) + np.uint64(4))) ^ s) * np.uint64(277803737)) & mask
    return (w >> np.uint64(22)) ^ w


def uniform_array(base: np.ndarray, k: int) -> np.ndarray:
    """`pcg_uniform` of an array."""
    mixed = base.astype(np.uint64) + np.uint64((k * 0x9E3779B9) & MASK)
    return (pcg_array(mixed) >> np.uint64(8)) / 16777216.0


def mulberry(seed: Column, k: int = 0) -> Column:
    """Draw number k of a Mulberry32 stream with the given seed, uniform in [0, 1)."""
    one, odd = F.lit(1).cast("bigint"), F.lit(61).cast("bigint")

    def finish(t: Column) -> Column:
        return _u32(t + wrap_mul(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(odd))).bitwiseXOR(t)

    def mix(a: Column) -> Column:
        return let(wrap_mul(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(one)), lambda t: let(finish(t), lambda u: u.bitwiseXOR(F.shiftright(u, 14))))

    return let(_u32(_u32(seed.cast("bigint")) + (((k + 1) * 0x6D2B79F5) & MASK)), mix) / 4294967296.0
