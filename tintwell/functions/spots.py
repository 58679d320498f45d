"""Spot functions: which part of a cell fills first."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwell.functions.color import num

SHAPES = ("round", "square", "ellipse", "diamond", "line")


def cell_spot(shape: str, u: Column, v: Column) -> Column:
    """Spot value inside a square cell, u and v in -1..1 (round dots turn into round holes past half tone)."""
    au, av = F.abs(u), F.abs(v)
    if shape == "round":
        hole = num(2) - ((num(1) - au) * (num(1) - au) + (num(1) - av) * (num(1) - av))
        return F.when(au + av <= 1, u * u + v * v).otherwise(hole)
    if shape == "ellipse":
        return F.sqrt(u * u + (v / 0.65) * (v / 0.65))
    return lattice_spot(shape, u, v)


def lattice_spot(shape: str, dx: Column, dy: Column) -> Column:
    """Spot value of an offset from a lattice dot's centre; lower is inked first."""
    if shape == "square":
        return F.greatest(F.abs(dx), F.abs(dy))
    if shape == "ellipse":
        return dx * dx + (dy / 0.65) * (dy / 0.65)
    if shape == "diamond":
        return F.abs(dx) + F.abs(dy)
    if shape == "line":
        return F.abs(dy)
    if shape == "round":
        return dx * dx + dy * dy
    raise ValueError(f"unknown dot shape {shape}")


def min_dot_share(diameter: Column | float, size: Column | float) -> Column:
    """Share of a cell that the smallest allowed round dot covers."""
    d = diameter if isinstance(diameter, Column) else num(diameter)
    s = size if isinstance(size, Column) else num(size)
    return F.least(num(1), d * d * (math.pi / 4) / (s * s))


def min_dot(c: Column, diameter: Column | float, size: Column | float, mode: str = "drop") -> Column:
    """Tones below the smallest dot drop to paper, or (round, above 0.02) rise to it."""
    share = min_dot_share(diameter, size)
    low = F.when(c > 0.02, share).otherwise(num(0)) if mode == "round" else num(0)
    return F.when(c < share, low).otherwise(c)
