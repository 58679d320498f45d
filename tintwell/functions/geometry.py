"""Rectangles, tilted frames, borders: row expressions over image records."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tintwell.functions.color import bisect, let, num


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))


def fits(r: Column, width: Column, height: Column, degrees: Column) -> Column:
    """Does a rectangle lie inside the photo tilted about the frame centre (half a pixel of slack)?"""
    a = F.radians(degrees)
    c, s = F.cos(a), F.sin(a)
    x0, y0 = r["x"] - width / 2, r["y"] - height / 2
    corners = F.array(
        *[
            F.struct((x0 + r["w"] * i).alias("dx"), (y0 + r["h"] * j).alias("dy"))
            for j in (0, 1)
            for i in (0, 1)
        ]
    )
    return F.forall(
        corners,
        lambda p: (F.abs(c * p["dx"] + s * p["dy"]) <= width / 2 + 0.5) & (F.abs(c * p["dy"] - s * p["dx"]) <= height / 2 + 0.5),
    )


def largest_rect(width: Column, height: Column, degrees: Column, aspect: Column) -> Column:
    """Largest centred rectangle of an aspect (width / height) inside the tilted photo."""
    a = F.radians(degrees)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    hh = F.least(width / 2 / (aspect * c + s), height / 2 / (aspect * s + c))
    hw = aspect * hh
    return rect(width / 2 - hw, height / 2 - hh, hw * 2, hh * 2)


def blend_rect(a: Column, b: Column, t: Column) -> Column:
    return rect(*[a[k] + (b[k] - a[k]) * t for k in ("x", "y", "w", "h")])


def keep_inside(r: Column, width: Column, height: Column, degrees: Column) -> Column:
    """The rectangle itself if it fits, else the last fitting one (30 halvings) from the largest centred one towards it."""
    bound = F.struct(
        r.alias("r"),
        largest_rect(width, height, degrees, r["w"] / r["h"]).alias("safe"),
        width.cast("double").alias("w"),
        height.cast("double").alias("h"),
        degrees.alias("deg"),
    )

    def search(e: Column) -> Column:
        t = bisect(lambda mid: fits(blend_rect(e["safe"], e["r"], mid), e["w"], e["h"], e["deg"]), num(0), num(1), 30)
        moved = let(t, lambda k: blend_rect(e["safe"], e["r"], k))
        return F.when(fits(e["r"], e["w"], e["h"], e["deg"]), e["r"]).otherwise(moved)

    return let(bound, search)


def turned_point(x: Column, y: Column, width: Column, height: Column, turn: Column) -> tuple[Column, Column]:
    """Pixel position after a clockwise quarter turn of 0, 90, 180 or 270 degrees."""
    tx = F.when(turn == 90, height - 1 - y).when(turn == 180, width - 1 - x).when(turn == 270, y).otherwise(x)
    ty = F.when(turn == 90, x).when(turn == 180, height - 1 - y).when(turn == 270, width - 1 - x).otherwise(y)
    return tx, ty


def border_geometry(width: Column, height: Column, frame: Column, thickness: Column, radius: Column, ink: Column, ink_count: Column) -> Column:
    """Border of an image, in image pixels: margin it adds, opening it leaves, corner radius, mode and ink."""
    short = F.least(width, height)
    unit = short / 100
    mode = F.when(frame == "ink", 1).when(frame == "paper", 2).otherwise(0)
    t = F.when(mode == 0, num(0)).otherwise(thickness * unit)
    margin = F.greatest(num(0), t)
    inset = F.least(F.greatest(num(0), -t), short / 2)
    clear = short - inset * 2
    return F.struct(
        margin.alias("margin"),
        inset.alias("x0"),
        inset.alias("y0"),
        (width - inset).alias("x1"),
        (height - inset).alias("y1"),
        F.when(mode == 0, num(0)).otherwise(F.least(radius * unit, clear / 2)).alias("radius"),
        mode.alias("mode"),
        F.greatest(F.lit(0), F.least(ink_count - 1, F.coalesce(ink, F.lit(0)))).alias("ink"),
    )


def rounded_rect_sdf(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column, radius: Column) -> Column:
    """Signed distance to a rounded rectangle, negative inside."""
    qx = F.abs(px - (x0 + x1) * 0.5) - (x1 - x0) * 0.5 + radius
    qy = F.abs(py - (y0 + y1) * 0.5) - (y1 - y0) * 0.5 + radius
    ox, oy = F.greatest(qx, num(0)), F.greatest(qy, num(0))
    return F.sqrt(ox * ox + oy * oy) + F.least(F.greatest(qx, qy), num(0)) - radius


def rotate(x: Column, y: Column, radians: Column | float) -> tuple[Column, Column]:
    if isinstance(radians, Column):
        c, s = F.cos(radians), F.sin(radians)
    else:
        c, s = num(math.cos(radians)), num(math.sin(radians))
    return c * x - s * y, s * x + c * y
