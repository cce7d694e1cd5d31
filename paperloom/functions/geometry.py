"""Rectangles and affine matrices as columns. A matrix is array<double> a, b, c, d, e, f; a box is a struct of x, y, width and height."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation(r: Column) -> Column:
    """To the nearest of 0, 90, 180 and 270 degrees."""
    return F.pmod(F.floor(r / 90 + 0.5) * 90, F.lit(360)).cast("int")


def viewport(x: Column, y: Column, width: Column, height: Column, rotated: Column, scale: Column) -> Column:
    """The matrix from a page's user space, y upwards, to its rotated view, y downwards."""
    zero = F.lit(0.0)
    by = {0: (scale, zero, zero, -scale, -x, y + height), 90: (zero, scale, scale, zero, -y, -x), 180: (-scale, zero, zero, scale, x + width, -y), 270: (zero, -scale, -scale, zero, y + height, x + width)}
    out = None
    for angle, (a, b, c, d, e, f) in by.items():
        m = F.array(a, b, c, d, e * scale, f * scale)
        out = F.when(rotated == angle, m) if out is None else out.when(rotated == angle, m)
    return out


def inverse(m: Column) -> Column:
    """Fails on a singular matrix."""
    det = m[0] * m[3] - m[1] * m[2]
    det = F.when(det == 0, F.raise_error(F.lit("singular matrix")).cast("double")).otherwise(det)
    return F.array(m[3] / det, -m[1] / det, -m[2] / det, m[0] / det, (m[2] * m[5] - m[3] * m[4]) / det, (m[1] * m[4] - m[0] * m[5]) / det)


def applied(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def transformed(m: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The box around the four moved corners."""
    corners = [applied(m, x + dx, y + dy) for dx in (0, width) for dy in (0, height)]
    (left, right), (low, high) = ((F.least(*c), F.greatest(*c)) for c in zip(*corners, strict=True))
    return F.struct(left.alias("x"), low.alias("y"), (right - left).alias("width"), (high - low).alias("height"))


def degenerate(x: Column, y: Column, width: Column, height: Column) -> Column:
    odd = [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in (x, y, width, height)]
    return odd[0] | odd[1] | odd[2] | odd[3] | (width <= 0) | (height <= 0)


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that only touch don't."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def contains(box: Column, x: Column, y: Column) -> Column:
    return (box["x"] <= x) & (x <= box["x"] + box["width"]) & (box["y"] <= y) & (y <= box["y"] + box["height"])


def area(box: Column) -> Column:
    return box["width"] * box["height"]


def expanded(box: Column, by: float) -> Column:
    return F.struct((box["x"] - by).alias("x"), (box["y"] - by).alias("y"), (box["width"] + 2 * by).alias("width"), (box["height"] + 2 * by).alias("height"))


def page_matrix(page: Column, rotated: Column, scale: Column) -> Column:
    """The viewport's matrix of a page: a struct of x, y, width, height, rotation and unit, shown at that rotation and scale."""
    return viewport(page["x"], page["y"], page["width"], page["height"], rotation(rotated), scale * page["unit"])


def page_size(page: Column, rotated: Column, scale: Column) -> Column:
    """Width and height of the viewport; the sides change places at a quarter turn."""
    w, h = page["width"] * scale * page["unit"], page["height"] * scale * page["unit"]
    turned = rotation(rotated).isin(90, 270)
    return F.struct(F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def parser_matrix(page: Column) -> Column:
    """From user space to the space of a parser's coordinates: the page as it is turned, in its own unit whatever that stands for."""
    return viewport(page["x"], page["y"], page["width"], page["height"], rotation(page["rotation"]), F.lit(1.0))


def moved(matrix: Column, box: Column) -> Column:
    return transformed(matrix, box["x"], box["y"], box["width"], box["height"])


def in_space(box: Column, space: Column | str, expected: str) -> Column:
    """The box; fails if it is in another space."""
    s = F.col(space) if isinstance(space, str) else space
    return F.when(s.eqNullSafe(F.lit(expected)), box).otherwise(F.raise_error(F.concat(F.lit(f"expected a box in {expected}, got "), F.coalesce(s, F.lit("none")))))


def _turned_back(box: Column, page: Column, rotated: Column, scale: Column) -> Column:
    """The inverse of the viewport's matrix on boxes, written out for each turn: generic inversion would repeat the matrix in every term."""
    (left, right_), (low, high) = [(box[c] / scale, (box[c] + box[n]) / scale) for c, n in (("x", "width"), ("y", "height"))]
    angle = rotation(rotated)
    right, top = page["x"] + page["width"], page["y"] + page["height"]
    x = F.when(angle == 0, page["x"] + left).when(angle == 90, page["x"] + low).when(angle == 180, right - right_).otherwise(right - high)
    y = F.when(angle == 0, top - high).when(angle == 90, page["y"] + left).when(angle == 180, page["y"] + low).otherwise(top - right_)
    w, h = box["width"] / scale, box["height"] / scale
    turned = angle.isin(90, 270)
    return F.struct(x.alias("x"), y.alias("y"), F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def user_from_parser(box: Column, page: Column) -> Column:
    return _turned_back(box, page, page["rotation"], F.lit(1.0))


def parser_from_user(box: Column, page: Column) -> Column:
    return moved(parser_matrix(page), box)


def viewport_from_user(box: Column, page: Column, rotated: Column, scale: Column) -> Column:
    return moved(page_matrix(page, rotated, scale), box)


def user_from_viewport(box: Column, page: Column, rotated: Column, scale: Column) -> Column:
    return _turned_back(box, page, rotated, scale * page["unit"])


def item_box(m: Column, width: Column, height: Column) -> Column:
    """The box of a text item: its sides run along the matrix's directions, along the axes where these have no length."""
    lx, ly = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    ux, uy = (F.when(lx == 0, a).otherwise(b / F.nullif(lx, F.lit(0.0))) for a, b in ((1.0, m[0]), (0.0, m[1])))
    vx, vy = (F.when(ly == 0, a).otherwise(b / F.nullif(ly, F.lit(0.0))) for a, b in ((0.0, m[2]), (1.0, m[3])))
    xs = [m[4] + a + b for a in (F.lit(0.0), ux * width) for b in (F.lit(0.0), vx * height)]
    ys = [m[5] + a + b for a in (F.lit(0.0), uy * width) for b in (F.lit(0.0), vy * height)]
    (left, right), (low, high) = ((F.least(*c), F.greatest(*c)) for c in (xs, ys))
    return F.struct(left.alias("x"), low.alias("y"), (right - left).alias("width"), (high - low).alias("height"))


def part_of(box: Column, start: Column, end: Column, length: Column) -> Column:
    """The box of some of an item's characters, in proportion; the whole box of an empty item."""
    n = F.nullif(length, F.lit(0))
    x, width = box["x"] + box["width"] * start / n, box["width"] * (end - start) / n
    return F.struct(F.coalesce(x, box["x"]).alias("x"), box["y"].alias("y"), F.coalesce(width, box["width"]).alias("width"), box["height"].alias("height"))


def union_box(box: Column) -> Column:
    """The box around all boxes of a group."""
    left, low = F.min(box["x"]), F.min(box["y"])
    right, high = F.max(box["x"] + box["width"]), F.max(box["y"] + box["height"])
    return F.struct(left.alias("x"), low.alias("y"), (right - left).alias("width"), (high - low).alias("height"))
