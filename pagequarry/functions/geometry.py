"""Geometry of boxes and polygons as column expressions. Coordinates are relative to the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def bbox_to_polygon(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners in the order top left, top right, bottom left, bottom right."""
    return F.array(point(x0, y0), point(x1, y0), point(x0, y1), point(x1, y1))


def polygon_to_bbox(poly: Column) -> Column:
    xs, ys = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def order_points(poly: Column) -> Column:
    """Four corners clockwise on the page, from the one of the least x + y."""
    n = F.size(poly)
    cx = F.aggregate(poly, F.lit(0.0), lambda a, p: a + p["x"]) / n
    cy = F.aggregate(poly, F.lit(0.0), lambda a, p: a + p["y"]) / n
    around = F.array_sort(F.transform(poly, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), p["x"].alias("x"), p["y"].alias("y"))))
    least = F.array_min(F.transform(around, lambda p, i: F.struct((p["x"] + p["y"]).alias("s"), i.alias("i"))))["i"]
    return F.transform(F.concat(F.slice(around, least + 1, n), F.slice(around, F.lit(1), least)), lambda p: point(p["x"], p["y"]))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x1 - x0) * (y1 - y0)


def iou(a: str, b: str) -> Column:
    """Intersection over union of two boxes in columns {a}x0..., {b}x0...; 0 where the union is empty."""
    c = lambda s, n: F.col(f"{s}{n}")
    w = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    union = area(*[c(a, n) for n in ("x0", "y0", "x1", "y1")]) + area(*[c(b, n) for n in ("x0", "y0", "x1", "y1")]) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def rotate_point(x: Column, y: Column, degrees: Column, height: int, width: int) -> tuple[Column, Column]:
    """A relative point turned about the page's centre, in the page's own pixels."""
    a = F.radians(degrees)
    dx, dy = (x - 0.5) * width, (y - 0.5) * height
    return (dx * F.cos(a) - dy * F.sin(a)) / width + 0.5, (dx * F.sin(a) + dy * F.cos(a)) / height + 0.5


def to_relative(value: Column, size: int) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / size))


def edge_angle(xl: Column, yl: Column, xr: Column, yr: Column) -> Column:
    """Angle of an edge in degrees; upright edges give 90 or -90, no edge gives null."""
    dx, dy = xr - xl, yl - yr
    return F.when(dx != 0, F.degrees(F.atan(F.try_divide(dy, dx)))).when(dy > 0, F.lit(90.0)).when(dy < 0, F.lit(-90.0))


def corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Corners of a box clockwise from the top left."""
    return F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))


def detach_score(box: Column) -> Column:
    """struct(box, score) of an array of four coordinates and a score."""
    return F.struct(F.slice(box, 1, F.size(box) - 1).alias("box"), F.element_at(box, -1).alias("score"))


def turn_point(x: Column, y: Column, degrees: Column) -> Column:
    """A point turned about the origin, against the clock where y grows upwards."""
    a = F.radians(degrees)
    return point(x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a))


def expanded_shape(height: Column, width: Column, degrees: Column) -> Column:
    """struct(height, width) of the upright box around a turned page."""
    a = F.radians(degrees)
    s, c = F.abs(F.sin(a)), F.abs(F.cos(a))
    return F.struct((width * s + height * c).alias("height"), (width * c + height * s).alias("width"))


def rotate_absolute(poly: Column, degrees: Column, height: Column, width: Column, expand: bool = True) -> Column:
    """A polygon in pixels turned about the page's centre and clipped to the page, or to the page it needs."""
    to = expanded_shape(height, width, degrees)
    h, w = (to["height"], to["width"]) if expand else (height, width)

    def one(p: Column) -> Column:
        t = turn_point(p["x"] - width / 2, height / 2 - p["y"], degrees)
        return point(F.least(w, F.greatest(F.lit(0.0), t["x"] + w / 2)), F.least(h, F.greatest(F.lit(0.0), h / 2 - t["y"])))

    return F.transform(poly, one)


def remap(poly: Column, from_height: Column, from_width: Column, to_height: Column, to_width: Column) -> Column:
    """A relative polygon as seen from another canvas with the same centre."""
    return F.transform(poly, lambda p: point((p["x"] * from_width + (to_width - from_width) / 2) / to_width, (p["y"] * from_height + (to_height - from_height) / 2) / to_height))


def rotate_relative(poly: Column, degrees: Column, height: Column, width: Column, min_angle: float = 1.0) -> Column:
    """A relative polygon turned about the page's centre; turns of next to nothing or next to a right angle are left out."""
    a = F.radians(degrees)

    def one(p: Column) -> Column:
        dx, dy = (p["x"] - 0.5) * width, (p["y"] - 0.5) * height
        return point((dx * F.cos(a) + dy * F.sin(a)) / width + 0.5, (dy * F.cos(a) - dx * F.sin(a)) / height + 0.5)

    return F.when((F.abs(degrees) < min_angle) | (F.abs(degrees) > 90 - min_angle), poly).otherwise(F.transform(poly, one))


def without_padding(x: Column, y: Column, height: Column, width: Column, symmetric: bool = True) -> Column:
    """A relative point of a square canvas on the page that was padded to it; the longer side fills the canvas."""
    wide, high = height / width, width / height
    grow = lambda v, by: (v - 0.5) * by + 0.5 if symmetric else v * by
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    return point(clip(F.when(height > width, grow(x, wide)).otherwise(x)), clip(F.when(width > height, grow(y, high)).otherwise(y)))


def affine(x: Column, y: Column, matrix: list[float]) -> Column:
    """A point under the first two rows of an affine matrix."""
    a, b, c, d, e, f = matrix
    return point(x * a + y * b + c, x * d + y * e + f)


def center(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return point((x0 + x1) / 2, (y0 + y1) / 2)


def in_polygon(x: Column, y: Column, poly: Column) -> Column:
    """Whether a point is inside a polygon, by the parity of edges to its right."""
    n = F.size(poly)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(poly, (i + n - 1) % n)
        edge = (q["x"] - p["x"]) * (y - p["y"]) / (q["y"] - p["y"] + F.lit(1e-12)) + p["x"]
        return (((p["y"] > y) != (q["y"] > y)) & (x < edge)).cast("int")

    return F.aggregate(F.transform(poly, crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def roll(poly: Column, steps: Column) -> Column:
    """The corners of a polygon, ``steps`` places further on; the last come first."""
    k = F.pmod(steps, F.size(poly))
    return F.concat(F.slice(poly, F.size(poly) - k + 1, k), F.slice(poly, F.lit(1), F.size(poly) - k))


def turned_box(cx: Column, cy: Column, w: Column, h: Column, sin: Column, cos: Column) -> Column:
    """Corners of a box given by centre, sides and the direction of its angle; ``order_points`` puts them in order."""
    a = F.atan2(sin, cos)
    c, s = F.cos(a), F.sin(a)
    at = lambda u, v: point(cx + u * w / 2 * c - v * h / 2 * s, cy + u * w / 2 * s + v * h / 2 * c)
    return F.array(at(-1, -1), at(1, -1), at(1, 1), at(-1, 1))


def top_edge_angle(poly: Column, height: Column, width: Column) -> Column:
    """Degrees of the edge between the first two corners of a relative polygon, up being positive."""
    return -F.degrees(F.atan2((poly[1]["y"] - poly[0]["y"]) * height, (poly[1]["x"] - poly[0]["x"]) * width))


def folded(degrees: Column) -> Column:
    """An angle as that of an undirected line, from -90 up to 90."""
    return F.pmod(degrees + 90, F.lit(180.0)) - 90


def canonical(x0: Column, y0: Column, x1: Column, y1: Column, least: Column, most: Column, direction: str) -> Column:
    """A box as it would lie if its script ran from left to right; ``least`` and ``most`` bound the page's boxes in x."""
    box = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    if direction == "ltr":
        return box(x0, y0, x1, y1)
    if direction == "rtl":
        return box(least + most - x1, y0, least + most - x0, y1)
    if direction == "ttb-ltr":
        return box(y0, x0, y1, x1)
    if direction == "ttb-rtl":
        return box(y0, least + most - x1, y1, least + most - x0)
    raise ValueError(f"no reading direction {direction!r}")


def flip(x0: Column, x1: Column) -> tuple[Column, Column]:
    """Left and right of a box on the mirrored page."""
    return 1 - x1, 1 - x0


def crop(box: list[Column], to: tuple[float, float, float, float]) -> Column:
    """A relative box on a crop of the page, null if nothing is left of it."""
    x0, y0, x1, y1 = to
    cut = lambda v, lo, hi: (F.least(F.lit(hi), F.greatest(F.lit(lo), v)) - lo) / (hi - lo)
    a, b, c, d = cut(box[0], x0, x1), cut(box[1], y0, y1), cut(box[2], x0, x1), cut(box[3], y0, y1)
    return F.when((a < c) & (b < d), F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1")))


def grid_span(near: Column, far: Column, other_near: Column, other_far: Column, span: Column) -> Column:
    """struct(first, last) of a cell on one axis of a table, counted from 1.

    ``near`` and ``far`` are the readings of the two corners on the axis' starting side, the others those of the
    opposite side, which name the next cell. Sides whose readings round alike decide, the starting side first; else
    the side whose readings differ less.
    """
    n = F.greatest(F.lit(1), span)
    whole = lambda v: F.greatest(F.lit(1), F.rint(v).cast("int"))
    from_start = lambda v: F.struct(v.alias("first"), (v + n - 1).alias("last"))

    def from_end(v: Column) -> Column:
        last = F.greatest(n + 1, v) - 1
        return F.struct((last + 1 - n).alias("first"), last.alias("last"))

    return (
        F.when(whole(near) == whole(far), from_start(whole(near)))
        .when(whole(other_near) == whole(other_far), from_end(whole(other_near)))
        .when(F.abs(near - far) <= F.abs(other_near - other_far), from_start(whole((near + far) / 2)))
        .otherwise(from_end(F.rint((other_near + other_far) / 2).cast("int")))
    )


def pixel_box(box: list[Column], height: Column, width: Column) -> Column:
    """``bbox x0 y0 x1 y1`` in whole pixels, halves to the even one."""
    px = lambda v, size: F.rint(v * size).cast("int")
    return F.format_string("bbox %d %d %d %d", px(box[0], width), px(box[1], height), px(box[2], width), px(box[3], height))
