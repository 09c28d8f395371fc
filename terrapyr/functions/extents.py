"""Extents, resolutions and grids, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import BuildOptions

BOX = ("x_min", "y_min", "x_max", "y_max")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def overlap(a_min, a_max, b_min, b_max) -> Column:
    """Closed intervals that touch intersect."""
    return F.greatest(col(a_min), col(b_min)) <= F.least(col(a_max), col(b_max))


def intersects(a: tuple, b: tuple, geographic: bool = True) -> Column:
    """F1. a, b: (x_min, y_min, x_max, y_max); geographic extents also meet when one is moved by a full turn."""
    a, b = [col(x) for x in a], [col(x) if not isinstance(x, (int, float)) else F.lit(float(x)) for x in b]
    turns = [overlap(a[0] + d, a[2] + d, b[0], b[2]) for d in ((0.0, 360.0, -360.0) if geographic else (0.0,))]
    x = turns[0]
    for t in turns[1:]:
        x = x | t
    return x & overlap(a[1], a[3], b[1], b[3])


def valid(box: tuple = BOX) -> Column:
    x0, y0, x1, y1 = map(col, box)
    return (x0 <= x1) & (y0 <= y1)


def has_area(box: tuple = BOX) -> Column:
    x0, y0, x1, y1 = map(col, box)
    return (x0 < x1) & (y0 < y1)


def intersection(a: tuple, b: tuple, x_offset: float = 0.0) -> list[Column]:
    """the common box after a is moved by x_offset."""
    a, b = list(map(col, a)), list(map(col, b))
    return [F.greatest(a[0] + x_offset, b[0]), F.greatest(a[1], b[1]), F.least(a[2] + x_offset, b[2]), F.least(a[3], b[3])]


def affine_extents(g0, g1, g3, g5, num_x, num_y, data_type) -> list[Column]:
    """Area cells span N steps, posts N - 1."""
    less = F.when(col(data_type) == "VECTOR", 1).otherwise(0)
    xa, xb = col(g0), col(g0) + col(g1) * (col(num_x) - less)
    ya, yb = col(g3), col(g3) + col(g5) * (col(num_y) - less)
    return [F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb)]


def post_resolution(box: tuple = BOX, num_x="num_x", num_y="num_y") -> Column:
    """The diagonal of one step between posts."""
    x0, y0, x1, y1 = map(col, box)
    dx, dy = (x1 - x0) / F.nullif(col(num_x) - 1, F.lit(0)), (y1 - y0) / F.nullif(col(num_y) - 1, F.lit(0))
    return F.sqrt(dx * dx + dy * dy)


def clamp_geographic(box: tuple = BOX) -> list[Column]:
    """F8: extents that reach beyond +-180 are cut; what lies wholly beyond is moved by a turn first."""
    x0, y0, x1, y1 = map(col, box)
    turn = F.when(x0 > 180.0, -360.0).when(x1 < -180.0, 360.0).otherwise(0.0)
    return [F.greatest(x0 + turn, F.lit(-180.0)), F.greatest(y0, F.lit(-90.0)), F.least(x1 + turn, F.lit(180.0)), F.least(y1, F.lit(90.0))]


def grid_shape(width: Column, height: Column) -> tuple[Column, Column]:
    """Columns and rows of level 1, so that tiles are about square."""
    ratio = F.greatest(width, height) / F.least(width, height)
    low, high = F.floor(ratio), F.ceil(ratio)
    n = F.when(ratio < F.sqrt(low.cast("double") * high), low).otherwise(high).cast("int")
    return F.when(width >= height, n).otherwise(1), F.when(width >= height, 1).otherwise(n)


def optimum_level(o: BuildOptions, columns: int, rows: int, cap: int, tile: Column) -> Column:
    """The coarsest level at which a tile is as fine as the source; resolution is extent / N."""

    def axis(span: float, n: int, low: str, high: str, num: str) -> Column:
        cell = (F.col(high) - F.col(low)) / F.col(num)
        return F.ceil(1 + F.log(F.lit(span) / (n * cell * tile)) / F.log(F.lit(2.0)))

    k = F.greatest(axis(o.width, columns, "x_min", "x_max", "num_x"), axis(o.height, rows, "y_min", "y_max", "num_y"))
    return F.greatest(F.lit(0), F.least(k, F.col("max_level"), F.lit(cap))).cast("int")


def usable_tile(o: BuildOptions) -> Column:
    """Image tiles lose a border of two pixels, terrain tiles one post."""
    return F.when(F.col("source_type") == "IMAGE", o.image_tile - 2).otherwise(o.terrain_tile - 1)


def geocentric(lat: Column, lon: Column, height: Column, a: float, b: float) -> list[Column]:
    """Degrees and metres to earth-centred metres."""
    e2 = (a * a - b * b) / (a * a)
    p, l = F.radians(lat), F.radians(lon)
    n = F.lit(a) / F.sqrt(1 - F.lit(e2) * F.sin(p) * F.sin(p))
    return [(n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - e2) + height) * F.sin(p)]
