"""Column expressions on points, boxes and cells. All stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def distance(x1, y1, x2, y2) -> Column:
    """Euclidean distance; the expression's order fixes its rounding."""
    dx, dy = col(x1) - col(x2), col(y1) - col(y2)
    return F.sqrt(dx * dx + dy * dy)


def box_around(x, y, eps) -> list[Column]:
    """xmin, ymin, xmax, ymax of the square of half side eps around a point; eps 0 gives the point's own box."""
    x, y, e = col(x), col(y), F.lit(eps) if not isinstance(eps, Column) else eps
    return [(x - e).alias("xmin"), (y - e).alias("ymin"), (x + e).alias("xmax"), (y + e).alias("ymax")]


def expand_box(eps, prefix: str = "") -> list[Column]:
    """A box grown by eps on all sides."""
    e = F.lit(eps) if not isinstance(eps, Column) else eps
    return [(F.col(f"{prefix}{c}") + s * e).alias(c) for c, s in (("xmin", -1), ("ymin", -1), ("xmax", 1), ("ymax", 1))]


def box_of_corners(x1, y1, x2, y2) -> list[Column]:
    """The box that two opposite corners span, in whatever order they come."""
    return [F.least(x1, x2).alias("xmin"), F.least(y1, y2).alias("ymin"), F.greatest(x1, x2).alias("xmax"), F.greatest(y1, y2).alias("ymax")]


def overlap(a: str, b: str) -> Column:
    """Whether two closed boxes, column prefixes a and b, meet."""
    c = lambda p, n: F.col(f"{p}{n}")
    return (c(a, "xmin") <= c(b, "xmax")) & (c(b, "xmin") <= c(a, "xmax")) & (c(a, "ymin") <= c(b, "ymax")) & (c(b, "ymin") <= c(a, "ymax"))


def density(n, xmin, ymin, xmax, ymax) -> Column:
    """Points per area of a box; null for a box without area."""
    area = (col(xmax) - col(xmin)) * (col(ymax) - col(ymin))
    return F.when(area != 0, col(n) / area)


def cell(v, width: float, origin: float = 0.0) -> Column:
    """Number of the cell of this width that a coordinate lies in."""
    return F.floor((col(v) - F.lit(float(origin))) / F.lit(float(width))).cast("long")


def degree_bin(v) -> Column:
    """One-degree bin: the least whole number not below the coordinate."""
    return F.ceil(col(v)).cast("long")
