"""Rectangle algebra on columns x0, y0, x1, y1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iou(a: str, b: str) -> Column:
    """Intersection over union of two rectangles with these column prefixes; 0 if they don't meet."""
    c = lambda p, n: F.col(f"{p}{n}")
    width = F.greatest(F.lit(0.0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    height = F.greatest(F.lit(0.0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    both = width * height
    union = area(a) + area(b) - both
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(both / union)


def in_edge_zone(width: float, height: float, x: float, y: float) -> Column:
    return (F.col("y1") <= y * height) | (F.col("y0") >= (1 - y) * height) | (F.col("x1") <= x * width) | (F.col("x0") >= (1 - x) * width)
