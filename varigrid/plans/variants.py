"""Parameter settings: checks, orders and which earlier one a setting can start from."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "variant_id int, epsilon double, minpts int"


def checked(eps: Sequence[float], minpts: Sequence[float]) -> list[tuple[int, float, int]]:
    """(variant_id, epsilon, minpts) in the caller's order. Fractions of minpts are cut off."""
    if len(eps) != len(minpts):
        raise ValueError(f"{len(eps)} values of epsilon and {len(minpts)} of minpts")
    out = [(i, float(e), int(m)) for i, (e, m) in enumerate(zip(eps, minpts, strict=True))]
    for _, e, _ in out:
        if not (math.isfinite(e) and e >= 0):
            raise ValueError(f"epsilon {e}")
    return out


def variants_frame(spark: SparkSession, rows: Sequence[tuple[int, float, int]]) -> DataFrame:
    return spark.createDataFrame(list(rows), SCHEMA)


def growing_order(variants: DataFrame) -> DataFrame:
    """Position by epsilon ascending, then minpts descending: each can contain the clusters of those before it."""
    return variants.withColumn("position", F.row_number().over(Window.orderBy(F.asc("epsilon"), F.desc("minpts"), "variant_id")))


def shrinking_order(variants: DataFrame) -> DataFrame:
    """Position by epsilon descending, then minpts ascending: the largest neighbour table first."""
    return variants.withColumn("position", F.row_number().over(Window.orderBy(F.desc("epsilon"), F.asc("minpts"), "variant_id")))


def parents(variants: DataFrame) -> DataFrame:
    """(variant_id, parent_id): the last variant before in growing order whose minpts isn't smaller; null if none."""
    o = growing_order(variants)
    a, b = o.alias("a"), o.alias("b")
    pairs = a.join(b, (F.col("b.position") < F.col("a.position")) & (F.col("b.minpts") >= F.col("a.minpts")), "left")
    return pairs.groupBy(F.col("a.variant_id").alias("variant_id")).agg(F.max_by("b.variant_id", "b.position").alias("parent_id"))


def scratch_list(variants: DataFrame) -> DataFrame:
    """Variants with ``scratch``: whether it is the first of its epsilon in growing order and so needs a table of its own."""
    before = F.lag("epsilon").over(Window.orderBy("position"))
    return growing_order(variants).withColumn("scratch", before.isNull() | (before != F.col("epsilon")))


def parents_of(rows: Sequence[tuple[int, float, int]]) -> dict[int, int | None]:
    """As parents, on the driver's own list."""
    order = sorted(rows, key=lambda v: (v[1], -v[2], v[0]))
    return {v[0]: next((w[0] for w in reversed(order[:i]) if w[2] >= v[2]), None) for i, v in enumerate(order)}
