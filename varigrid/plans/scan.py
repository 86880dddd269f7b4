"""The scan order of points: a 300 x 300 grid, columns first, then id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 300
#: Fixed value: a maximum starts at the smallest positive normal double, so a dimension without positive values is as wide as up to it.
SMALLEST = 2.2250738585072014e-308


def extent(points: DataFrame) -> DataFrame:
    """One row: xmin, ymin, xmax, ymax."""
    return points.agg(F.min("x").alias("xmin"), F.min("y").alias("ymin"), F.max("x").alias("xmax"), F.max("y").alias("ymax"))


def scan_bins(points: DataFrame, bins: int = BINS) -> DataFrame:
    """Points with xbin and ybin. A dimension without extent has the bin 0. Reads the extent first (one row)."""
    e = extent(points).first()

    def bin_of(v: str, low: float | None, high: float | None):
        if low is None:
            return F.lit(0).cast("long")
        width = (max(high, SMALLEST) - low) * 1.01
        if width == 0:
            return F.lit(0).cast("long")
        return F.floor((F.col(v) + F.lit(-low)) / F.lit(width) * F.lit(bins)).cast("long")

    return points.withColumn("xbin", bin_of("x", e.xmin, e.xmax)).withColumn("ybin", bin_of("y", e.ymin, e.ymax))


def ranked(df: DataFrame, order: list, groups: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """Adds the 1-based rank in each group by ``order`` without sending a group to one task.

    Rows are dealt by ranges of (groups, order); each range numbers its own rows,
    and what earlier ranges of a group hold is added from their counts.
    """
    from pyspark.sql import Window

    from varigrid.plans.storage import stored

    cols = [F.col(g) for g in groups] + order
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n, *cols).withColumn("_part", F.spark_partition_id())
    part = stored(part, "ranges")
    keys = [*groups, "_part"]
    inside = part.withColumn("_in", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    counts = part.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    on = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = inside.alias("l").join(F.broadcast(counts).alias("r"), on)  # a row for each range and group that meet
    out = joined.select("l.*", (F.col("_before") + F.col("_in")).cast("long").alias(name)).drop("_part", "_in")
    out._stored_path = part._stored_path  # for discard
    return out
