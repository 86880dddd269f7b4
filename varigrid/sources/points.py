"""Sources and sinks of points, variants and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varigrid.functions.geometry import cell
from varigrid.plans import variants as V

#: Centres of the clustered generator.
CENTRES = ((20.0, 20.0), (20.0, 345.0), (90.0, 180.0), (160.0, 20.0), (160.0, 345.0), (90.0, 355.0), (90.0, 5.0))


def as_points(df: DataFrame, id: str = "id", x: str = "x", y: str = "y", keep: Sequence[str] = ()) -> DataFrame:  # noqa: A002
    """(id bigint, x double, y double) and the columns to keep; rows with a null, NaN or infinite value are left out, as they have no neighbours."""
    p = df.select(F.col(id).cast("long").alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *keep)
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return p.filter(F.col("id").isNotNull() & fine("x") & fine("y"))


def numbered(files: DataFrame) -> DataFrame:
    """Adds ``id``, the row's position from 0 in the order of file names, to a frame as read from files.

    Rows of one block of a file are numbered as they are read; what is before the
    block is a sum over one count a block.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    blocks = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return rows.join(blocks, ["_file", "_block"]).select(*files.columns, (F.col("_before") + F.col("_row") - F.col("_first")).cast("long").alias("id"))


def read_points_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless x,y; ids are row positions."""
    return as_points(numbered(spark.read.schema("x double, y double").csv(path)))


def remap_latitude(lat) -> F.Column:
    """Latitude 90..-90 to 0..180 from the north pole."""
    return F.when(lat > 0, (90 - lat) / 90 * 90).otherwise((-lat / 90) * 90 + 90)


def geo_points(df: DataFrame) -> DataFrame:
    """(id, longitude, latitude, ...) to points: x from latitude, y the longitude."""
    return as_points(df.select("id", remap_latitude(F.col("latitude")).alias("x"), F.col("longitude").alias("y")))


def read_geo_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless longitude,latitude,value[,time]; value and time are not used."""
    return geo_points(numbered(spark.read.schema("longitude double, latitude double, tec double, time string").csv(path)))


def read_variants_csv(spark: SparkSession, path: str) -> DataFrame:
    """Headerless epsilon,minpts; variant_id is the row position, ``position`` the largest epsilon first."""
    v = numbered(spark.read.schema("epsilon double, minpts double").csv(path))
    return V.shrinking_order(v.select(F.col("id").cast("int").alias("variant_id"), "epsilon", F.col("minpts").cast("int").alias("minpts")))


def from_arrays(spark: SparkSession, x: Sequence[float], y: Sequence[float]) -> DataFrame:
    """Points from two arrays of equal length; ids are positions."""
    import pyarrow as pa

    if len(x) != len(y):
        raise ValueError(f"{len(x)} x and {len(y)} y")
    table = pa.table({"id": pa.array(range(len(x)), pa.int64()), "x": pa.array([float(v) for v in x], pa.float64()), "y": pa.array([float(v) for v in y], pa.float64())})
    return as_points(spark.createDataFrame(table))


def _uniform(seed: int):
    """A number from 0 to 1 for each id, from a hash of seed and id: the same wherever it is made."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def random_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """n points uniform in 180 x 360."""
    return spark.range(n).select("id", (_uniform(seed) * 180).alias("x"), (_uniform(seed + 1) * 360).alias("y"))


def clustered_points(spark: SparkSession, n: int, seed: int = 0, clusters: int = len(CENTRES), half: float = 5.0) -> DataFrame:
    """n // clusters points around each of the first centres, uniform within half on both sides."""
    each = n // clusters
    centre = F.element_at(F.array(*[F.struct(F.lit(a).alias("cx"), F.lit(b).alias("cy")) for a, b in CENTRES[:clusters]]), (F.floor(F.col("id") / max(each, 1)) + 1).cast("int"))
    p = spark.range(each * clusters).withColumn("c", centre)
    return p.select("id", (F.col("c.cx") + (_uniform(seed) * 2 - 1) * half).alias("x"), (F.col("c.cy") + (_uniform(seed + 1) * 2 - 1) * half).alias("y"))


def wide(labels: DataFrame, variant_ids: Sequence[int], points: DataFrame | None = None) -> DataFrame:
    """(variant_id, id, cluster) to id, cluster_0, cluster_1, ...; with points also x and y."""
    out = labels.groupBy("id").pivot("variant_id", list(variant_ids)).agg(F.first("cluster"))
    for i in variant_ids:
        out = out.withColumnRenamed(str(i), f"cluster_{i}")
    return out if points is None else points.select("id", "x", "y").join(out, "id")


def write_wide_csv(table: DataFrame, path: str) -> None:
    """x,y with four decimals and the labels, headerless, in id order."""
    label = [c for c in table.columns if c.startswith("cluster_")]
    table.orderBy("id").select(*[F.format_string("%.4f", c).alias(c) for c in ("x", "y")], *label).write.csv(path)


def listing(labels: DataFrame, points: DataFrame) -> DataFrame:
    """One line a variant and point: id, x, y, cluster."""
    rows = labels.join(points.select("id", "x", "y"), "id")
    return rows.select("variant_id", "id", F.format_string("%d, %f, %f, %d", "id", "x", "y", "cluster").alias("line"))


def append_metrics(spark: SparkSession, row: dict, path: str) -> None:
    """Append one row of benchmark figures."""
    spark.createDataFrame([row]).coalesce(1).write.mode("append").parquet(path)


def trial_means(trials: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean of all trials but the first, number 0, of each setting."""
    return trials.filter("trial > 0").groupBy(*by).agg(F.avg(value).alias(f"mean_{value}"))


def save_cells(points: DataFrame, width: float, path: str, buckets: int = 64) -> None:
    """Store points by the cell of this width that they lie in, partitioned by a hash of the cell, for ``saved_range_query``."""
    p = points.withColumn("cx", cell("x", width)).withColumn("cy", cell("y", width))
    p.withColumn("bucket", F.pmod(F.hash("cx", "cy"), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").parquet(path)


def load_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def saved_range_query(spark: SparkSession, path: str, boxes: DataFrame, width: float, buckets: int = 64) -> DataFrame:
    """(box_id, id) of saved points in closed boxes (box_id, xmin, ymin, xmax, ymax), for boxes of few cells.

    A box names its cells, a cell its bucket; where the boxes are few enough to be
    broadcast, only the folders of their buckets are read.
    """
    span = lambda a, b: F.explode(F.sequence(cell(a, width), cell(b, width)))
    asked = boxes.withColumn("cx", span("xmin", "xmax")).withColumn("cy", span("ymin", "ymax")).withColumn("bucket", F.pmod(F.hash("cx", "cy"), F.lit(buckets)))
    hit = load_cells(spark, path).join(asked, ["bucket", "cx", "cy"])
    return hit.filter(F.col("x").between(F.col("xmin"), F.col("xmax")) & F.col("y").between(F.col("ymin"), F.col("ymax"))).select("box_id", "id")
