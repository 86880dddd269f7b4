"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings while a table is written, where the session sets none itself: a job's shuffle files go at its end, and
#: Python workers get small batches, as two of them share an executor's memory with the JVM.
_WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and all runs on one machine, as in tests, a temporary
    folder is made. On a cluster a folder of one machine would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = root.get() if root.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        root = "file://" + tempfile.mkdtemp(prefix="varigrid-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and return it as read from there.

    This cuts the lineage; a lost executor costs nothing that was written. Settings
    that hold while it is written are undone afterwards. ``discard`` removes the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/varigrid-{name}-{uuid.uuid4().hex}"
    ours = [k for k in _WHILE_WRITING if spark.conf.get(k, None) is None and spark.conf.isModifiable(k)]
    for k in ours:
        spark.conf.set(k, _WHILE_WRITING[k])
    try:
        df.write.parquet(path)
    finally:
        for k in ours:
            spark.conf.unset(k)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` made, once all that reads them has been stored or used."""
    for table in tables:
        path = getattr(table, "_stored_path", None)
        if path is None:
            raise ValueError("not a stored table")
        spark = table.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
