"""Session settings, the package on the workers, and tables written to cut a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "lexiloom", **conf: str) -> SparkSession:
    """A session with the settings that the plans assume; `conf` overrides them (underscores stand for dots)."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    for key, value in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_lexiloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lexiloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch the file at any time until then
    path = os.path.join(folder, "lexiloom.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._lexiloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session of one machine takes a folder of its own; on a cluster that is an error, since no
    folder of one machine would do.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return "/tmp/checkpoints"


#: Whether Parquet's writer looks for columns that variants share.
_SHREDDING = "spark.sql.variant.inferShreddingSchema"


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage and survives lost executors. The files go with release(), or when the session's JVM ends.
    Variants are written whole: they are read whole again, and taking them into columns costs more than they do.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lexiloom/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_SHREDDING, None)
    spark.conf.set(_SHREDDING, "false")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_SHREDDING, before) if before is not None else spark.conf.unset(_SHREDDING)
    keep_until_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep_until_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted by release(), or when the session's JVM ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    spark.sparkContext._lexiloom_written = [*getattr(spark.sparkContext, "_lexiloom_written", []), path]


def release(spark: SparkSession) -> None:
    """Delete all tables that durable() wrote in this session. Results that still read them must have been stored."""
    for path in getattr(spark.sparkContext, "_lexiloom_written", []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    spark.sparkContext._lexiloom_written = []


def in_order(rows: DataFrame, name: str, start: int, *order: str) -> DataFrame:
    """rows with a dense number from `start` on in this order, which must be one without ties.

    Rows are sorted in ranges, side by side; numbers inside a range and the sizes of the ranges before it make a row's
    number, so no task holds more than its range. What is broadcast is a row for each range.
    """
    key = unused(rows, "at")
    sorted_rows = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright(key, 33), F.col(key).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted_rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("part").alias(f"{key}_part"), ahead.alias(f"{key}_ahead"))
    out = sorted_rows.join(F.broadcast(sizes), part == F.col(f"{key}_part"))
    return out.withColumn(name, F.lit(start) + F.col(f"{key}_ahead") + inside).drop(key, f"{key}_part", f"{key}_ahead")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
