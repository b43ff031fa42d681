"""Helpers shared by the corpus operators."""

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. One is made only in a local session that names none, as in tests; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-hopweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str, options: dict | None = None) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back, which cuts the lineage and survives lost executors. options: of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the exclusive running sum of value over the whole table in the given order. Rows that tie take any order.

    The rows are range-partitioned and each range is summed alone, then one sum a range is carried over; no
    task sees more than its range. The broadcast table has one row a range. df should be cheap to read twice.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), name)
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_range", (F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).alias("_start"))
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + inside).drop("_range", "_start")
