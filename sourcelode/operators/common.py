"""Where intermediate tables go, and running totals that no single task has to sum."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where that is unset, a local folder of the application if it runs on
    one machine, and an error on a cluster."""
    known, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="sourcelode-")
        known = _own[context.applicationId]
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder, read back: the lineage of a loop ends there. The application's tables
    are deleted when the driver ends in good order."""
    context = df.sparkSession.sparkContext
    folder = f"{shared_dir(df.sparkSession)}/sourcelode-tables-{context.applicationId}"
    target = context._jvm.org.apache.hadoop.fs.Path(folder)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(target):
        files.mkdirs(target)
        files.deleteOnExit(target)
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_total(rows: DataFrame, value: str, order: list[str], name: str, keys: list[str] = ()) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the same keys up to this one, in `order` (unique within keys).

    Rows are dealt by range of (keys, order); each part is summed on its own and starts from the sums of the
    parts before it, which is a table of one row a part and key.
    """
    keys = list(keys)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.sum("_sum").over(before)).drop("_sum")
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(inside)
    joined = dealt.withColumn("_own", total).join(sums, [*keys, "_part"])
    return joined.withColumn(name, F.col("_own") + F.coalesce(F.col("_before"), F.lit(0))).drop("_own", "_before", "_part")
