"""What the operators of this subpackage share: inputs, the shared folder, joins with hot keys, ASCII folding."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it has more than this share of the rows, so that there are at most 1 / HOT hot keys.
HOT, FEW = 0.001, 64

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a new
    local folder that the application keeps from then on, if it runs on one machine; on a cluster, an error."""
    known, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not known:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="sourcelode-")
        known = _own[context.applicationId]
    return known.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder. It is deleted when the driver ends in good order."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/sourcelode-{context.applicationId}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(target):
        files.mkdirs(target)
        files.deleteOnExit(target)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_each(rows: DataFrame, per_key: DataFrame, key: str, total: int, count: str) -> DataFrame:
    """rows joined with per_key, which has one row a key and, in `count`, the rows that each key has among `total`.

    Rows of a hot key meet its row by broadcast (at most 1 / HOT rows, whatever the input) and stay where they
    are; the rest go through a sort-merge join. Both inputs are read twice: pass tables.
    """
    bound = max(FEW, int(total * HOT))
    hot = per_key.filter(F.col(count) > bound)
    few = F.broadcast(hot)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(few, key).unionByName(cold.hint("merge").join(per_key.filter(F.col(count) <= bound), key))


def survivors(docs: DataFrame, key: list[Column], kept: DataFrame, total: int) -> DataFrame:
    """One row of docs for each row of kept(k0, k1, n): of those rows whose two key columns equal k0 (never null)
    and k1 (null equals null), n in number. Of rows that repeat a key, that with the smallest JSON text stays.

    Rows travel as one struct, so no column's name can clash. Repeated rows of a hot key are reduced where they are.
    """
    rows = docs.select(F.struct("*").alias("row"), key[0].alias("a"), key[1].alias("b"))
    kept = kept.select("k0", "k1", "n")
    same = (F.col("a") == F.col("k0")) & F.col("b").eqNullSafe(F.col("k1"))
    once = rows.hint("merge").join(kept.filter("n = 1"), same, "left_semi").select("row.*")
    bound = max(FEW, int(total * HOT))
    often, hot = kept.filter(F.col("n").between(2, bound)), kept.filter(F.col("n") > bound)
    repeated = rows.hint("merge").join(often, same).unionByName(rows.join(F.broadcast(hot), same))
    least = repeated.groupBy("k0", "k1").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(least.select("row.*"))


def text_or_empty(df: DataFrame, column: str = "text") -> Column:
    return F.coalesce(df[column], F.lit(""))


def fold_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is. lower() does that for ASCII texts, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
