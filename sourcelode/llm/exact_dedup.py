"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by the SHA-256 of the normalised text, in a folder that outlives the
session; its number of buckets is kept beside it, so every session reads and writes it alike. A batch is
reduced to one row per digest (partial aggregation before the shuffle). A sort-merge anti-join with the index
finds the digests it lacks; the others meet their entries in a sort-merge join. One append then adds the
batch: an entry for each new digest, and for each known one an addition to its rows and its largest id. The
index side of the joins is neither shuffled nor collected; a digest's state is the sum of its rows.

Defined cases: a null text counts as the empty text, texts of any length are hashed whole; of equal texts the
largest doc_id stays, in whatever batch it comes (null ids are smaller than any other; rows that repeat the
kept id are all marked kept, while the pipeline's stage keeps one of them); an empty table gives an empty
result and appends nothing; columns other than the two named ones are not read, and may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_ascii, fresh_path, join_each, shuffle_width, survivors, table, text_or_empty, written

SCHEMA = "digest STRING, keep_id BIGINT, group_size BIGINT, new BOOLEAN"
BATCHES = 2


class DigestIndex:
    """Rows (digest, keep_id, group_size, new), bucketed and sorted by digest, under `path`. `buckets` counts for
    a new index only; an existing one keeps its own. Use one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._layout(buckets)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets that the folder was made with; a new folder is given one."""
        context = self.spark.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/layout")
        if not target.getFileSystem(context._jsc.hadoopConfiguration()).exists(target):
            made = self.spark.range(1).select(F.lit(buckets or shuffle_width(self.spark)).alias("buckets"), F.lit(SCHEMA).alias("columns"))
            made.coalesce(1).write.json(f"{self.path}/layout")
        found = self.spark.read.schema("buckets INT, columns STRING").json(f"{self.path}/layout").first()
        if found["columns"] != SCHEMA:
            raise ValueError(f"the index at {self.path} has columns {found['columns']}")
        return found["buckets"]

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def state(self) -> DataFrame:
        """digest, keep_id, group_size over all batches. Rows of a digest share a bucket, so nothing is exchanged."""
        return self.rows().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def unseen(self, groups: DataFrame) -> DataFrame:
        return groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def seen(self, groups: DataFrame) -> DataFrame:
        """The batch's digests that the index has, with its state before the batch."""
        before = self.state().select("digest", F.col("keep_id").alias("old_id"), F.col("group_size").alias("old_size"))
        return groups.hint("merge").join(before, "digest")

    def append(self, rows: DataFrame) -> None:
        """One file per bucket and append: rows are dealt by the function that the buckets use."""
        (
            rows.select("digest", "keep_id", "group_size", "new").repartition(self.buckets, "digest")
            .write.mode("append").format("parquet").option("path", f"{self.path}/rows")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def add(self, groups: DataFrame) -> DataFrame:
        """Adds groups(digest, keep_id, group_size), a table, as one batch; returns digest, keep_id, group_size of its
        digests over this batch and all before, and the rows that the batch added."""
        fresh = self.unseen(groups).select("*", F.lit(True).alias("new"), F.lit(None).cast("long").alias("old_id"), F.lit(0).cast("long").alias("old_size"))
        known = self.seen(groups).select("digest", "keep_id", "group_size", F.lit(False).alias("new"), "old_id", "old_size")
        batch = written(fresh.unionByName(known), "digest-batch")  # read and written before the index changes
        self.append(batch)
        return batch.select(
            "digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("group_size") + F.col("old_size")).alias("group_size"),
            F.col("group_size").alias("added"),
        )

    def close(self) -> None:
        """Forgets the session's name for the table; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    return docs.select(docs[id_column].alias("doc_id"), digest_of(docs, text_column).alias("digest"))


def digest_of(docs: DataFrame, text_column: str = "text"):
    return F.sha2(fold_ascii(text_or_empty(docs, text_column)), 256)


def grouped(keyed: DataFrame) -> DataFrame:
    return keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Adds a batch to the index; per row of the batch: doc_id, digest, and keep_id, group_size of its digest by now."""
    keyed = written(digests(docs), "digests")
    groups = written(grouped(keyed), "digest-groups")  # else the anti-join is pushed below the aggregation, to every row
    return join_each(keyed, index.add(groups), "digest", keyed.count(), "added").drop("added")


def indexed(docs: DataFrame, batches: int = BATCHES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of every row; digest, keep_id, group_size) by way of a new index that takes the table in
    batches, dealt by a hash of the id, as a table that grows would come."""
    spark = docs.sparkSession
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    keyed = written(digests(docs).withColumn("batch", part), "digests")
    groups = keyed.groupBy("batch", "digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = written(groups, "digest-groups")
    index = DigestIndex(spark, fresh_path(spark, "digest-index"))
    try:
        for k in range(batches):
            index.add(groups.filter(F.col("batch") == k).drop("batch"))
        return keyed.drop("batch"), written(index.state(), "digest-state")
    finally:
        index.close()


def label(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Groups of equal texts of a table on its own."""
    keyed, state = indexed(docs, batches)
    return join_each(keyed, state, "digest", keyed.count(), "group_size").select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: that with the largest id, and one of those if several have it."""
    keyed, state = indexed(docs)
    total = keyed.count()
    last = join_each(keyed, state, "digest", total, "group_size").filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    kept = last.groupBy(F.col("digest").alias("k0"), F.col("doc_id").alias("k1")).agg(F.count(F.lit(1)).alias("n"))
    return survivors(docs, [digest_of(docs), docs["doc_id"]], written(kept, "kept"), total)


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g ON d.h = g.h
"""
