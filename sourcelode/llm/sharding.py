"""Sharding by histogram sort (DataFrame operations only).

Rows get the key xxhash64(text); shards are ranges of keys, so equal texts share a shard, and the law is
`bytes`. Splitters are found as histogram sort does: exact bytes below candidate boundaries are counted
over all partitions (partial sums, at most BUCKETS rows a splitter reach the driver), each splitter's
bracket is narrowed to the one candidate interval that holds its target, and so on until every splitter
is within the tolerance or its interval is one group. Then rows are exchanged once, into shards.

Groups larger than a fair share of what the larger ones leave get a shard of their own (fewer than `shards`
of them can exist). Inside a shard, slots follow (lane, key, doc_id), with lanes from a hash of key, id and row
number, fixed when the keys are written: a shard, one group, or repeats of one row with a third of all rows, is
numbered by many tasks. Lane counts are a table of at most shards x LANES rows.

Defined cases: a null text has the key of the empty text and size 1; a very long text is one row of its size,
and more than a fair share makes it a shard; keys that tie share a shard; an empty table gives no rows; null
and repeated ids are kept, one slot a row; the other columns are not read, and may have any name.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty, written

SHARDS, TOLERANCE, BITS, LANES = 8, 0.0005, 12, 2048


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty(docs)
    row = F.monotonically_increasing_id()
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.pmod(F.xxhash64(text, docs["doc_id"], row), F.lit(LANES)).cast("int").alias("lane"),
    )


def prefix(key: Column, bits: int) -> Column:
    """The key's first bits, as a number that is never negative for bits < 64."""
    return F.shiftrightunsigned(key, 64 - bits) if bits < 64 else key


def large_groups(rows: DataFrame, total: int, shards: int) -> dict[int, int]:
    """Keys whose groups exceed a fair share of what the larger ones leave; fewer than `shards`."""
    sums = rows.groupBy("key").agg(F.sum("size").alias("size"))
    found = sums.orderBy(F.desc("size"), "key").limit(shards).collect()  # a smaller one can't be among them
    alone, rest = {}, total
    for row in found:
        if row["size"] > rest / (shards - len(alone)) and len(alone) < shards - 1:
            alone[row["key"]] = row["size"]
            rest -= row["size"]
    return alone


def splitters(rows: DataFrame, targets: list[float], tolerance: float) -> list[int]:
    """For each target, the unsigned key boundary with the nearest number of bytes below it."""
    cut: list[int | None] = [None] * len(targets)
    bracket = {i: (0, 0) for i in range(len(targets))}  # prefix of the interval, bytes below it
    for bits in range(BITS, 64 + BITS, BITS):
        bits = min(bits, 64)
        before = max(0, (bits - 1) // BITS * BITS)
        part = rows
        if before:
            part = rows.filter(prefix(F.col("key"), before).isin(sorted({p for p, _ in bracket.values()})))
        bucket = prefix(F.col("key"), bits).alias("bucket")
        counted = part.groupBy(bucket).agg(F.sum("size").alias("size"), F.min("key").alias("a"), F.max("key").alias("b"))
        found = sorted((r["bucket"] % 2**64, r["size"], r["a"] == r["b"]) for r in counted.collect())
        for i, (inside, below) in list(bracket.items()):
            own = [x for x in found if not before or x[0] >> (bits - before) == inside]
            sums = [below]
            for _, size, _ in own:
                sums.append(sums[-1] + size)
            at = max(1, bisect_left(sums, targets[i]))
            if at > len(own):
                cut[i] = 2**64
            else:
                bucket_no, _, single = own[at - 1]
                first, left = bucket_no << (64 - bits), targets[i] - sums[at - 1] <= sums[at] - targets[i]
                if single or bits == 64 or min(targets[i] - sums[at - 1], sums[at] - targets[i]) <= tolerance:
                    cut[i] = first if left else first + (1 << (64 - bits))
                else:
                    bracket[i] = (bucket_no, sums[at - 1])
            if cut[i] is not None:
                del bracket[i]
        if not bracket:
            break
    return sorted(cut)


def shard_of(key: Column, cuts: list[int], names: list[int], alone: dict[int, int]) -> Column:
    """Signed keys compare as unsigned ones once 2**63 is taken from both."""
    shifted = key.bitwiseXOR(F.lit(-(2**63)))
    out = F.lit(names[-1])
    for cut, name in reversed(list(zip(cuts, names, strict=False))):
        if cut < 2**64:
            out = F.when(shifted < F.lit(cut - 2**63), F.lit(name)).otherwise(out)
        else:
            out = F.lit(name)
    for value, name in alone.items():
        out = F.when(key == F.lit(value), F.lit(name)).otherwise(out)
    return out.cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    rows = written(keyed(docs), "shard-keys")
    total = rows.agg(F.sum("size")).first()[0] or 0
    alone = large_groups(rows, total, shards) if total else {}
    rest = rows.filter(~F.col("key").isin(list(alone))) if alone else rows
    left = shards - len(alone)
    share = (total - sum(alone.values())) / left
    cuts = splitters(rest, [share * k for k in range(1, left)], share * tolerance) if total else []
    placed = rows.withColumn(
        "shard", shard_of(F.col("key"), cuts, list(range(left)), {k: left + i for i, k in enumerate(alone)})
    )
    lanes = placed.groupBy("shard", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("shard", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "lane").orderBy("key", "doc_id")
    return (
        placed.withColumn("n", F.row_number().over(inside))
        .join(F.broadcast(lanes), ["shard", "lane"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
