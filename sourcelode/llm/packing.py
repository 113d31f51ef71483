"""Best-fit packing by minimum bin slack over a histogram of lengths.

1. Documents are encoded and cut in pieces; the piece table (no texts, no ids) goes to the shared folder.
2. Lengths are counted: at most CAPACITY rows reach the driver, whatever the input.
3. Minimum bin slack: a sequence starts with the greatest length left; subset-sum dynamic programming on
   bitsets over the lengths left finds the fullest combination with it, of long lengths first. It is used
   as often as its lengths last, then removed. Each run of the program uses up a length or nearly so, so
   runs depend on the number of lengths, not on that of documents.
4. A piece's rank among those of its length tells its sequence and place: ranks are counted by (length,
   lane), with lanes from a hash of the piece and its row number, fixed when the pieces are written. So a
   length, an id or a text that a third of the pieces have is ranked by many tasks. The table of combinations
   has at most a few rows a length and is joined by broadcast.

Defined cases: a null or empty text is the end id alone; pieces of the capacity fill a sequence of their own;
a very long text becomes as many pieces as it needs; pieces of one length tie, and go in order of lane, id,
piece, start and crc; repeated rows are packed each; null ids are kept; an empty table gives no rows; other
columns are not read, and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import VOCABULARY, blocks, local_ids, vocabulary_json, word_table
from .common import table, written

CAPACITY, END, LANES, BLOCK = 2048, 0, 1024, 8 << 20
PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(vocabulary_json(vocabulary))  # a file of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(model.value)
        end = np.array([END], np.uint32).tobytes()
        for batch in batches:
            for part in blocks(batch, 1, BLOCK):
                first, flat = local_ids(part.column(1), words)
                data, rows = flat.astype("<u4").tobytes(), []
                for doc_id, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = data[4 * a : 4 * b] + end
                    for no, at in enumerate(range(0, b - a + 1, capacity)):
                        cut = own[4 * at : 4 * (at + capacity)]
                        rows.append((doc_id, no, at, len(cut) // 4, zlib.crc32(cut)))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the greatest sum up to `room`; the longest ones of those."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # (length, copies, sums reachable without them), by rising length
    for length in sorted(x for x, n in counts.items() if n and x <= room):
        copies, left = 1, min(counts[length], room // length)
        while left:
            copies = min(copies, left)
            steps.append((length, copies, reach))
            reach |= (reach << (length * copies)) & mask
            left -= copies
            copies *= 2
    total, chosen = reach.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        step = length * copies
        if step <= total and before >> (total - step) & 1:
            chosen[length] = chosen.get(length, 0) + copies
            total -= step
    return chosen


def combinations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: copies in each}), until no length is left."""
    left = {k: n for k, n in histogram.items() if n}
    out = []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        chosen = fullest(rest, capacity - longest)
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((times, chosen))
        for k, n in chosen.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def slots(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, copies, first sequence, offset of the first copy), one a length and combination."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for times, chosen in found:
        offset = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            out.append((length, taken.get(length, 0), times * copies, copies, sequence, offset))
            taken[length] = taken.get(length, 0) + times * copies
            offset += length * copies
        sequence += times
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    spark = docs.sparkSession
    lane = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(LANES))
    laned = written(pieces(docs, capacity).withColumn("lane", lane), "pieces")
    histogram = {r["length"]: r["count"] for r in laned.groupBy("length").count().collect()}
    plan = spark.createDataFrame(
        slots(combinations(histogram, capacity)),
        "length BIGINT, first_rank BIGINT, ranks BIGINT, copies BIGINT, sequence BIGINT, place BIGINT",
    )
    counted = laned.groupBy("length", "lane").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("length", "lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "lane").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        laned.withColumn("n", F.row_number().over(inside)).join(counted, ["length", "lane"])
        .withColumn("rank", F.col("before") + F.col("n") - 1)
    )
    at = F.col("rank") - F.col("first_rank")
    return ranked.join(
        F.broadcast(plan.withColumnRenamed("length", "_length")),
        (F.col("length") == F.col("_length")) & (F.col("rank") >= F.col("first_rank")) & (at < F.col("ranks")),
    ).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("place") + F.pmod(at, F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)
