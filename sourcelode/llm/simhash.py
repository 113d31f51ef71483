"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: one per document, in Arrow batches; then one row per distinct fingerprint.
2. Bits are grouped into partitions so that correlated bits share one. Counts of bits and of pairs of bits
   are sums over all distinct fingerprints (64 x 64 numbers).
3. Thresholds: for a Hamming distance of at most t, thresholds t_i >= -1 of the partitions with
   sum(t_i + 1) = t + 1 lose no pair. Dynamic programming picks those with the fewest estimated candidates
   and probes, for each number of partitions. More than t + 1 partitions can't help: those beyond would have
   threshold -1 and only make the others' keys shorter. With few fingerprints that gives three keys of about
   21 bits and thresholds 0; from some 40 million on keys of 32 bits with thresholds 1 and 0, and towards
   10^12 one key of all bits with threshold 2: keys grow with the table, and buckets stay small.
4. Each fingerprint is indexed under its value in each partition in use, and probes all values within t_i.
   Index and probes meet in an equi-join; the join's condition verifies the whole distance.
5. A hot value, which more than BUCKET fingerprints share, would make pairs by the square: over BUCKET / 2
   for each of them. All that probe such a value go another, equally exact way with 65 rows each: two
   fingerprints differ in at most 2 bits if and only if some third word is within 1 bit of both, so each is
   sent to its 65 neighbours, where at most 65 can meet, and all that meet are linked to the smallest. BUCKET
   is where the two ways cost alike. (The second is for t = 2, the contract's.)
6. Components of the links.

Defined cases: null and empty texts have fingerprint zero and link to each other; texts under three words
are one shingle; very long texts are hashed whole, in parts of bounded memory; fingerprints that tie on a bit
(half the shingles) have it 0; an empty table gives no rows; null ids take their group's component (null if
the group has no other id); repeated rows are kept, though the pipeline's stage keeps one row of each
component; other columns are not read, and may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_each, survivors, table, text_or_empty, written
from .components import components

WIDTH, DISTANCE, BITS, SEED = 3, 2, 64, 42
BUCKET = 2 * (BITS + 1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Signed 64-bit. bytes.lower() and bytes.split() know ASCII letters and ASCII white space only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = [digest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[: -width])).tolist()
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp, and a hash of the text that tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [fingerprint(x.as_py(), width) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["doc_id", "text_hash", "fp"])

    own = docs.select(docs["doc_id"].cast("long"), text_hash(docs).alias("text_hash"), "text")
    return own.mapInArrow(run, "doc_id BIGINT, text_hash BIGINT, fp BIGINT")


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(text_or_empty(docs))


def bit_statistics(unique: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and how many have bits i and j, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pairs = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            words = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(words), 1 << 16):
                part = np.ascontiguousarray(words[k : k + (1 << 16)])
                x = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                pairs += (x.T @ x).astype(np.int64)
                n += len(x)
        if n:
            counts = np.append(pairs.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["i", "n"])

    counts = unique.select("fp").mapInArrow(run, "i BIGINT, n BIGINT").groupBy("i").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in counts.collect():
        flat[r["i"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def correlations(n: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = np.diag(pairs) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return p, np.abs((pairs / n - np.outer(p, p)) / np.outer(sd, sd))


def grouped_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near equal size, each grown from a free bit by what is most correlated with it."""
    free, out = set(range(len(corr))), []
    for k in range(parts):
        room = math.ceil(len(free) / (parts - k))
        group = [min(free)]
        free.remove(group[0])
        while len(group) < room:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def estimated_candidates(n: int, p: np.ndarray, corr: np.ndarray, group: list[int], threshold: int) -> float:
    """Pairs within `threshold` in the group's bits. A bit counts less the more an earlier one tells of it."""
    if threshold < 0:
        return 0.0
    dist = np.zeros(threshold + 1)
    dist[0] = 1.0
    for k, b in enumerate(group):
        told = corr[b, group[:k]].max() if k else 0.0
        same = (p[b] ** 2 + (1 - p[b]) ** 2) ** (1 - min(told, 1.0))
        dist[1:] = dist[1:] * same + dist[:-1] * (1 - same)
        dist[0] *= same
    return n * (n - 1) / 2 * float(dist.sum())


def thresholds(n: int, p: np.ndarray, corr: np.ndarray, groups: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """Dynamic programming over the groups: the cheapest thresholds with sum(t + 1) = distance + 1."""
    best = {0: (0.0, [])}
    for group in groups:
        after: dict[int, tuple[float, list[int]]] = {}
        for units, (cost, chosen) in best.items():
            for t in range(-1, distance - units + 1):
                probes = n * sum(math.comb(len(group), d) for d in range(t + 1))
                now = cost + estimated_candidates(n, p, corr, group, t) + probes
                if units + t + 1 not in after or now < after[units + t + 1][0]:
                    after[units + t + 1] = (now, [*chosen, t])
        best = after
    return best[distance + 1]


def plan(n: int, pairs: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions in use."""
    p, corr = correlations(max(n, 1), pairs)
    found = []
    for parts in range(1, distance + 2):
        groups = grouped_bits(corr, parts)
        cost, chosen = thresholds(n, p, corr, groups, distance)
        found.append((cost, parts, [(g, t) for g, t in zip(groups, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[:2])[2]


def signed(word: int) -> int:
    return word - (1 << BITS) if word >= 1 << (BITS - 1) else word


def keys_of(no: int, own: Column, flips: list[int]) -> Column:
    """A constant array of masks, however many, and one expression over it."""
    masks = F.array(*[F.lit(signed(f)) for f in flips])
    return F.transform(masks, lambda m: F.struct(F.lit(no).alias("part"), own.bitwiseXOR(m).alias("key")))


def links(unique: DataFrame, partitions: list[tuple[list[int], int]], distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(u, v) of fingerprints: their components are those of all pairs within the distance."""
    if distance != 2:
        raise ValueError("the way for large buckets is for distance 2")
    fp = F.col("fp")
    index_keys, probe_keys = [], []
    for no, (bits, t) in enumerate(partitions):
        own = fp.bitwiseAND(F.lit(signed(sum(1 << b for b in bits))))
        flips = [0]
        for _ in range(t):
            flips = sorted({f ^ (1 << b) for f in flips for b in bits} | set(flips))
        index_keys.append(keys_of(no, own, [0]))
        probe_keys.append(keys_of(no, own, flips))
    index = unique.select(fp.alias("b"), F.inline(F.concat(*index_keys)))
    probes = unique.select(fp.alias("a"), F.inline(F.concat(*probe_keys)))
    large = written(index.groupBy("part", "key").count().filter(F.col("count") > bucket).select("part", "key"), "large")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    small = (
        probes.join(index.join(large, ["part", "key"], "left_anti"), ["part", "key"])
        .filter((F.col("a") < F.col("b")) & near)
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )
    crowd = probes.join(large, ["part", "key"], "left_semi").select(F.col("a").alias("fp")).distinct()
    middles = F.array(fp, *[fp.bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)])
    met = (
        crowd.select("fp", F.explode(middles).alias("middle"))
        .groupBy("middle").agg(F.array_sort(F.collect_set("fp")).alias("all"))
        .filter(F.size("all") > 1)
        .select(F.get("all", F.lit(0)).alias("u"), F.explode("all").alias("v"))
        .filter("u != v")
    )
    return small.unionByName(met)


def classes(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, fp of every row; fp, its rows n, component's smallest fp, component_id)."""
    each = written(fingerprints(docs, width), "fingerprints")
    counts = each.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    unique = written(counts, "unique-fingerprints")
    n, pairs = bit_statistics(unique)
    parts = components(links(unique, plan(n, pairs))).withColumnRenamed("node", "fp")
    linked = written(unique.join(parts, "fp"), "linked")
    least = written(linked.groupBy("component").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("_n")), "least")
    linked = join_each(linked, least, "component", n, "_n").select("fp", "component", "least")
    found = unique.join(linked, "fp", "left").select(
        "fp", "n", F.coalesce("component", "fp").alias("component"), F.coalesce("least", "rep").alias("component_id")
    )
    return each, written(found, "classes")


def label(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    each, found = classes(docs, width)
    return join_each(each, found, "fp", each.count(), "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), BITS // 4, "0").alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: of the rows with the id that names it, that with the smallest hash of its
    text, and one of those if it is repeated."""
    each, found = classes(docs)
    total = each.count()
    named = join_each(each, found, "fp", total, "n").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = named.groupBy("component", "text_hash", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.groupBy("component").agg(F.min(F.struct("text_hash", "doc_id", "n")).alias("f"))
    kept = first.select(F.col("f.text_hash").alias("k0"), F.col("f.doc_id").alias("k1"), "f.n")
    return survivors(docs, [text_hash(docs), docs["doc_id"].cast("long")], written(kept, "kept"), total)
