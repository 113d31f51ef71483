"""Exact duplicates: whole texts, and token sequences of files and function bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from .joins import contained


def text_candidates(files: DataFrame, min_lines: int, min_bytes: int) -> DataFrame:
    """files(file, text) -> file, hash, bytes, lines of those large enough."""
    metric = files.select("file", fn.fingerprint(F.col("text")).alias("hash"), F.octet_length("text").alias("bytes"), fn.line_count(F.col("text")).alias("lines"))
    return metric.filter((F.col("lines") >= min_lines) & (F.col("bytes") >= min_bytes))


def text_groups(candidates: DataFrame) -> DataFrame:
    """hash, bytes, file (the smallest), n of texts that occur twice or more. Only digests move; sums are partial."""
    return candidates.groupBy("hash", "bytes").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"), F.min("lines").alias("lines")).filter("n > 1")


def verified_occurrences(files: DataFrame, candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """group_file, file, lines of every occurrence whose text equals that of the group's first file.

    The texts themselves are compared, beside their digests; past the first exchange only those of groups move.
    Rows of one hot group are split by adaptive execution (sort-merge joins throughout).
    """
    member = candidates.hint("merge").join(groups.select("hash", "bytes", F.col("file").alias("group_file")), ["hash", "bytes"])
    own = member.join(files.select("file", "text"), "file")
    first = own.filter("file = group_file").select("group_file", F.col("text").alias("_first"))
    return own.hint("merge").join(first, "group_file").filter("text = _first").select("group_file", "hash", "bytes", "file", "lines")


def block_sequences(tokens: DataFrame, blocks: DataFrame, min_tokens: int, min_lines: int) -> DataFrame:
    """tokens(file, idx, hash, line, column, end_line), blocks(file, start, end) -> each distinct block that is
    large enough with the digest of its tokens' hashes.

    A file's tokens (at most maxDuplicationTokens) and its blocks meet in one row; digests are made inside it, so
    tokens are never copied to their blocks, and only digests are exploded.
    """
    listed = tokens.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("idx", "hash", "line", "column", "end_line"))).alias("t"))
    sized = blocks.filter(F.col("end") - F.col("start") >= min_tokens)
    asked = sized.groupBy("file").agg(F.collect_set(F.struct("start", "end")).alias("b"))

    def digest(b):
        part = F.slice("t", b["start"] + 1, b["end"] - b["start"])
        first, last = F.get("t", b["start"]), F.get("t", b["end"] - 1)
        return F.struct(
            b["start"].alias("start"), b["end"].alias("end"), (b["end"] - b["start"]).alias("length"),
            F.sha2(F.array_join(F.transform(part, lambda x: x["hash"]), ","), 256).alias("hash"),
            first["line"].alias("line"), first["column"].alias("column"), last["end_line"].alias("end_line"),
        )

    out = asked.join(listed, "file").select("file", F.inline(F.transform("b", digest)))
    return out.filter(F.col("end_line") - F.col("line") + 1 >= min_lines)


def token_groups(sequences: DataFrame) -> DataFrame:
    """Occurrences (length, hash, file, start, end, line, column, end_line) of sequences that occur twice or more."""
    repeated = sequences.groupBy("length", "hash").count().filter("count > 1").drop("count")
    return sequences.hint("merge").join(repeated, ["length", "hash"], "left_semi")


def without_nested(occurrences: DataFrame) -> DataFrame:
    """Drops a group if each of its occurrences lies inside an interval of another group in its file.

    Containment is transitive and an interval strictly inside another is shorter, so testing against all
    groups equals taking groups by falling length and testing against those kept.
    """
    key = ["length", "hash", "file", "start", "end"]
    inside = contained(occurrences, key).withColumn("_inside", F.lit(True))
    marked = occurrences.join(inside, key, "left")
    free = marked.filter("_inside IS NULL").select("length", "hash").distinct()
    return occurrences.hint("merge").join(free, ["length", "hash"], "left_semi")


def group_rows(occurrences: DataFrame) -> DataFrame:
    """id, tokens, file, line, related_files, blocks: one row a group. Related files are bounded by the
    repository's files; many-million-fold groups belong in the occurrence table."""
    where = F.struct("file", "line", "column", "end_line")
    return (
        occurrences.groupBy("length", "hash")
        .agg(F.min(where).alias("first"), F.sort_array(F.collect_list(where)).alias("blocks"))
        .select(
            F.concat_ws(":", F.lit("duplicate"), "length", F.substring("hash", 1, 16), "first.file", "first.line", "first.column").alias("id"),
            F.col("length").alias("tokens"), F.col("first.file").alias("file"), F.col("first.line").alias("line"),
            F.array_distinct(F.transform("blocks", lambda b: b["file"])).alias("related_files"), "blocks",
        )
    )
