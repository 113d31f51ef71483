"""Lookups: first match by priority, nearest ancestor, longest prefix, globs, interval containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn


def first_match(rows: DataFrame, key: list[str], candidates: str, targets: DataFrame, name: str = "to_file") -> DataFrame:
    """rows(key, candidates: array) -> key, name: the first candidate among targets(path); null if there is none.

    An equi-join of the exploded candidates; min_by is summed partially, so a popular target moves one row an
    importer at most.
    """
    listed = rows.select(*key, F.posexplode_outer(candidates).alias("_pos", "path"))
    found = listed.join(targets.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    best = F.min_by(F.when(F.col("_hit"), F.col("path")), F.when(F.col("_hit"), F.col("_pos")))
    return found.groupBy(*key).agg(best.alias(name))


def nearest_ancestor(rows: DataFrame, key: list[str], path: str, directories: DataFrame, name: str = "nearest") -> DataFrame:
    """The deepest of directories(directory) that holds the path: ancestors are exploded, so it is an equi-join.
    The root, which holds every path, takes no part in it: whether it is listed is one value for all rows, and a
    path right under it looks for a directory of its own that no table has."""
    above = F.filter(fn.ancestors(fn.dirname(F.col(path))), lambda x: x != "")
    nowhere = F.concat(F.lit("\0"), F.xxhash64(*key).cast("string"))
    listed = rows.select(*key, F.explode(F.when(F.size(above) > 0, above).otherwise(F.array(nowhere))).alias("directory"))
    named = directories.select("directory").distinct()
    root = F.lit("" if named.filter("directory = ''").take(1) else None)
    met = listed.join(named.withColumn("_hit", F.lit(True)), "directory", "left")
    best = F.max_by(F.when(F.col("_hit"), F.col("directory")), F.when(F.col("_hit"), F.length("directory")))
    return met.groupBy(*key).agg(F.coalesce(best, root).alias(name)).filter(F.col(name).isNotNull())


def longest_prefix_owner(edges: DataFrame, key: list[str], declared: DataFrame) -> DataFrame:
    """edges(key, name, from_file), declared(name, directory, manifest) -> edges with the manifest that owns the
    name nearest above the file; ties by manifest. Edges that nothing declares are dropped."""
    listed = edges.withColumn("directory", F.explode(fn.ancestors(fn.dirname(F.col("from_file")))))
    met = listed.join(declared.select("name", "directory", "manifest"), ["name", "directory"])
    ranked = Window.partitionBy(*key).orderBy(F.length("directory").desc(), "manifest")
    return met.withColumn("_n", F.row_number().over(ranked)).filter("_n = 1").drop("_n")


def glob_join(patterns: list[str], files: DataFrame) -> DataFrame:
    """pattern, path for every match. Patterns are literals of the configuration (at most 128), so each file
    is tested where it lies and only matches make rows."""
    if not patterns:
        return files.sparkSession.createDataFrame([], "pattern STRING, path STRING")
    tested = F.array(*[F.when(fn.matches_glob(F.col("path"), [p]), F.lit(p)) for p in patterns])
    return files.select(F.explode(F.array_compact(tested)).alias("pattern"), "path")


def contained(intervals: DataFrame, key: list[str], start: str = "start", end: str = "end", within: list[str] = ("file",)) -> DataFrame:
    """key of intervals that lie strictly inside another interval of the same `within`.

    By windows, not by pairs: in order of (start, -end), an interval is inside an earlier one exactly if the
    greatest end before it reaches its own end, equal intervals aside.
    """
    same = [*within, start, end]
    distinct = intervals.select(*same).distinct()
    earlier = Window.partitionBy(*within).orderBy(F.col(start), F.col(end).desc()).rowsBetween(Window.unboundedPreceding, -1)
    inside = distinct.withColumn("_reach", F.max(end).over(earlier)).filter(F.col("_reach") >= F.col(end)).select(*same)
    return intervals.join(inside, same, "left_semi").select(*key)
