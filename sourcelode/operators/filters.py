"""Filters: globs, exclusion, scopes, layered ignore rules, views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..model import VIEWS


def glob_filter(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    return paths.filter(fn.matches_glob(F.col(column), patterns))


def without_excluded(paths: DataFrame, patterns: list[str], column: str = "path") -> DataFrame:
    return paths.filter(~fn.excluded(F.col(column), patterns))


def scope_filter(paths: DataFrame, scopes: list[str], column: str = "path") -> DataFrame:
    return paths.filter(fn.in_scope(F.col(column), scopes))


def empty_scopes(scopes: DataFrame, paths: DataFrame) -> DataFrame:
    """Scopes (scope; literals of a configuration) without a file at or under them. A file's directories are held
    against the scopes where the file lies, so only scopes that occur make rows."""
    wanted = [r["scope"] for r in scopes.select("scope").distinct().collect()]  # at most as many as a configuration names
    own = F.array_intersect(F.concat(F.array("path"), fn.ancestors(fn.dirname(F.col("path")))), F.array(*[F.lit(s) for s in wanted]) if wanted else F.array().cast("array<string>"))
    met = paths.select(F.explode(own).alias("scope")).distinct()
    return scopes.join(F.broadcast(met), "scope", "left_anti")


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path), rules(directory, file_rank, rule_no, regex, negated) -> path, ignored.

    A path and each directory above it are tested by the rules of every directory that holds them; the last
    matching rule of the nearest layer decides, and what is ignored above stays ignored below. The rules
    meet paths by directory (an equi-join on ancestors), so a rule sees only what lies under it.
    """
    steps = paths.select("path", F.explode(F.concat(F.array("path"), F.filter(fn.ancestors(fn.dirname(F.col("path"))), lambda d: d != ""))).alias("step"))
    steps = steps.withColumn("is_dir", F.col("step") != F.col("path"))
    steps = steps.select("*", F.explode(fn.ancestors(fn.dirname(F.col("step")))).alias("directory"))
    local = F.when(F.col("directory") == "", F.col("step")).otherwise(F.substr(F.col("step"), F.length("directory") + 2))
    local = F.concat(local, F.when(F.col("is_dir"), "/").otherwise(""))
    met = steps.withColumn("local", local).join(rules, "directory").filter(F.expr("local RLIKE regex"))
    depth = F.when(F.col("directory") == "", 0).otherwise(F.size(F.split("directory", "/")))
    decided = met.groupBy("path", "step").agg(F.max_by(~F.col("negated"), F.struct(depth, "file_rank", "rule_no")).alias("ignored"))
    found = decided.groupBy("path").agg(F.bool_or("ignored").alias("ignored"))
    return paths.join(found, "path", "left").select("path", F.coalesce("ignored", F.lit(False)).alias("ignored"))


def view(findings: DataFrame, name: str) -> DataFrame:
    return findings.filter(F.col("rule_id").isin(*VIEWS[name]))


def runtime_edges(dependencies: DataFrame, runtime_only: bool = True) -> DataFrame:
    inner = dependencies.filter("resolution = 'internal' AND to_file IS NOT NULL")
    return inner.filter("kind = 'runtime'") if runtime_only else inner


def is_uncertain(dependencies: DataFrame) -> DataFrame:
    """One row: whether any reference is indeterminate or unresolved."""
    return dependencies.agg(F.coalesce(F.bool_or(F.col("resolution").isin("indeterminate", "unresolved")), F.lit(False)).alias("uncertain"))
