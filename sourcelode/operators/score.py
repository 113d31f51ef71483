"""Penalties: identity, one contribution an identity, capped allocation, the score."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..model import CAPS, WEIGHTS
from .common import running_total

MONEY = "decimal(18,6)"


def _lookup(values: dict, key: Column, kind: str = "double") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))]), key).cast(kind)


def identity_key(category: Column, rule: Column, file: Column, subject: Column, related: Column) -> Column:
    """A JSON array: size has one identity a file, a cycle its members, anything else file and subject (null: null)."""

    def text(c: Column) -> Column:
        listed = F.to_json(F.array(c))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    members = F.to_json(F.array_sort(related))
    inner = F.when(category == "size", text(file)).when(rule == "runtime-cycle", members).otherwise(F.concat_ws(",", text(file), text(subject)))
    return F.concat(F.lit("["), text(category), F.lit(","), inner, F.lit("]"))


def contributions(findings: DataFrame, weights: dict = WEIGHTS, keys: list[str] = ()) -> DataFrame:
    """findings(rule_id, category, subject, file, confidence, related_files, context_factor) -> one row an
    identity, that with the greatest raw penalty (ties: the smaller JSON text)."""
    category = fn.category_of(F.col("rule_id"), F.col("category"))
    weight, confidence = _lookup(weights, F.col("rule_id")), fn.confidence_factor(F.col("confidence"))
    factor = F.coalesce(F.col("context_factor"), F.lit(1.0))
    rows = findings.select(
        *keys,
        identity_key(category, F.col("rule_id"), F.col("file"), F.col("subject"), F.col("related_files")).alias("key"),
        "rule_id", category.alias("category"), "file", "confidence", weight.alias("weight"), factor.alias("context_factor"),
        fn.raw_penalty(weight, confidence, factor).alias("raw_penalty"),
    )
    text = F.to_json(F.struct("key", "rule_id", "category", "file", "confidence", "weight", "context_factor", "raw_penalty"))
    rows = rows.withColumn("_text", text)
    best = rows.groupBy(*keys, "key").agg(F.max("raw_penalty").alias("_best"))
    tied = rows.join(best, [*keys, "key"]).filter("raw_penalty = _best")
    fields = [c for c in rows.columns if c not in (*keys, "key", "_text")]
    return tied.groupBy(*keys, "key").agg(F.min_by(F.struct(*fields), "_text").alias("r")).select(*keys, "key", "r.*")


def floored(caps: dict) -> dict:
    return {k: math.floor(v * 1_000_000) / 1_000_000 for k, v in caps.items()}


def allocate(rows: DataFrame, caps: dict = CAPS, total: float = 100, keys: list[str] = (), value: str = "raw_penalty", category: str = "category", key: str = "key") -> DataFrame:
    """Adds applied_penalty: in key order, what the category's cap and then the whole leave.

    Clipping a running sum equals taking differences of clipped prefix sums: once for the category, once
    for the whole. With keys (a repository), windows do it; without, running_total spreads the sums.
    """
    keys = list(keys)
    cap, raw = _lookup(floored(caps), F.col(category), MONEY), F.col(value).cast(MONEY)
    rows = rows.withColumn("_raw", raw)
    if keys:
        c = Window.partitionBy(*keys, category).orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_c", F.sum("_raw").over(c))
    else:
        rows = running_total(rows, "_raw", [key], "_c", [category])
    rows = rows.withColumn("_a", (F.least("_c", cap) - F.least(F.col("_c") - F.col("_raw"), cap)).cast(MONEY))
    if keys:
        t = Window.partitionBy(*keys).orderBy(category, key).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_t", F.sum("_a").over(t))
    else:
        rows = running_total(rows, "_a", [category, key], "_t")
    whole = F.lit(total).cast(MONEY)
    applied = F.least("_t", whole) - F.least(F.col("_t") - F.col("_a"), whole)
    return rows.withColumn("applied_penalty", applied.cast(MONEY)).drop("_raw", "_c", "_a", "_t")


def category_penalties(allocated: DataFrame, keys: list[str] = ()) -> DataFrame:
    return allocated.groupBy(*keys, "category").agg(F.sum("applied_penalty").cast(MONEY).alias("penalty"))


def final_score(allocated: DataFrame, coverage: DataFrame, analyzed_files: int) -> DataFrame:
    """One row: status, value, observed_value. coverage(category, status)."""
    spent = allocated.agg(F.coalesce(F.sum("applied_penalty"), F.lit(0).cast(MONEY)).alias("spent"))
    state = coverage.agg(F.count_if(F.col("status") != "unavailable").alias("evaluated"), F.bool_and(F.col("status") == "complete").alias("whole"))
    status = F.when((F.lit(analyzed_files) == 0) | (F.col("evaluated") == 0), "unavailable").when(F.col("whole"), "complete").otherwise("partial")
    observed = F.when(F.col("status") != "unavailable", F.round(F.greatest(F.lit(0).cast(MONEY), F.lit(100).cast(MONEY) - F.col("spent")), 2).cast("double"))
    one_row_each = spent.join(state)  # two global aggregates: one row by one row
    return one_row_each.withColumn("status", status).select(
        "status", F.when(F.col("status") == "complete", observed).alias("value"), observed.alias("observed_value")
    )
