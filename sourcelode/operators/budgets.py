"""Running budgets over ordered rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total


def byte_budget(rows: DataFrame, value: str, order: list[str], limit: int, keys: list[str] = ()) -> DataFrame:
    """Adds total and within: rows after the one that overflows are out as well, since totals only grow. Rows are
    dealt by range, so a key with most of the rows is summed by many tasks."""
    return running_total(rows, value, order, "total", keys).withColumn("within", F.col("total") <= limit)


def summary(budgeted: DataFrame, keys: list[str]) -> DataFrame:
    return budgeted.groupBy(*keys).agg(
        F.count_if("within").alias("kept"), F.count_if(~F.col("within")).alias("dropped"), F.max(F.when(F.col("within"), F.col("total"))).alias("used")
    )


def skipping_budget(rows: DataFrame, key: str, value: str, order: list[str], limit: int) -> DataFrame:
    """Adds `before`, what rows before this one have used, and `within`. Within each key, a row that would overflow
    is left out and later, smaller ones may still fit; reaching the limit ends it.

    A fold by nature, in Arrow batches of (key, order, value) alone. The task of a hot
    key holds numbers, no payload.
    """
    kinds = dict(rows.dtypes)
    columns = [key, *order, value]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        used, before, taken = 0, [], []
        for v in pdf[value]:
            fits = used < limit and used + v <= limit
            before.append(used)
            taken.append(fits)
            used += v if fits else 0
        return pdf.assign(before=before, within=taken)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    return rows.select(columns).groupBy(key).applyInPandas(run, f"{schema}, before bigint, within boolean")
