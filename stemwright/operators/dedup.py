"""De-duplication policies by name: each takes the rows, the key and the order of the log.

All use one ranking or aggregation per key; aggregations combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_where(rows: DataFrame, key: list[str], order: str, keep: Column) -> DataFrame:
    """First row of each key that passes `keep` (first usable, first parsed, filter-then-first)."""
    w = W.partitionBy(*key).orderBy(order)
    return rows.filter(keep).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def success_else_first(rows: DataFrame, key: list[str], order: str, success: Column) -> DataFrame:
    """First row that succeeded, or the first row where none did."""
    w = W.partitionBy(*key).orderBy((~F.coalesce(success, F.lit(False))).cast("int"), order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_row(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last row of each key: later rows overwrite."""
    w = W.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def agreed_only(rows: DataFrame, key: list[str], order: str, label: str) -> DataFrame:
    """First row of each key whose rows have one label; keys with several labels are dropped."""
    kept = F.min_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("_row")
    one = rows.groupBy(*key).agg(F.count_distinct(label).alias("_labels"), kept).filter("_labels = 1")
    return one.select(*key, "_row.*")


def done_keys(rows: DataFrame, key: list[str], success: Column) -> DataFrame:
    """Keys with at least one success."""
    return rows.groupBy(*key).agg(F.bool_or(F.coalesce(success, F.lit(False))).alias("_done")).filter("_done").select(*key)
