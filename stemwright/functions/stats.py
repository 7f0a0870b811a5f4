"""Statistics as Column expressions over aggregated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column, Column]:
    """(share, low, high) of k among n, within 0 and 1; NaN where n = 0."""
    m = F.nullif(n, F.lit(0))  # NULL where there are no cases, so nothing is divided by 0
    p = k / m
    d = 1 + z * z / m
    centre = (p + z * z / (2 * m)) / d
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)) / d
    nan = F.lit(float("nan"))
    return (
        F.when(n > 0, p).otherwise(nan),
        F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(nan),
        F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(nan),
    )


def with_wilson(df: DataFrame, k: str, n: str) -> DataFrame:
    share, low, high = wilson(F.col(k), F.col(n))
    return df.withColumns({"share": F.round(share, 6), "share_lo": F.round(low, 6), "share_hi": F.round(high, 6)})


def chi2_uniform(counts: list[Column]) -> tuple[Column, Column]:
    """(statistic, p) against equal shares; the tail is exact for an odd number of cells. NaN where all are 0."""
    cells = len(counts)
    if cells % 2 == 0:
        raise ValueError("the closed tail needs an even number of degrees of freedom")
    n = sum(counts[1:], counts[0])
    mean = n / cells
    stat = sum(((c - mean) * (c - mean) / mean for c in counts[1:]), (counts[0] - mean) * (counts[0] - mean) / mean)
    half = stat / 2
    term, series = F.lit(1.0), F.lit(1.0)
    for j in range(1, (cells - 1) // 2):
        term = term * half / j
        series = series + term
    nan = F.lit(float("nan"))
    return F.when(n > 0, stat).otherwise(nan), F.when(n > 0, F.exp(-half) * series).otherwise(nan)


def bh_adjusted(df: DataFrame, p: str, family: list[str], order: list[str]) -> DataFrame:
    """df with q: Benjamini-Hochberg adjusted p within each family (a family is one report's list of tests)."""
    up = W.partitionBy(*family).orderBy(p, *order)
    down = W.partitionBy(*family).orderBy(F.desc("_rank")).rowsBetween(W.unboundedPreceding, 0)
    n = F.count("*").over(W.partitionBy(*family))
    ranked = df.withColumn("_rank", F.row_number().over(up)).withColumn("_n", n)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_rank")).over(down))).drop("_rank", "_n")


def kappa(tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """Cohen's kappa of a 2x2 table; NaN where n = 0 or agreement is certain by chance."""
    n = tp + fp + fn + tn
    po = F.try_divide(tp + tn, n)
    pe = F.try_divide((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    return F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(float("nan")))


def ratio(a: Column, b: Column, undefined: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(undefined))


def precision_recall(tp: Column, fp: Column, fn: Column, tn: Column, undefined: float = 0.0) -> dict[str, Column]:
    """Precision, recall, F1, specificity and positive agreement; `undefined` where a denominator is 0."""
    return {
        "precision": ratio(tp, tp + fp, undefined), "recall": ratio(tp, tp + fn, undefined),
        "f1": ratio(2 * tp, 2 * tp + fp + fn, undefined), "specificity": ratio(tn, tn + fp, undefined),
        "positive_agreement": ratio(2 * tp, 2 * tp + fp + fn, undefined),
    }


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column, Column]:
    """Crude odds ratio of a, b against c, d with its Woolf interval; NULL where a cell is 0."""
    whole = (a > 0) & (b > 0) & (c > 0) & (d > 0)
    value = F.when(whole, F.try_divide(a * d, b * c))
    one = F.lit(1.0)
    half = 1.96 * F.sqrt(F.try_divide(one, a) + F.try_divide(one, b) + F.try_divide(one, c) + F.try_divide(one, d))
    return value, F.exp(F.log(value) - half), F.exp(F.log(value) + half)


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks with ties at their mean, from counts of distinct values (no task holds all rows)."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranks = counts.select(value, (below - (F.col("_n") - 1) / 2).alias(out))
    return df.join(ranks, value, "left")


def quantile_bin(value: Column, edges: list[float]) -> Column:
    """Right-closed bin number (from 1) by inner edges; equal values never part."""
    out = F.when(value.isNull(), None)
    for i, edge in enumerate(edges):
        out = out.when(value <= edge, i + 1)
    return out.otherwise(len(edges) + 1)
