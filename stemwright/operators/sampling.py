"""Deterministic stratified samples: ranks by a seeded hash of the id stand for a seeded shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shuffled(seed: int, key: str) -> Column:
    """A hash order of the rows that SQL engines agree on."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def per_stratum(rows: DataFrame, strata: list[str], key: str, size: Column, seed: int) -> DataFrame:
    """The first `size` rows of each stratum in hash order, with the stratum's population.

    Only rows whose hash can be among the first are ranked: the bound comes from the population.
    """
    counts = rows.groupBy(*strata).agg(F.count("*").alias("stratum_population"))
    w = W.partitionBy(*strata).orderBy("_h", key)
    joined = rows.withColumn("_h", shuffled(seed, key)).join(counts, strata)
    return joined.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= size).drop("_n", "_h")


def first_hit(rules: list[str], other: list[str]) -> Column:
    """Stratum of an item: its first flagged rule in order, else other_flag or unflagged."""
    out = F.when(F.col(rules[0]) == 1, f"flagged:{rules[0]}")
    for r in rules[1:]:
        out = out.when(F.col(r) == 1, f"flagged:{r}")
    return out.when(F.greatest(*[F.col(r) for r in other]) == 1, "other_flag").otherwise("unflagged")
