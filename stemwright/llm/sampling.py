"""A reproducible sample that stays as data grows, by golden-ratio low-discrepancy selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

GOLDEN = 2654435769  # 2^32 / golden ratio, so multiples modulo 2^32 are the fractional multiples
BUCKET = 65_536  # rows of one stratum ranked in one task at most


def sequence_numbers(keys: DataFrame, strata: list[str], position: str) -> DataFrame:
    """keys with `seq`: the number of keys of the same stratum at smaller positions (positions unique).

    Positions are counted in blocks of BUCKET, so no task ever sorts a whole stratum; the numbers don't
    depend on the partitioning, and keys at later positions don't change them.
    """
    keys = keys.drop("seq", "_block", "_inside", "_n", "_offset")
    blocked = keys.withColumn("_block", F.floor(F.col(position) / BUCKET))
    counts = blocked.groupBy(*strata, "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*strata).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(*strata, "_block", F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(*strata, "_block").orderBy(position)) - 1
    ranked = blocked.withColumn("_inside", inside)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*strata, "_block"]]
    condition = same[0]
    for c in same[1:]:
        condition &= c
    return (
        ranked.alias("a").join(offsets.alias("b"), condition)
        .select("a.*", (F.col("_offset") + F.col("_inside")).cast("long").alias("seq"))
        .drop("_block", "_inside")
    )


def golden_sample(keys: DataFrame, strata: list[str], position: str, share: float, seed: int = 7) -> DataFrame:
    """The keys of the sample, with seq.

    Key number i of a stratum is kept when (shift + i / golden ratio) mod 1 < share, in 32-bit integers;
    the shift is a fixed hash of seed and stratum. Any run of numbers holds its share to within a few
    keys, later keys never change earlier ones. NULL in a stratum is a value of its own.
    """
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata])
    shift = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    point = F.pmod(F.col("seq") * F.lit(GOLDEN) + shift, F.lit(2**32))
    return sequence_numbers(keys, strata, position).filter(point < F.lit(int(share * 2**32)))
