"""The grid of generation jobs, and what is left to do after a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def job_id(*, model, specialty, topic_index, condition, rep, reasoning="off", tag: str | None = None) -> Column:
    key = F.concat_ws("|", model, specialty, topic_index, condition, rep)
    key = F.concat(key, F.when(F.lit(reasoning) == "off", "").otherwise(f"|reasoning={reasoning}"), F.lit(f"|tag={tag}" if tag else ""))
    return F.substring(F.sha1(key), 1, 12)


def job_grid(models: DataFrame, topics: DataFrame, conditions: list[str], reps: int, reasoning: str = "off", tag: str | None = None) -> DataFrame:
    """One row per model, topic, condition and repetition, with the balanced cyclic target position.

    models: model_id, model_index; topics: specialty, topic_index, global_topic_index. Both are bounded
    dimensions, the grid is their product by definition.
    """
    grid = models.crossJoin(topics).select(
        "*", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition")
    ).select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    place = F.pmod(F.col("global_topic_index") + F.col("model_index") + F.col("rep"), F.lit(5))
    return grid.select(
        job_id(model=F.col("model_id"), specialty=F.col("specialty"), topic_index=F.col("topic_index"), condition=F.col("condition"),
               rep=F.col("rep"), reasoning=reasoning, tag=tag).alias("job_id"),
        "model_id", "specialty", "topic_index", "condition", "rep", (F.lit(1000) + F.col("rep")).alias("seed"),
        F.when(F.col("condition").isin("guided_position", "plain_rotated"), F.substring(F.lit("ABCDE"), (place + 1).cast("int"), F.lit(1))).alias("target_position"),
    )


def to_do(jobs: DataFrame, attempts: DataFrame, success: Column) -> DataFrame:
    """Jobs without a success, with retry_index = attempts so far and the seed of the next attempt."""
    per = attempts.groupBy("job_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce(success, F.lit(False))).alias("done"))
    left = jobs.join(per, "job_id", "left").filter("done is null or not done")
    retry = F.coalesce("n", F.lit(0))
    return left.withColumn("retry_index", retry).withColumn("next_seed", F.col("seed") + 1000 * retry).drop("n", "done")


def within_cost(rows: DataFrame, order: str, cost: str, cap: float, block: int = 65_536) -> DataFrame:
    """Rows in order while the cost before them stays under the cap; summed in blocks of the order, never in one task."""
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_cost", F.coalesce(cost, F.lit(0.0)))
    sums = blocked.groupBy("_block").agg(F.sum("_cost").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.sum("_cost").over(W.partitionBy("_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    spent = blocked.withColumn("_inside", F.coalesce(inside, F.lit(0.0))).join(sums.select("_block", before.alias("_before")), "_block")
    return spent.withColumn("spent_before", F.col("_before") + F.col("_inside")).filter(F.col("spent_before") < cap).drop(
        "_block", "_cost", "_inside", "_before")
