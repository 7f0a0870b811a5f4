"""The flags table as a stream: attempts arrive, the first usable one of each job is flagged.

An extension of the batch query. State is one row per job within the watermark; a job whose attempts
are further apart than the delay can be flagged twice, so the sink keeps job_id for a later merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stemwright.operators import detector
from stemwright.plans.items import OPTION_COLUMNS, usable_rows


def read_attempts(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def flag_stream(attempts: DataFrame, delay: str = "7 days") -> DataFrame:
    """Flags of the first usable attempt of each job within the delay."""
    timed = usable_rows(attempts).withColumn("requested_at", F.coalesce(F.col("requested_at").cast("timestamp"), F.current_timestamp()))
    once = timed.withWatermark("requested_at", delay).dropDuplicatesWithinWatermark(["job_id"])
    items = once.select("job_id", "model_label", "condition", "stem", "answer", detector.options_of(OPTION_COLUMNS).alias("options"))
    return detector.detect(items, keep=["job_id", "model_label", "condition"])


def arrival_windows(attempts: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Attempts, failures and cost by tumbling windows of the request time."""
    timed = attempts.withColumn("at", F.col("requested_at").cast("timestamp")).filter("at is not null").withWatermark("at", delay)
    return timed.groupBy(F.window("at", width)).agg(
        F.count("*").alias("n_attempts"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("n_failed"), F.sum("cost_usd").alias("cost_usd"))


def write_stream(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet files; runs over what is there and ends."""
    return (
        df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
