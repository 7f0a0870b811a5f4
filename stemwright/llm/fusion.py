"""Best representative of each group of duplicate records, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemwright.session import cut


def has_value(column: Column, kind: str) -> Column:
    return (column.isNotNull() & column.rlike(r"(?U)\S")) if kind == "string" else column.isNotNull()


def preferred_rows(records: DataFrame, key: str, row_id: str, fields: list[str], order: list[Column]) -> DataFrame:
    """(key, field_name, row_id): of each key with two rows or more, the best row that has the field.

    order: ascending preference; ties end with the smaller row_id. Only ranks and ids are shuffled, and
    they are reduced before the shuffle, so one key may hold any share of the rows. Keys that are NULL
    are left out; a field no row has gives no row; an empty table gives no rows.
    """
    kinds = dict(records.dtypes)
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(row_id).alias("id"))
    best = records.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), *[F.min(F.when(has_value(F.col(f), kinds[f]), rank)).alias(f) for f in fields]
    )
    cases = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f)["id"].alias("id")) for f in fields]))
    return (
        best.filter("n >= 2").select(key, cases.alias("c"))
        .select(key, "c.field_name", F.col("c.id").alias(row_id))
        .filter(F.col(row_id).isNotNull())
    )


def truth_discovery(claims: DataFrame, rounds: int = 10, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Iterative truth discovery over claims (entity, field_name, value, source): (truths, sources).

    Starts from plain votes. Each round a source's reliability is the smoothed share of its claims that
    hold the chosen value, its weight the log odds of that (at least 0.05), and each entity's value is
    the one with the highest sum of weights (ties: the smaller value). Ends when no reliability moves by
    more than `tolerance`, or after `rounds`. NULL values make no claim; empty claims give empty tables.
    truths: entity, field_name, value, support (share of weight), n_claims.
    """
    claims = claims.select("entity", "field_name", "value", "source").filter("entity is not null and source is not null")
    votes = cut(
        claims.filter("value is not null").groupBy("entity", "field_name", "value", "source").agg(F.count("*").alias("n")),
        "truth-votes",
    )
    sources = cut(votes.select("source").distinct().withColumn("reliability", F.lit(0.8)), "truth-sources")
    for _ in range(rounds):
        truths = _weighted_truths(votes, sources)
        hits = votes.join(truths.select("entity", "field_name", F.col("value").alias("truth")), ["entity", "field_name"])
        new = hits.groupBy("source").agg(
            ((F.sum(F.when(F.col("value") == F.col("truth"), F.col("n")).otherwise(0)) + 4.0) / (F.sum("n") + 5.0)).alias("now")
        )
        step = cut(sources.join(new, "source"), "truth-sources")
        sources = step.select("source", F.col("now").alias("reliability"))
        moved = step.agg(F.max(F.abs(F.col("now") - F.col("reliability")))).first()[0]
        if moved is None or moved <= tolerance:
            break
    return _weighted_truths(votes, sources), sources


def _weighted_truths(votes: DataFrame, sources: DataFrame) -> DataFrame:
    weight = F.greatest(F.log(F.col("reliability") / (1 - F.col("reliability"))), F.lit(0.05))
    scored = (
        votes.join(sources, "source")
        .groupBy("entity", "field_name", "value")
        .agg(F.sum(F.col("n") * weight).alias("score"), F.sum("n").alias("n"))
    )
    return scored.groupBy("entity", "field_name").agg(
        F.min_by("value", F.struct((-F.round("score", 9)).alias("s"), F.col("value"))).alias("value"),
        (F.max("score") / F.sum("score")).alias("support"),
        F.sum("n").alias("n_claims"),
    )
