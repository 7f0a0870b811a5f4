"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from stemwright.session import cut

BUCKETS = 65_536
_encoders: dict[str, object] = {}


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoder(path: str):
    if path not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, source, n_tokens) of rows (doc_id, source, text); NULL and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"]
            )

    return docs.select("doc_id", "source", "text").mapInArrow(run, "doc_id long, source string, n_tokens long")


def source_key(column: Column) -> Column:
    """One spelling for each source: lower case, no outer blanks, underscores for hyphens and blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", "")), r"[\s\-]+", "_")


def water_fill(shares: dict[str, float], capacity: dict[str, float], total: float) -> dict[str, float]:
    """Budget of each source: its share of the total, clamped at its capacity, the excess spread in proportion."""
    budget = {s: 0.0 for s in shares}
    free = {s for s in shares if capacity.get(s, 0) > 0 and shares[s] > 0}
    rest = min(total, sum(capacity[s] for s in free))
    while free:
        weight = sum(shares[s] for s in free)
        full = {s for s in free if shares[s] / weight * rest >= capacity[s]}
        if not full:
            for s in free:
                budget[s] = shares[s] / weight * rest
            break
        for s in full:
            budget[s] = float(capacity[s])
        rest -= sum(capacity[s] for s in full)
        free -= full
    return budget


def mixture(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, shares) of a mixture that gives each target source its share of tokens.

    sizes: (doc_id unique, source, n_tokens); targets: (source, target_share, max_repeats), a bounded
    dimension that is read to the driver. total: tokens of the mixture, by default those of the named
    sources once. A source takes budget / size epochs: the whole ones for each document, the rest in
    the order of a seeded hash of doc_id until its tokens are reached (never more than max_repeats).
    Documents of other or no source, and those without tokens, are not used; a target without
    documents has its share spread over the others and reports 0.
    documents: doc_id, source, copies, n_tokens; shares: one row per target source.
    """
    spark = sizes.sparkSession
    sizes = sizes.select("doc_id", "source", "n_tokens")
    goals = {r.source: r for r in targets.collect()}
    targets = targets.select("source")
    named = cut(sizes.join(F.broadcast(targets), "source").filter("n_tokens > 0"), "mix-sizes")
    available = {r[0]: r[1] for r in named.groupBy("source").agg(F.sum("n_tokens")).collect()}
    capacity = {s: available.get(s, 0) * g.max_repeats for s, g in goals.items()}
    budget = water_fill({s: g.target_share for s, g in goals.items()}, capacity, total or sum(available.values()))
    plan = []
    for s in sorted(goals):
        size = available.get(s, 0)
        whole = int(budget[s] // size) if size else 0
        plan.append((s, whole, round(budget[s] - whole * size) if size else 0))
    dim = F.broadcast(spark.createDataFrame(plan, "source string, whole int, part long"))

    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS))
    placed = named.withColumn("_bucket", place)
    held = placed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_held"))
    before = F.sum("_held").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = held.select("source", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(
        W.partitionBy("source", "_bucket").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").rowsBetween(W.unboundedPreceding, 0)
    )
    # A document is repeated once more when the middle of its tokens lies below the part of the source.
    more = (F.col("_before") + F.col("_inside") - F.col("n_tokens") / 2 < F.col("part")).cast("int")
    documents = (
        placed.withColumn("_inside", inside).join(offsets, ["source", "_bucket"]).join(dim, "source")
        .withColumn("copies", F.col("whole") + more)
        .filter("copies > 0")
        .select("doc_id", "source", "copies", "n_tokens")
    )
    used = documents.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    goal_rows = [(s, float(g.target_share), int(g.max_repeats), int(available.get(s, 0)), budget[s]) for s, g in sorted(goals.items())]
    shares = (
        spark.createDataFrame(goal_rows, T._parse_datatype_string(
            "source string, target_share double, max_repeats int, tokens_available long, tokens_planned double"))
        .join(used, "source", "left")
        .withColumn("tokens_used", F.coalesce("tokens_used", F.lit(0)))
        .withColumn("share_reached", F.try_divide("tokens_used", F.sum("tokens_used").over(W.partitionBy())))
    )
    return documents, shares
