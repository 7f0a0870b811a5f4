"""Consensus from several annotators: expectation-maximisation over confusion matrices, and agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.session import cut

KEY = ["question", "item_id"]
PATTERN = ["question", "pattern", "check"]
ENTRY = ["question", "rater", "label", "truth"]


def label_counts(votes: DataFrame) -> DataFrame:
    """votes (item_id, question, rater, label) -> one row per item, question and label with n and n_votes."""
    counts = votes.dropna(subset=[*KEY, "label"]).groupBy(*KEY, "label").agg(F.count("*").alias("n"))
    return counts.withColumn("n_votes", F.sum("n").over(W.partitionBy(*KEY)))


def agreement(votes: DataFrame) -> DataFrame:
    """Krippendorff's nominal alpha and raw pairwise agreement for each question, over items with two votes or more.

    NULL where no item has two votes, or where all votes agree on one label in total.
    """
    counts = label_counts(votes).filter("n_votes >= 2")
    total = counts.groupBy("question", "label").agg(F.sum("n").alias("m"))
    pairs = F.sum(F.col("n") * (F.col("n_votes") - F.col("n")) / (F.col("n_votes") - 1))
    seen = counts.groupBy("question").agg(F.sum("n").alias("all_n"), pairs.alias("differ"))
    chance = total.groupBy("question").agg(F.sum(F.col("m") * F.col("m")).alias("squares"))
    observed = F.col("differ") / F.col("all_n")
    expected = (F.col("all_n") * F.col("all_n") - F.col("squares")) / (F.col("all_n") * (F.col("all_n") - 1))
    return seen.join(chance, "question").select(
        "question", F.col("all_n").alias("n_votes"), (1 - observed).alias("raw_agreement"),
        F.when(expected > 0, 1 - observed / expected).alias("alpha"),
    )


def vote_patterns(votes: DataFrame) -> DataFrame:
    """(question, item_id, pattern, check): two 64-bit sums over the votes of an item; equal votes give equal sums."""
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "rater", "label").cast("decimal(20,0)"))
    sums = votes.groupBy(*KEY).agg(mark(1).alias("a"), mark(2).alias("b"))
    return sums.select(*KEY, F.xxhash64("a").alias("pattern"), F.xxhash64("b").alias("check"))


def _parameters(confusions: DataFrame, smoothing: float) -> DataFrame:
    """Cells that occur with `given`, P(label | truth) of the rater, and the log prior of the truth.

    A rater's row has the smoothing once for each label of the question and once more for the truth itself.
    """
    classes = confusions.groupBy("question", "truth").agg(F.sum("items").alias("k"))
    question = W.partitionBy("question")
    n_labels = F.count("*").over(question)
    prior = F.log((F.col("k") + smoothing) / (F.sum("k").over(question) + smoothing * n_labels))
    mass = F.sum("w").over(W.partitionBy("question", "rater", "truth"))
    extra = F.when(F.col("label") == F.col("truth"), 2 * smoothing).otherwise(smoothing)
    return confusions.withColumn("mass", mass).join(classes.select("question", "truth", n_labels.alias("n_labels"), prior.alias("log_prior")), ["question", "truth"]).select(
        *ENTRY, "log_prior", ((F.col("w") + extra) / (F.col("mass") + smoothing * (F.col("n_labels") + 1))).alias("given")
    )


def _scored(cells: DataFrame, parameters: DataFrame) -> DataFrame:
    """(pattern, truth, n_votes, p): posteriors of the labels voted for in each pattern; every cell has its parameters."""
    score = F.sum(F.log("given")) + F.max("log_prior")
    joined = cells.join(parameters, ENTRY).groupBy(*PATTERN, "truth").agg(score.alias("s"), F.count("*").alias("n_votes"))
    one = W.partitionBy(*PATTERN)
    raised = joined.withColumn("e", F.exp(F.col("s") - F.max("s").over(one)))
    return raised.select(*PATTERN, "truth", "n_votes", (F.col("e") / F.sum("e").over(one)).alias("p"))


def _estimated(cells: DataFrame, posteriors: DataFrame) -> DataFrame:
    """The confusion cells that occur: w votes and the share `items` of the items they stand for; in the shared folder."""
    soft = cells.join(posteriors.select(*PATTERN, "truth", "p", "n_votes"), [*PATTERN, "truth"])
    weight = F.col("m") * F.col("p")
    return cut(soft.groupBy(*ENTRY).agg(F.sum(weight).alias("w"), F.sum(weight / F.col("n_votes")).alias("items")), "confusions")


def annotator_model(votes: DataFrame, smoothing: float = 1.0, rounds: int = 10, tolerance: float = 1e-2) -> tuple[DataFrame, DataFrame, bool]:
    """(posteriors, reliabilities, converged) by expectation-maximisation over each rater's confusion matrix.

    votes: (item_id, question, rater, label), a rater at most once per item and question. Items with the
    same votes have the same posterior, so the rounds run over the different vote patterns, weighted by their
    numbers of items. Confusion cells that don't occur are never made: they have the smoothing constant. The
    truth of an item is one of the labels voted for. Starts from the shares of votes; ends when no cell
    moves by more than the tolerance of its rater's votes, or after `rounds` (then converged is false).
    posteriors: question, item_id, truth, p. reliabilities: question, rater, n_votes, reliability = smoothed
    chance that the rater gives the true label, over the labels the rater used. Votes with a NULL are left out; empty votes give empty tables.
    """
    votes = votes.select(*KEY, "rater", "label").dropna()
    patterns = cut(vote_patterns(votes), "vote-patterns")
    kinds = patterns.groupBy(*PATTERN).agg(F.count("*").alias("m"), F.min("item_id").alias("item_id"))
    sample = cut(votes.join(kinds, KEY).select(*PATTERN, "m", "rater", "label"), "pattern-votes")
    truths = sample.groupBy(*PATTERN, F.col("label").alias("truth")).agg(F.count("*").alias("n"), F.max("m").alias("m"))
    cells = cut(sample.join(truths.select(*PATTERN, "truth"), PATTERN), "pattern-cells")
    total = F.sum("n").over(W.partitionBy(*PATTERN))
    confusions, converged = _estimated(cells, truths.select("*", total.alias("n_votes"), (F.col("n") / total).alias("p"))), False
    cast = cut(sample.groupBy("question", "rater").agg(F.sum("m").alias("n_votes")), "raters")
    for _ in range(rounds - 1):
        new = _estimated(cells, _scored(cells, _parameters(confusions, smoothing)))
        both = new.join(confusions.select(*ENTRY, F.col("w").alias("old")), ENTRY).join(cast, ["question", "rater"])
        change = both.agg(F.max(F.abs(F.col("w") - F.col("old")) / (F.col("n_votes") + smoothing))).first()[0]
        confusions = new
        if change is None or change <= tolerance:
            converged = True
            break
    parameters = _parameters(confusions, smoothing)
    last, weight = _scored(cells, parameters), F.exp("log_prior")
    hits = parameters.filter("label = truth").groupBy("question", "rater").agg((F.sum(weight * F.col("given")) / F.sum(weight)).alias("reliability"))
    return patterns.join(last, PATTERN).select(*KEY, "truth", "p"), cast.join(hits, ["question", "rater"]), converged


def consensus_labels(votes: DataFrame, **model: float) -> DataFrame:
    """One row per item and question: the label of the highest posterior (ties: more votes, then the greater label), with n, n_votes and posterior.

    top and top_label: the most votes a label of the item has, and that label (ties: the smaller label).
    """
    posteriors = annotator_model(votes, **model)[0].select(*KEY, F.col("truth").alias("label"), F.col("p").alias("posterior"))
    both = votes.dropna(subset=[*KEY, "label"]).groupBy(*KEY, "label").agg(F.count("*").alias("n")).join(posteriors, [*KEY, "label"])
    best = F.max(F.struct(F.round("posterior", 9).alias("r"), "n", "label", "posterior")).alias("b")
    most = F.min(F.struct((-F.col("n")).alias("k"), "label")).alias("t")
    return both.groupBy(*KEY).agg(best, most, F.sum("n").alias("n_votes")).select(
        *KEY, "b.label", "b.n", "n_votes", "b.posterior", (-F.col("t.k")).alias("top"), F.col("t.label").alias("top_label")
    )
