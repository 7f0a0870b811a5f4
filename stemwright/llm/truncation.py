"""Texts cut off by field limits or in transfer.

Lengths: the discrete hazard of each length (texts that end there among those that reach it) is tested
against the hazards around it, with false-discovery control. Endings: a logistic model, fitted on a
bounded sample of sentences and their own prefixes, says whether the last sentence is finished; a last
word that no finished text of all holds is taken as cut inside. An ending that looks unfinished is a case; at a significant length or after a cut mark less doubt suffices.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.llm.samples import bounded_sample
from stemwright.session import cut

_MARK = re.compile(r"(?:\s*(?:…|\.{3,}|�+|\[\s*(?:…|\.{3})\s*\]))+\s*$")
_ASIDE = re.compile(r"\s*\([^()]*\)\s*$")
_FINISHED = r"(?U)[.?!:][\s\"'”’»)\]]*$"
_SUSPECT = r"(?U)(\.{3,}|…|�)[\s\"'”’»)\]]*$|(^|\s)[0-9.,/]+\.\s*$"
BITS = 18


def length_hazards(texts: DataFrame, groups: list[str], reach: int = 12, level: float = 0.01) -> DataFrame:
    """Per group and length: hazard, that of the lengths within `reach`, an upper bound of the Poisson tail
    probability (Chernoff) and whether it is significant by Benjamini-Hochberg at `level`.

    texts: groups and n_chars. NULL and zero lengths are left out. Works on one row per group and length.
    """
    counts = texts.filter("n_chars > 0").groupBy(*groups, "n_chars").agg(F.count("*").alias("n"))
    down = W.partitionBy(*groups).orderBy(F.desc("n_chars")).rowsBetween(W.unboundedPreceding, 0)
    near = W.partitionBy(*groups).orderBy("n_chars").rangeBetween(-reach, reach)
    risk = counts.withColumn("at_risk", F.sum("n").over(down))
    around = risk.withColumn("near_n", F.sum("n").over(near) - F.col("n")).withColumn(
        "near_risk", F.sum("at_risk").over(near) - F.col("at_risk")
    )
    expected = F.col("at_risk") * (F.col("near_n") + 0.5) / (F.greatest("near_risk", "at_risk") + 1.0)
    tail = F.when(
        F.col("n") > F.col("expected"),
        F.exp(F.col("n") - F.col("expected") + F.col("n") * F.log(F.col("expected") / F.col("n"))),
    ).otherwise(F.lit(1.0))
    tested = around.withColumn("expected", expected).withColumn("p", tail).withColumn("hazard", F.col("n") / F.col("at_risk"))
    field = groups[-1]
    up = W.partitionBy(field).orderBy("p").rangeBetween(W.unboundedPreceding, 0)
    limit = level * F.count("*").over(up) / F.count("*").over(W.partitionBy(field))
    return (
        tested.withColumn("_limit", limit)
        .withColumn("_cut", F.max(F.when(F.col("p") <= F.col("_limit"), F.col("p"))).over(W.partitionBy(field)))
        .withColumn("significant", F.coalesce(F.col("p") <= F.col("_cut"), F.lit(False)))
        .drop("_limit", "_cut", "near_n", "near_risk")
    )


def may_be_cut(text: Column) -> Column:
    """Texts whose ending has to be judged: no closing mark, a cut mark, or a number before the full stop."""
    return text.rlike(r"(?U)\S") & (~text.rlike(_FINISHED) | text.rlike(_SUSPECT))


# ---- the model of endings
def _word(token: str) -> str:
    return re.sub(r"\d+(?:[.,/]\d+)*", "0", token.strip(",;:\"'()[]“”«»")).lower()


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.?!])\s+", text.strip().strip('"').strip()) if s]


def _slots(words: list[str]) -> list[int]:
    """Hashed features of a sentence that ends after these words."""
    import zlib

    last, two, three = words[-1], " ".join(words[-2:]), " ".join(words[-3:])
    names = [f"1 {last}", f"2 {two}", f"3 {three}", f"4 {' '.join(words[-4:])}", f"f {words[0]}", f"fl {words[0]} {last}",
             f"n {min(len(words), 30)}"]
    for w in set(words[:-1]):
        names.append(f"b {w}")
        names.append(f"bl {w} {last}")
    return [zlib.crc32(n.encode()) & ((1 << BITS) - 1) for n in names]


def fit_endings(texts: list[str], seed: int = 5, epochs: int = 4) -> np.ndarray:
    """Weights from finished texts: whole sentences against prefixes of sentences."""
    rng = np.random.default_rng(seed)
    rows: list[list[int]] = []
    labels: list[int] = []
    for text in texts:
        for sentence in sentences(text):
            words = [w for w in map(_word, sentence.rstrip(".?!: ").split()) if w]
            if not words:
                continue
            rows.append(_slots(words))
            labels.append(1)
            if len(words) > 1:
                for at in rng.choice(np.arange(1, len(words)), size=min(3, len(words) - 1), replace=False):
                    rows.append(_slots(words[:at]))
                    labels.append(0)
    weights = np.zeros((1 << BITS) + 1)
    if not rows:
        return weights
    sums = np.full(len(weights), 1e-8)
    order = np.arange(len(rows))
    packed = [np.array(r) for r in rows]
    for _ in range(epochs):  # AdaGrad, one example at a time
        rng.shuffle(order)
        for i in order:
            at = packed[i]
            score = weights[at].sum() + weights[-1]
            error = labels[i] - 1.0 / (1.0 + np.exp(-score))
            if abs(error) < 0.01:
                continue
            sums[at] += error * error
            sums[-1] += error * error
            weights[at] += 0.3 * error / np.sqrt(sums[at])
            weights[-1] += 0.3 * error / np.sqrt(sums[-1])
    return weights


def text_words(texts: Iterator[str]) -> set[str]:
    """The words of finished texts; closing marks and quotes are no part of a word."""
    tokens: set[str] = set()
    for text in texts:
        tokens.update(text.split())
    return {w for t in tokens if (w := _word(t.rstrip("\"'”’»)]").rstrip(".?!:")))}


def corpus_words(texts: DataFrame, most: int = 200_000) -> DataFrame:
    """(word): the different words of all finished texts (text); a task holds about `most` of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[str] = set()
        for batch in batches:
            held |= text_words(batch.column("text").to_pylist())
            if len(held) >= most:
                yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.string())], names=["word"])
                held = set()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(sorted(held), pa.string())], names=["word"])

    return texts.select("text").mapInArrow(run, "word string").distinct()


def finished_odds(text: str, weights: np.ndarray) -> tuple[float, bool, str | None]:
    """(log odds that the last sentence is finished, whether a cut mark was there, the last word if the model judged it)."""
    bare = text.rstrip()
    unmarked = _MARK.sub("", bare)
    marked = unmarked != bare
    core = unmarked.rstrip().rstrip("\"'”’»").rstrip()
    if not marked and core.endswith(")"):
        core = _ASIDE.sub("", core)
    if not core:
        return 20.0, marked, None
    numeric = re.search(r"(?:^|\s)[\d.,/]+\.$", core) is not None
    if core[-1] in ".?!" and not numeric or core[-1] == ":" and not marked:
        return 20.0, marked, None
    if core[-1] in ",;(/-–=" or unmarked != unmarked.rstrip() and marked and core[-1] == ",":
        return -20.0, marked, None
    last = sentences(core)
    words = [w for w in map(_word, last[-1].rstrip(".").split()) if w] if last else []
    if not words:
        return -20.0, marked, None
    return float(weights[_slots(words)].sum() + weights[-1]), marked, words[-1]


def judged(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """texts (row_id, field_name, text, significant) with log_odds, marked and last_word."""
    model = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scored = [finished_odds(t, model.value) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "row_id": batch["row_id"], "field_name": batch["field_name"], "significant": batch["significant"],
                    "log_odds": [s for s, _, _ in scored], "marked": [m for _, m, _ in scored], "last_word": [x for _, _, x in scored],
                }
            )

    return texts.mapInPandas(run, "row_id long, field_name string, significant boolean, log_odds double, marked boolean, last_word string")


def truncated(
    texts: DataFrame, groups: list[str], sample_rows: int = 8_000, doubt: float = 0.0, more_doubt: float = 2.2
) -> DataFrame:
    """(row_id, field_name) of cut texts among rows (row_id, field_name, text, groups..., n_chars).

    The weights of the ending model are fitted on the finished texts among about sample_rows texts, picked by
    the hash of row_id; the words known are those of all finished texts, and every text is judged whole. NULL and blank texts are never cases; a text of one word is judged like any other.
    """
    texts = texts.select("row_id", "field_name", "text", "n_chars", *[g for g in groups if g != "field_name"])
    finished = F.col("text").isNotNull() & ~may_be_cut(F.col("text")) & F.col("text").rlike(r"\S")
    sample = bounded_sample(texts, "row_id", sample_rows).filter(finished).select("text")
    weights = fit_endings(sorted({r[0] for r in sample.toLocalIterator()}))
    lengths = length_hazards(texts, groups).filter("significant").select(*groups, "n_chars", "significant")
    suspects = texts.filter(may_be_cut(F.col("text")))
    marked = suspects.alias("t").join(
        lengths.alias("l"),
        [F.col(f"t.{c}").eqNullSafe(F.col(f"l.{c}")) for c in [*groups, "n_chars"]],
        "left",
    ).select("t.row_id", "t.field_name", "t.text", F.coalesce("l.significant", F.lit(False)).alias("significant"))
    known = cut(corpus_words(texts.filter(finished)), "ending-words")
    scored = cut(judged(marked, weights), "endings")
    if not known.isEmpty():
        # A last word that no finished text holds: the cut is inside it.
        unknown = scored.select("last_word").filter("last_word is not null").distinct().join(known, F.col("last_word") == F.col("word"), "left_anti")
        scored = scored.join(unknown.withColumn("inside", F.lit(True)), "last_word", "left").withColumn(
            "log_odds", F.when(F.col("inside"), F.least("log_odds", F.lit(-5.0))).otherwise(F.col("log_odds"))
        ).select("row_id", "field_name", "significant", "log_odds", "marked")
    else:
        scored = scored.drop("last_word")
    bar = F.when(F.col("significant") | F.col("marked"), F.lit(more_doubt)).otherwise(F.lit(doubt))
    return scored.filter(F.col("log_odds") < bar)
