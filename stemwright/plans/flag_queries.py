"""Detector queries: items, flags, evidence and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemwright.operators import detector
from stemwright.operators.detector import FEATURES, FLAGS, RULES
from stemwright.plans.items import FLAGS_SQL, ITEMS_SQL, META, flags, items, main_flags
from stemwright.session import table

_OUT = ["job_id", *FLAGS, "n_flaws", "n_options", "key", "stem_words", "key_chars", "mean_distractor_chars"]


def items_query(spark, sf_dir):
    return items(spark, sf_dir).drop("options")


def flags_query(spark, sf_dir):
    """Q1: the flags table of the log."""
    return flags(spark, sf_dir).select(*_OUT)


def reference_flags(spark, sf_dir):
    """Q2: flags of the reference items, whose options are wide columns A to F."""
    wide = table(spark, sf_dir, "reference_items")
    cols = {letter: f"answer__{letter.lower()}" for letter in "ABCDEF"}
    rows = wide.select(
        "itemnum", "exam", "itemtype", F.col("itemstem_text").alias("stem"), F.col("answer_key").alias("answer"),
        detector.options_of(cols).alias("options"),
    )
    return detector.detect(rows, keep=["itemnum", "exam", "itemtype"]).drop("detector_version")


def flag_evidence(spark, sf_dir):
    """Texts and numbers behind the flags of items that have some."""
    out = detector.evidence(items(spark, sf_dir).select("job_id", "stem", "answer", "options"))
    return out.select(
        "job_id", "lead_in", F.array_join("clang_words", ",").alias("clang_words"), F.size("absolute_hits").alias("n_absolute"),
        F.size("vague_hits").alias("n_vague"), "key_to_longest_distractor_ratio",
    ).filter("clang_words != '' or n_absolute > 0 or n_vague > 0")


def detector_versions(spark, sf_dir):
    """Q20/Q37: how many items each rule flags in each released version."""
    base = items(spark, sf_dir)
    out = None
    for version in ("1.0", "1.1", "1.2"):
        one = detector.detect(base, version, keep=["condition"])
        sums = one.groupBy("condition", "detector_version").agg(
            F.count("*").alias("n_items"), F.sum(detector.any_flaw(RULES)).alias("n_any_flaw"), *[F.sum(f).alias(f) for f in FLAGS]
        )
        out = sums if out is None else out.unionByName(sums)
    return out


def composite_prevalence(spark, sf_dir):
    """Q20: share of items with a flaw of each composite, by prompt."""
    df = main_flags(spark, sf_dir)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("composite"), detector.any_flaw(rules).alias("hit")) for name, rules in detector.COMPOSITES.items()
    ])).alias("c")
    return df.select("condition", stacked).groupBy("condition", "c.composite").agg(
        F.count("*").alias("n_items"), F.sum("c.hit").alias("n_hit"), F.round(F.avg("c.hit"), 6).alias("share")
    )


def clang_variants(spark, sf_dir):
    """Q19: three ways to fold words in the repetition rule: all endings, plurals only, none."""
    from stemwright.functions import text as tx

    base = detector.prepared(items(spark, sf_dir).filter("condition in ('plain', 'guided')"))

    def hit(fold):
        stem, key = tx.content_words(F.col("_stem"), fold=fold), tx.content_words(F.col("_key_text"), fold=fold)
        others = F.transform("_others", lambda d: tx.content_words(d, fold=fold))
        return stem, key, others

    out = None
    for name, fold in (("lemma", tx.lemma), ("plural", tx.plural_folded), ("exact", lambda w: w)):
        s, k, o = hit(fold)
        df = base.withColumns({"_s": s, "_k": k, "_ow": o}).withColumn("_x", F.array_intersect("_s", "_k"))
        own = F.size("_x") / F.greatest(F.size("_k"), F.lit(1)).cast("double")
        best = F.coalesce(F.array_max(F.transform("_ow", lambda w: F.size(F.array_intersect("_s", w)) / F.greatest(F.size(w), F.lit(1)).cast("double"))), F.lit(0.0))
        only = F.size(F.array_except("_x", F.flatten("_ow")))
        flag = (F.col("_has_key") & (only > 0) & ((only >= 2) | (own >= 2 * best))).cast("int")
        one = df.select(F.lit(name).alias("variant"), "condition", flag.alias("hit")).groupBy("variant", "condition").agg(
            F.count("*").alias("n_items"), F.sum("hit").alias("n_hit"))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    "items": items_query, "flags": flags_query, "reference_flags": reference_flags, "flag_evidence": flag_evidence,
    "detector_versions": detector_versions, "composite_prevalence": composite_prevalence, "clang_variants": clang_variants,
}

_COMPOSITES = " UNION ALL ".join(
    f"SELECT condition, '{name}' AS composite, greatest({', '.join(rules)}) AS hit FROM main" for name, rules in detector.COMPOSITES.items()
)
ORACLE = {
    "items": f"WITH {ITEMS_SQL} SELECT {', '.join(META)}, stem, rationale, answer FROM items",
    "flags": f"WITH {FLAGS_SQL} SELECT {', '.join(_OUT)} FROM full_flags",
    "composite_prevalence": f"""WITH {FLAGS_SQL}, c AS ({_COMPOSITES})
SELECT condition, composite, count(*)::BIGINT AS n_items, sum(hit)::BIGINT AS n_hit, round(avg(hit), 6) AS share FROM c GROUP BY ALL""",
}
