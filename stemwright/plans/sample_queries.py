"""Further samplers, policies and summaries over the log, the flags and the readers' answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.operators import detector, drift, sampling
from stemwright.operators.detector import RULES
from stemwright.plans.drift_queries import _VALUES, _lines
from stemwright.plans.items import _USABLE, FLAGS_SQL, META, OPTION_COLUMNS, flags, items, main_flags, usable_rows
from stemwright.plans.rating_queries import _stratum
from stemwright.session import table

SEED = 20261021
QUOTAS = {"longest_only": 30, "clang_only": 30, "absolute_only": 20, "multi": 10, "none": 30}
NUMERIC = ["prompt_tokens", "completion_tokens", "reasoning_tokens", "cost_usd", "latency_s"]


def numeric_summary(spark, sf_dir):
    """AGG18: count, mean, spread and range of the numeric columns of the log."""
    df = table(spark, sf_dir, "items_full")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in NUMERIC])).alias("c")
    return df.select(cells).groupBy("c.column").agg(
        F.count("c.v").alias("n"), F.round(F.avg("c.v"), 6).alias("mean"), F.round(F.stddev_samp("c.v"), 6).alias("stddev"),
        F.round(F.min("c.v"), 6).alias("least"), F.round(F.max("c.v"), 6).alias("most"))


def quota_sample(spark, sf_dir):
    """SM4: fixed quotas of five strata, half plain and half guided, in hash order."""
    df = main_flags(spark, sf_dir).withColumn("stratum", _stratum())
    size = F.lit(0)
    for name, n in QUOTAS.items():
        size = F.when(F.col("stratum") == name, n // 2).otherwise(size)
    return sampling.per_stratum(df.select("job_id", "stratum", "condition"), ["stratum", "condition"], "job_id", size, SEED).select("job_id", "stratum", "condition")


def balanced_subsample(spark, sf_dir):
    """SM5: 100 items spread evenly over models and prompts."""
    df = main_flags(spark, sf_dir).select("job_id", "model_label", "condition")
    cells = df.select("model_label", "condition").distinct().agg(F.count("*").alias("k"))
    return sampling.per_stratum(df.crossJoin(F.broadcast(cells)), ["model_label", "condition"], "job_id", F.floor(F.lit(100) / F.col("k")), SEED).select(
        "job_id", "model_label", "condition")


def planted_defects(spark, sf_dir):
    """SM6: a calibration set: 20 items in hash order, eight of them with a planted defect."""
    df = items(spark, sf_dir).filter("condition = 'plain'").withColumn("h", sampling.shuffled(SEED, "job_id"))
    chosen = df.orderBy("h").limit(20).withColumn("n", F.row_number().over(W.orderBy("h")))  # 20 rows
    o = {k: F.get(F.transform(F.filter("options", lambda x: x["l"] == k), lambda x: x["t"]), F.lit(0)) for k in "ABCDE"}
    key = F.upper(F.trim("answer"))
    moved = F.translate(key, "ABCDE", "BCDEA")
    swap = F.col("n").between(4, 6)
    return chosen.select(
        "job_id", F.when(F.col("n") <= 3, "key moved").when(swap, "options swapped").when(F.col("n") <= 8, "stem replaced").otherwise("as written").alias("defect"),
        F.when(F.col("n").between(7, 8), F.lit("Which of the following is correct?")).otherwise(F.col("stem")).alias("stem"),
        F.when(swap, o["B"]).otherwise(o["A"]).alias("option_a"), F.when(swap, o["A"]).otherwise(o["B"]).alias("option_b"),
        F.when(F.col("n") <= 3, moved).otherwise(key).alias("answer"))


def verified_attempt(spark, sf_dir):
    """P10: the first attempt whose detector output equals the flags row of its job."""
    facts = ["key", "stem_words", *RULES]
    again = usable_rows(table(spark, sf_dir, "items_full")).select("job_id", "ord", "stem", "answer", detector.options_of(OPTION_COLUMNS).alias("options"))
    found = detector.detect(again, keep=["job_id", "ord"]).select("job_id", "ord", *facts)
    return found.join(flags(spark, sf_dir).select("job_id", *facts), ["job_id", *facts]).groupBy("job_id").agg(F.min("ord").alias("ord"))


def last_verdicts(spark, sf_dir):
    """P5: the last value of each flag of a job within a file; later lines overwrite."""
    values = drift.path_values(drift.parsed_lines(_lines(spark, sf_dir))).filter(F.col("field_name").isin(RULES) & F.col("job").isNotNull())
    return values.groupBy("file_name", "job", "field_name").agg(F.max_by("text", "line_no").alias("value"))


def readers_complete(spark, sf_dir):
    """JG4: items for which every question has an answer of both readers, by stratum."""
    cells = [F.trim(F.coalesce(f"reader{i}_{q}", F.lit(""))) for i in (1, 2) for q in ("q1_longest", "q2_repetition", "q3_absolute")]
    df = table(spark, sf_dir, "reader_check").select("stratum", F.forall(F.array(*cells), lambda c: c != "").alias("done"))
    return df.groupBy("stratum").agg(F.count("*").alias("n_items"), F.count_if("done").alias("n_done"))


def pooled_counts(spark, sf_dir):
    """ST37: items by number of flaws, the smallest top groups pooled downward until five items stand behind each."""
    counts = main_flags(spark, sf_dir).groupBy("n_flaws").agg(F.count("*").alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("n_flaws")).rowsBetween(W.unboundedPreceding, 0))  # one row for each number of flaws
    floor = F.max(F.when(F.col("above") >= 5, F.col("n_flaws"))).over(W.partitionBy())
    return counts.withColumn("above", above).withColumn("top", floor).groupBy(F.least("n_flaws", "top").alias("n_flaws")).agg(F.sum("n").alias("n_items"))


def version_loader_grid(spark, sf_dir):
    """Q37: any of the 14 rules for each detector version over the first and over the last usable attempt."""
    rows = usable_rows(table(spark, sf_dir, "items_full")).select("job_id", "ord", "condition", "stem", "answer", detector.options_of(OPTION_COLUMNS).alias("options"))
    ends = rows.groupBy("job_id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    kept = rows.join(ends, "job_id").filter("ord = first or ord = last")
    out = None
    for version in ("1.0", "1.1", "1.2"):
        one = detector.detect(kept, version, keep=["condition", "ord", "first", "last"])
        arms = F.explode(F.filter(F.array(F.when(F.col("ord") == F.col("first"), "first"), F.when(F.col("ord") == F.col("last"), "last")), lambda x: x.isNotNull())).alias("loader")
        sums = one.select("detector_version", "condition", arms, detector.any_flaw(RULES).alias("hit")).groupBy("detector_version", "loader", "condition").agg(
            F.count("*").alias("n_items"), F.sum("hit").alias("n_hit"))
        out = sums if out is None else out.unionByName(sums)
    return out


def item_export(spark, sf_dir):
    """Q35: the denormalised export: item texts with their flags, missing texts as ''."""
    texts = items(spark, sf_dir).select("job_id", "stem", F.coalesce("rationale", F.lit("")).alias("rationale"), F.upper(F.trim("answer")).alias("answer"))
    return texts.join(flags(spark, sf_dir).select("job_id", "model_label", "condition", "n_flaws", "key"), "job_id")


QUERIES = {f.__name__: f for f in (
    numeric_summary, quota_sample, balanced_subsample, planted_defects, verified_attempt, last_verdicts, readers_complete, pooled_counts, version_loader_grid, item_export)}

_S5 = """CASE WHEN longest_option_key + clang_cue + absolute_terms = 0 THEN 'none' WHEN longest_option_key + clang_cue + absolute_terms >= 2 THEN 'multi'
WHEN longest_option_key = 1 THEN 'longest_only' WHEN clang_cue = 1 THEN 'clang_only' ELSE 'absolute_only' END"""
_QUOTA = "CASE stratum " + " ".join(f"WHEN '{k}' THEN {n // 2}" for k, n in QUOTAS.items()) + " END"
ORACLE = {
    "numeric_summary": " UNION ALL ".join(
        f'SELECT \'{c}\' AS "column", count({c})::BIGINT AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS stddev, round(min({c})::DOUBLE, 6) AS least, round(max({c})::DOUBLE, 6) AS most FROM items_full'
        for c in NUMERIC),
    "quota_sample": f"""WITH {FLAGS_SQL}, s AS (SELECT job_id, condition, {_S5} AS stratum, md5('{SEED}|' || job_id) AS h FROM main)
SELECT job_id, stratum, condition FROM s QUALIFY row_number() OVER (PARTITION BY stratum, condition ORDER BY h, job_id) <= {_QUOTA}""",
    "balanced_subsample": f"""WITH {FLAGS_SQL}, k AS (SELECT count(*) AS k FROM (SELECT DISTINCT model_label, condition FROM main))
SELECT job_id, model_label, condition FROM main, k QUALIFY row_number() OVER (PARTITION BY model_label, condition ORDER BY md5('{SEED}|' || job_id), job_id) <= 100 // k""",
    "planted_defects": f"""WITH {FLAGS_SQL}, c AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}|' || job_id)) AS n, upper(trim(answer)) AS k FROM items WHERE condition = 'plain' QUALIFY n <= 20)
SELECT job_id, CASE WHEN n <= 3 THEN 'key moved' WHEN n <= 6 THEN 'options swapped' WHEN n <= 8 THEN 'stem replaced' ELSE 'as written' END AS defect,
CASE WHEN n IN (7, 8) THEN 'Which of the following is correct?' ELSE stem END AS stem, CASE WHEN n BETWEEN 4 AND 6 THEN option_b ELSE option_a END AS option_a,
CASE WHEN n BETWEEN 4 AND 6 THEN option_a ELSE option_b END AS option_b, CASE WHEN n <= 3 THEN translate(k, 'ABCDE', 'BCDEA') ELSE k END AS answer FROM c""",
    "verified_attempt": f"SELECT lower(trim(job_id, ' ')) AS job_id, min(ord) AS ord FROM items_full WHERE {_USABLE} GROUP BY 1",
    "last_verdicts": _VALUES + f"SELECT file_name, job, field_name, arg_max(txt, line_no) AS value FROM vals WHERE job IS NOT NULL AND field_name IN ({', '.join(repr(r) for r in RULES)}) GROUP BY file_name, job, field_name",
    "readers_complete": "SELECT stratum, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE " + " AND ".join(
        f"trim(coalesce(reader{i}_{q}, '')) <> ''" for i in (1, 2) for q in ("q1_longest", "q2_repetition", "q3_absolute")) + ")::BIGINT AS n_done FROM reader_check GROUP BY stratum",
    "pooled_counts": f"""WITH {FLAGS_SQL}, c AS (SELECT n_flaws, count(*) AS n FROM main GROUP BY n_flaws), a AS (SELECT *, sum(n) OVER (ORDER BY n_flaws DESC) AS above FROM c),
t AS (SELECT max(n_flaws) FILTER (WHERE above >= 5) AS top FROM a) SELECT least(n_flaws, top) AS n_flaws, sum(n)::BIGINT AS n_items FROM a, t GROUP BY 1""",
    "item_export": f"""WITH {FLAGS_SQL} SELECT i.job_id, i.stem, coalesce(i.rationale, '') AS rationale, upper(trim(i.answer)) AS answer, f.model_label, f.condition, f.n_flaws, f.key
FROM items i JOIN full_flags f ON i.job_id = f.job_id""",
}
