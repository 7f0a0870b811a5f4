"""Queries over the log of attempts: parsing, policies, costs, providers, arms, jobs and samples."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.functions import stats as st
from stemwright.operators import dedup, jobs, parse, sampling
from stemwright.operators.detector import RULES
from stemwright.plans.items import FLAGS_SQL, ITEMS_SQL, _USABLE, flags, items, main_flags, usable_rows
from stemwright.session import table

MAJOR = ["longest_option_key", "clang_cue", "absolute_terms"]
MINOR = ["nonparallel_options", "overlapping_options", "numeric_not_ordered", "vague_terms", "grammatical_cue", "combination_options"]
SEED = 20260917


def _log(spark, sf_dir):
    return table(spark, sf_dir, "items_full").filter("job_id is not null").withColumn("job_id", F.lower(F.trim("job_id")))


def _usable():
    whole = F.length(F.trim(F.coalesce("stem", F.lit("")))) > 0
    for c in "abcde":
        whole &= F.length(F.trim(F.coalesce(f"option_{c}", F.lit("")))) > 0
    return whole & F.coalesce(F.upper(F.trim("answer")).isin(*"ABCDE"), F.lit(False))


def parse_outcomes(spark, sf_dir):
    """PV1: answers damaged in eight known ways, by what the parser makes of them."""
    base = items(spark, sf_dir).select("job_id", "stem", "answer", "rationale", F.map_from_entries("options").alias("options"))
    text = F.to_json(F.struct("stem", "options", "rationale", "answer"))
    kind = F.conv(F.substring("job_id", 1, 1), 16, 10).cast("int") % 8
    n = F.length(text)
    content = (
        F.when(kind == 0, text).when(kind == 1, F.concat(F.lit("Here it is: "), text)).when(kind == 2, F.substring(text, F.lit(1), n - 1))
        .when(kind == 3, F.concat(F.substring(text, F.lit(1), n - 1), F.lit(",}"))).when(kind == 4, F.concat(text, F.lit(" Done")))
        .when(kind == 5, "not json").when(kind == 6, "")
        .otherwise(F.to_json(F.struct("stem", "options", "rationale", F.lit("X").alias("answer"))))
    )
    out = base.select(kind.alias("damage"), parse.parse_item(content).alias("p"))
    return out.groupBy("damage", "p.repair", "p.error").agg(F.count("*").alias("n_items"), F.count_if("p.strict").alias("n_strict"))


def parse_report(spark, sf_dir):
    """Q21: first attempts, repairs and regenerations by model and prompt, with totals (rollup)."""
    real = _log(spark, sf_dir).filter("not coalesce(reparsed, false)").withColumn("_u", _usable())
    w = W.partitionBy("job_id").orderBy("ord")
    numbered = real.withColumn("_n", F.row_number().over(w))
    first = F.col("_n") == 1
    per = numbered.groupBy("job_id").agg(
        F.min_by("model_label", "ord").alias("model_label"), F.min_by("condition", "ord").alias("condition"), F.count("*").alias("tries"),
        F.bool_or(first & F.col("_u")).alias("first_ok"), F.bool_or(first & F.col("_u") & (F.coalesce("parse_repair", F.lit("none")) == "none")).alias("strict"),
        F.bool_or("_u").alias("final"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))
    c = lambda x: F.count_if(x)
    return per.rollup("model_label", "condition").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_jobs"), c(F.col("strict")).alias("n_strict"), c(F.col("first_ok")).alias("n_first_ok"),
        c(F.col("first_ok") & ~F.col("strict")).alias("n_repaired"), c(F.col("tries") > 1).alias("n_regenerated"), c(F.col("final")).alias("n_final"),
        F.sum("tokens").alias("tokens"))


def repair_histogram(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("model_label", F.coalesce("parse_repair", F.lit("?")).alias("parse_repair")).agg(F.count("*").alias("n_rows"))


def error_histogram(spark, sf_dir):
    said = F.lower(F.trim(F.coalesce("parse_error", F.lit(""))))
    return _log(spark, sf_dir).groupBy("model_label", F.when(said.isin("", "none"), "none").otherwise(said).alias("error")).agg(F.count("*").alias("n_rows"))


def cost_ledger(spark, sf_dir):
    """Q21: cost of all attempts by run, prompt and tier, with totals (rollup)."""
    df = _log(spark, sf_dir).withColumn("tier", F.coalesce("tier", F.lit("?"))).withColumn("condition", F.coalesce("condition", F.lit("?")))
    return df.rollup("run", "condition", "tier").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_attempts"), F.round(F.sum(F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,8)")), 6).cast("double").alias("cost_usd"))


def run_summary(spark, sf_dir):
    """Q21: attempts, latency and tokens by model."""
    return _log(spark, sf_dir).groupBy("model_label").agg(
        F.count("*").alias("n_attempts"), F.count_distinct("job_id").alias("n_jobs"), F.count_if("ok").alias("n_ok"),
        F.round(F.avg("latency_s"), 6).alias("mean_latency"), F.round(F.percentile("latency_s", 0.5), 6).alias("median_latency"),
        F.round(F.avg("completion_tokens"), 6).alias("mean_tokens"))


def first_usable(spark, sf_dir):
    return dedup.first_where(_log(spark, sf_dir), ["job_id"], "ord", _usable()).select("job_id", "ord")


def first_parsed(spark, sf_dir):
    return dedup.first_where(_log(spark, sf_dir), ["job_id"], "ord", F.col("stem").isNotNull()).select("job_id", "ord")


def success_else_first(spark, sf_dir):
    return dedup.success_else_first(_log(spark, sf_dir), ["job_id"], "ord", F.col("stem").isNotNull()).select("job_id", "ord")


def last_row(spark, sf_dir):
    return dedup.last_row(_log(spark, sf_dir), ["job_id"], "ord").select("job_id", "ord")


def label_collapse(spark, sf_dir):
    """Items all of whose ratings of q1 agree, with the first of them."""
    df = table(spark, sf_dir, "main_r2").filter("q1 is not null").select("item_id", "row_id", F.lower(F.trim("q1")).alias("label"))
    return dedup.agreed_only(df, ["item_id"], "row_id", "label")


def jobs_done(spark, sf_dir):
    return dedup.done_keys(_log(spark, sf_dir), ["job_id"], _usable())


def provider_mix(spark, sf_dir):
    """Q15: share of each provider within a model."""
    df = items(spark, sf_dir).filter("provider != ''").groupBy("model_label", "provider").agg(F.count("*").alias("n_items"))
    return df.withColumn("share", F.round(F.col("n_items") / F.sum("n_items").over(W.partitionBy("model_label")), 6))


def _primary(df):
    w = W.partitionBy("model_label").orderBy(F.desc("n"), "provider")
    counts = df.filter("provider != ''").groupBy("model_label", "provider").agg(F.count("*").alias("n"))
    return counts.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("model_label", "provider")


def primary_provider(spark, sf_dir):
    """Q15: the most frequent provider of each model (ties by name)."""
    return _primary(items(spark, sf_dir))


def primary_only_prevalence(spark, sf_dir):
    """Q15: share with a flaw by prompt, over all items and over those of the primary provider."""
    df = main_flags(spark, sf_dir)
    kept = df.join(F.broadcast(_primary(df)), ["model_label", "provider"], "left_semi")  # one row for each model
    both = df.withColumn("rows", F.lit("all")).unionByName(kept.withColumn("rows", F.lit("primary")))
    return both.groupBy("rows", "condition").agg(F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.round(F.avg("any_flaw"), 6).alias("share"))


def position_compliance(spark, sf_dir):
    """Q10: how often the key stands where it was asked for, by target, with Wilson intervals."""
    df = items(spark, sf_dir).filter("condition = 'guided_position' and target_position is not null")
    out = df.groupBy("target_position").agg(F.count("*").alias("n_items"), F.count_if(F.upper(F.trim("answer")) == F.col("target_position")).alias("n_hit"))
    return st.with_wilson(out, "n_hit", "n_items")


_STABILITY = ["model_label", "specialty", "topic_index", "condition"]


def stability_match(spark, sf_dir):
    """Q13: a later run of a cell against the original one: same number of stem words (the proxy for the same item), key and composite.

    The log holds one run, so repetition 1 stands for the re-run and repetition 0 for the original; jobs of a cell are matched each with each, as a merge on the cell does.
    """
    df = main_flags(spark, sf_dir).select(*_STABILITY, "rep", "stem_words", "key", "any_flaw")
    side = lambda r, n: df.filter(f"rep = {r}").select(*_STABILITY, *[F.col(c).alias(f"{c}_{n}") for c in ("stem_words", "key", "any_flaw")])
    same = lambda c: F.count_if(F.col(f"{c}_o") == F.col(f"{c}_s"))
    return side(0, "o").join(side(1, "s"), _STABILITY).groupBy("model_label").agg(
        F.count("*").alias("n_pairs"), same("stem_words").alias("n_same_words"), same("key").alias("n_same_key"), same("any_flaw").alias("n_same_any"))


def stability_change(spark, sf_dir):
    """Q13: share with a flaw and key letters, original against re-run, by model and prompt, with Wilson intervals."""
    out = main_flags(spark, sf_dir).filter("rep in (0, 1)").groupBy("model_label", "condition", F.when(F.col("rep") == 0, "original").otherwise("rerun").alias("run")).agg(
        F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.sum("key_a").alias("n_key_a"))
    return st.with_wilson(out, "n_hit", "n_items")


def by_temperature(spark, sf_dir):
    """Q14: share with a flaw by temperature."""
    return main_flags(spark, sf_dir).groupBy("temperature").agg(F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"))


def reasoning_arm(spark, sf_dir):
    """Q9: reasoning on against off, for models and topics that have both."""
    df = flags(spark, sf_dir).withColumn("any_flaw", F.greatest(*RULES)).filter("condition in ('plain', 'guided')")
    on = df.filter("reasoning_mode = 'on'")
    off = df.filter("reasoning_mode = 'off'").join(on.select("model_label", "specialty", "topic_index").distinct(), ["model_label", "specialty", "topic_index"], "left_semi")
    return on.unionByName(off).groupBy("reasoning_mode", "condition").agg(
        F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.round(F.avg(F.log2(1 + F.col("reasoning_tokens"))), 6).alias("mean_log2_tokens"))


def prompt_arms(spark, sf_dir):
    """Q11/Q12: every prompt arm on the topics all of them share: flaws, key A and option order."""
    df = flags(spark, sf_dir).withColumn("any_flaw", F.greatest(*RULES))
    shared = df.groupBy("specialty", "topic_index").agg(F.count_distinct("condition").alias("k")).filter("k >= 3").select("specialty", "topic_index")
    return df.join(shared, ["specialty", "topic_index"], "left_semi").groupBy("condition").agg(
        F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.count_if(F.col("key") == "A").alias("n_key_a"),
        F.count_if(F.col("options_not_alphabetical") == 0).alias("n_alphabetical"))


def job_grid(spark, sf_dir):
    """JG1: the grid of the models and topics of the log."""
    log = _log(spark, sf_dir)
    models = log.select("model_id").distinct().withColumn("model_index", (F.row_number().over(W.orderBy("model_id")) - 1).cast("int"))
    topics = log.select("specialty", "topic_index").distinct().withColumn("global_topic_index", (F.row_number().over(W.orderBy("specialty", "topic_index")) - 1).cast("int"))
    return jobs.job_grid(models, topics, ["plain", "guided", "guided_position"], 2)


def resume_todo(spark, sf_dir):
    """JG2: jobs of the log without a usable attempt, with the index and the seed of the next one."""
    log = _log(spark, sf_dir)
    known = log.groupBy("job_id").agg(F.min_by("seed", "ord").alias("seed"))
    return jobs.to_do(known, log.withColumn("_u", _usable()), F.col("_u"))


def cost_capped(spark, sf_dir):
    """JG5: attempts in the order of the log while the cost before them stays under 1 dollar."""
    return jobs.within_cost(_log(spark, sf_dir).select("ord", "cost_usd"), "ord", "cost_usd", 1.0).select("ord")


def stratum_partition(spark, sf_dir):
    """SM1: items by their first flagging rule."""
    return flags(spark, sf_dir).groupBy(sampling.first_hit(MAJOR + MINOR, RULES).alias("stratum")).agg(F.count("*").alias("n_items"))


def stratified_sample(spark, sf_dir):
    """SM2: 50 of each major, 30 of each minor rule, 200 unflagged spread over model and prompt."""
    df = flags(spark, sf_dir).withColumn("stratum", sampling.first_hit(MAJOR + MINOR, RULES))
    size = F.when(F.col("stratum").isin([f"flagged:{r}" for r in MAJOR]), 50).otherwise(30)
    flagged = sampling.per_stratum(df.filter("stratum != 'unflagged'").select("job_id", "stratum"), ["stratum"], "job_id", size, SEED)
    clean = df.filter("stratum = 'unflagged'").select("job_id", "stratum", "model_label", "condition")
    cells = clean.select("model_label", "condition").distinct().agg(F.count("*").alias("k"))
    part = sampling.per_stratum(clean.crossJoin(F.broadcast(cells)), ["model_label", "condition"], "job_id", F.greatest(F.lit(1), F.floor(F.lit(200) / F.col("k"))), SEED)
    return flagged.select("job_id", "stratum").unionByName(part.select("job_id", "stratum"))


def second_pass(spark, sf_dir):
    """SM3: exactly 60 items, each stratum by its share, topped up in hash order."""
    df = flags(spark, sf_dir).select("job_id", sampling.first_hit(MAJOR + MINOR, RULES).alias("stratum")).withColumn("h", sampling.shuffled(SEED + 1, "job_id"))
    total = df.agg(F.count("*").alias("total"))
    w = W.partitionBy("stratum").orderBy("h")
    ranked = df.withColumn("n", F.row_number().over(w)).withColumn("k", F.count("*").over(W.partitionBy("stratum"))).crossJoin(F.broadcast(total))
    due = F.greatest(F.lit(1), F.round(F.col("k") * 60 / F.col("total")))
    return ranked.select("job_id", "stratum", (F.col("n") > due).cast("int").alias("topped_up"), "h").orderBy("topped_up", "h").limit(60).select("job_id", "stratum", "topped_up")


QUERIES = {f.__name__: f for f in (
    parse_outcomes, parse_report, repair_histogram, error_histogram, cost_ledger, run_summary, first_usable, first_parsed, success_else_first, last_row,
    label_collapse, jobs_done, provider_mix, primary_provider, primary_only_prevalence, position_compliance, stability_match, stability_change, by_temperature,
    reasoning_arm, prompt_arms, job_grid, resume_todo, cost_capped, stratum_partition, stratified_sample, second_pass)}

_LOG = f"l AS (SELECT * REPLACE (lower(trim(job_id, ' ')) AS job_id), coalesce({_USABLE}, false) AS u FROM items_full WHERE job_id IS NOT NULL)"
_STRATUM = "CASE " + " ".join(f"WHEN {r} = 1 THEN 'flagged:{r}'" for r in MAJOR + MINOR) + f" WHEN greatest({', '.join(RULES)}) = 1 THEN 'other_flag' ELSE 'unflagged' END"
_DAMAGE = "('0x' || job_id[1])::INT % 8"
from stemwright.plans.report_queries import _wilson_sql  # noqa: E402

ORACLE = {
    "parse_outcomes": f"""WITH {ITEMS_SQL}, d AS (SELECT {_DAMAGE} AS damage FROM items)
SELECT damage, CASE damage WHEN 0 THEN 'none' WHEN 1 THEN 'outer_braces' WHEN 2 THEN 'append_brace' WHEN 3 THEN 'trailing_comma' WHEN 4 THEN 'outer_braces' END AS repair,
CASE damage WHEN 5 THEN 'not_json' WHEN 6 THEN 'empty' WHEN 7 THEN 'answer_not_in_options' END AS error, count(*)::BIGINT AS n_items,
count(*) FILTER (WHERE damage = 0)::BIGINT AS n_strict FROM d GROUP BY ALL""",
    "parse_report": f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n FROM l WHERE NOT coalesce(reparsed, false)),
p AS (SELECT job_id, arg_min(coalesce(model_label, ''), ord) AS model_label, arg_min(coalesce(condition, ''), ord) AS condition, count(*) AS tries, bool_or(n = 1 AND u) AS first_ok,
bool_or(n = 1 AND u AND coalesce(parse_repair, 'none') = 'none') AS strict, bool_or(u) AS final, sum(coalesce(completion_tokens, 0)) AS tokens FROM r GROUP BY job_id)
SELECT nullif(model_label, '') AS model_label, nullif(condition, '') AS condition, level, n_jobs, n_strict, n_first_ok, n_repaired, n_regenerated, n_final, tokens FROM (
SELECT model_label, condition, grouping_id(model_label, condition)::BIGINT AS level, count(*)::BIGINT AS n_jobs, count(*) FILTER (WHERE strict)::BIGINT AS n_strict,
count(*) FILTER (WHERE first_ok)::BIGINT AS n_first_ok, count(*) FILTER (WHERE first_ok AND NOT strict)::BIGINT AS n_repaired, count(*) FILTER (WHERE tries > 1)::BIGINT AS n_regenerated,
count(*) FILTER (WHERE final)::BIGINT AS n_final, sum(tokens)::BIGINT AS tokens FROM p GROUP BY ROLLUP (model_label, condition))""",
    "repair_histogram": f"WITH {_LOG} SELECT model_label, coalesce(parse_repair, '?') AS parse_repair, count(*)::BIGINT AS n_rows FROM l GROUP BY ALL",
    "error_histogram": f"WITH {_LOG} SELECT model_label, CASE WHEN lower(trim(coalesce(parse_error, ''))) IN ('', 'none') THEN 'none' ELSE lower(trim(parse_error)) END AS error, count(*)::BIGINT AS n_rows FROM l GROUP BY ALL",
    "cost_ledger": f"""WITH {_LOG}, c AS (SELECT run, coalesce(condition, '?') AS condition, coalesce(tier, '?') AS tier, coalesce(cost_usd, 0)::DECIMAL(18, 8) AS cost FROM l)
SELECT run, condition, tier, grouping_id(run, condition, tier)::BIGINT AS level, count(*)::BIGINT AS n_attempts, round(sum(cost), 6)::DOUBLE AS cost_usd FROM c GROUP BY ROLLUP (run, condition, tier)""",
    "run_summary": f"""WITH {_LOG} SELECT model_label, count(*)::BIGINT AS n_attempts, count(DISTINCT job_id)::BIGINT AS n_jobs, count(*) FILTER (WHERE ok)::BIGINT AS n_ok,
round(avg(latency_s), 6) AS mean_latency, round(quantile_cont(latency_s, 0.5), 6) AS median_latency, round(avg(completion_tokens), 6) AS mean_tokens FROM l GROUP BY model_label""",
    "first_usable": f"WITH {_LOG} SELECT job_id, min(ord) AS ord FROM l WHERE u GROUP BY job_id",
    "first_parsed": f"WITH {_LOG} SELECT job_id, min(ord) AS ord FROM l WHERE stem IS NOT NULL GROUP BY job_id",
    "success_else_first": f"WITH {_LOG} SELECT job_id, coalesce(min(ord) FILTER (WHERE stem IS NOT NULL), min(ord)) AS ord FROM l GROUP BY job_id",
    "last_row": f"WITH {_LOG} SELECT job_id, max(ord) AS ord FROM l GROUP BY job_id",
    "label_collapse": "SELECT item_id, min(row_id) AS row_id, min(lower(trim(q1))) AS label FROM main_r2 WHERE q1 IS NOT NULL GROUP BY item_id HAVING count(DISTINCT lower(trim(q1))) = 1",
    "jobs_done": f"WITH {_LOG} SELECT DISTINCT job_id FROM l WHERE u",
    "provider_mix": f"""WITH {ITEMS_SQL}, c AS (SELECT model_label, provider, count(*)::BIGINT AS n_items FROM items WHERE provider <> '' GROUP BY ALL)
SELECT *, round(n_items / sum(n_items) OVER (PARTITION BY model_label), 6) AS share FROM c""",
    "primary_provider": f"""WITH {ITEMS_SQL}, c AS (SELECT model_label, provider, count(*) AS n FROM items WHERE provider <> '' GROUP BY ALL)
SELECT model_label, provider FROM c QUALIFY row_number() OVER (PARTITION BY model_label ORDER BY n DESC, provider) = 1""",
    "primary_only_prevalence": f"""WITH {FLAGS_SQL}, c AS (SELECT model_label, provider, count(*) AS n FROM main WHERE provider <> '' GROUP BY ALL),
p AS (SELECT model_label, provider FROM c QUALIFY row_number() OVER (PARTITION BY model_label ORDER BY n DESC, provider) = 1),
b AS (SELECT 'all' AS rows, condition, any_flaw FROM main UNION ALL SELECT 'primary', condition, any_flaw FROM main SEMI JOIN p USING (model_label, provider))
SELECT rows, condition, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit, round(avg(any_flaw), 6) AS share FROM b GROUP BY ALL""",
    "position_compliance": f"""WITH {ITEMS_SQL}, c AS (SELECT target_position, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE upper(trim(answer)) = target_position)::BIGINT AS n_hit
FROM items WHERE condition = 'guided_position' AND target_position IS NOT NULL GROUP BY ALL) SELECT *, {_wilson_sql('n_hit', 'n_items')} FROM c""",
    "stability_match": f"""WITH {FLAGS_SQL} SELECT x.model_label, count(*)::BIGINT AS n_pairs, count(*) FILTER (WHERE x.stem_words = y.stem_words)::BIGINT AS n_same_words,
count(*) FILTER (WHERE x.key = y.key)::BIGINT AS n_same_key, count(*) FILTER (WHERE x.any_flaw = y.any_flaw)::BIGINT AS n_same_any
FROM main x JOIN main y USING (model_label, specialty, topic_index, condition) WHERE x.rep = 0 AND y.rep = 1 GROUP BY x.model_label""",
    "stability_change": f"""WITH {FLAGS_SQL}, c AS (SELECT model_label, condition, CASE rep WHEN 0 THEN 'original' ELSE 'rerun' END AS run, count(*)::BIGINT AS n_items,
sum(any_flaw)::BIGINT AS n_hit, sum(key_a)::BIGINT AS n_key_a FROM main WHERE rep IN (0, 1) GROUP BY ALL) SELECT *, {_wilson_sql('n_hit', 'n_items')} FROM c""",
    "by_temperature": f"WITH {FLAGS_SQL} SELECT temperature, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit FROM main GROUP BY temperature",
    "reasoning_arm": f"""WITH {FLAGS_SQL}, d AS (SELECT * FROM full_flags WHERE condition IN ('plain', 'guided')),
k AS (SELECT DISTINCT model_label, specialty, topic_index FROM d WHERE reasoning_mode = 'on'),
b AS (SELECT * FROM d WHERE reasoning_mode = 'on' UNION ALL SELECT * FROM d SEMI JOIN k USING (model_label, specialty, topic_index) WHERE reasoning_mode = 'off')
SELECT reasoning_mode, condition, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit, round(avg(log2(1 + reasoning_tokens)), 6) AS mean_log2_tokens FROM b GROUP BY ALL""",
    "prompt_arms": f"""WITH {FLAGS_SQL}, k AS (SELECT specialty, topic_index FROM full_flags GROUP BY ALL HAVING count(DISTINCT condition) >= 3)
SELECT condition, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit, count(*) FILTER (WHERE key = 'A')::BIGINT AS n_key_a,
count(*) FILTER (WHERE options_not_alphabetical = 0)::BIGINT AS n_alphabetical FROM full_flags SEMI JOIN k USING (specialty, topic_index) GROUP BY condition""",
    "job_grid": f"""WITH {_LOG}, m AS (SELECT model_id, row_number() OVER (ORDER BY model_id) - 1 AS mi FROM (SELECT DISTINCT model_id FROM l)),
t AS (SELECT specialty, topic_index, row_number() OVER (ORDER BY specialty, topic_index) - 1 AS gt FROM (SELECT DISTINCT specialty, topic_index FROM l)),
g AS (SELECT *, unnest([0, 1]) AS rep FROM (SELECT *, unnest(['plain', 'guided', 'guided_position']) AS condition FROM m, t))
SELECT sha1(concat_ws('|', model_id, specialty, topic_index, condition, rep))[1:12] AS job_id, model_id, specialty, topic_index, condition, rep, 1000 + rep AS seed,
CASE WHEN condition = 'guided_position' THEN 'ABCDE'[((gt + mi + rep) % 5 + 1)::INT] END AS target_position FROM g""",
    "resume_todo": f"""WITH {_LOG} SELECT job_id, arg_min(seed, ord) AS seed, count(*)::BIGINT AS retry_index, (arg_min(seed, ord) + 1000 * count(*))::BIGINT AS next_seed
FROM l GROUP BY job_id HAVING NOT bool_or(u)""",
    "cost_capped": f"""WITH {_LOG}, s AS (SELECT ord, coalesce(sum(coalesce(cost_usd, 0)) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM l)
SELECT ord FROM s WHERE b < 1.0""",
    "stratum_partition": f"WITH {FLAGS_SQL} SELECT {_STRATUM} AS stratum, count(*)::BIGINT AS n_items FROM full_flags GROUP BY stratum",
    "stratified_sample": f"""WITH {FLAGS_SQL}, s AS (SELECT job_id, model_label, condition, {_STRATUM} AS stratum, md5('{SEED}|' || job_id) AS h FROM full_flags),
k AS (SELECT count(*) AS k FROM (SELECT DISTINCT model_label, condition FROM s WHERE stratum = 'unflagged'))
SELECT job_id, stratum FROM s WHERE stratum <> 'unflagged' QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY h, job_id) <= CASE WHEN stratum IN ({', '.join(f"'flagged:{r}'" for r in MAJOR)}) THEN 50 ELSE 30 END
UNION ALL SELECT job_id, stratum FROM s, k WHERE stratum = 'unflagged' QUALIFY row_number() OVER (PARTITION BY model_label, condition ORDER BY h, job_id) <= greatest(1, 200 // k)""",
    "second_pass": f"""WITH {FLAGS_SQL}, s AS (SELECT job_id, {_STRATUM} AS stratum, md5('{SEED + 1}|' || job_id) AS h FROM full_flags),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h) AS n, count(*) OVER (PARTITION BY stratum) AS k, count(*) OVER () AS total FROM s),
d AS (SELECT job_id, stratum, (n > greatest(1, round(k * 60 / total)))::INT AS topped_up, h FROM r)
SELECT job_id, stratum, topped_up FROM d ORDER BY topped_up, h LIMIT 60""",
}
