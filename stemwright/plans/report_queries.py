"""Report queries over the flags table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.functions import stats as st
from stemwright.functions import text as tx
from stemwright.operators import detector
from stemwright.operators.detector import FLAGS, RULES, VALIDATED
from stemwright.plans.items import FLAGS_SQL, flags, items, main_flags

LETTERS = "ABCDE"


def _wilson_sql(k: str, n: str) -> str:
    c = f"(({k}::DOUBLE / {n} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))"
    h = f"(1.96 * sqrt({k}::DOUBLE / {n} * (1 - {k}::DOUBLE / {n}) / {n} + 3.8416 / (4 * {n}::DOUBLE * {n})) / (1 + 3.8416 / {n}))"
    return f"round({k}::DOUBLE / {n}, 6) AS share, round(greatest(0, {c} - {h}), 6) AS share_lo, round(least(1, {c} + {h}), 6) AS share_hi"


def _sums(df: DataFrame, keys: list[str], hit: str = "any_flaw") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_items"), F.sum(hit).alias("n_hit"))


def flag_prevalence(spark, sf_dir):
    """Q3: items with a flaw by model and prompt, Wilson interval, mean number of flaws."""
    out = main_flags(spark, sf_dir).groupBy("model_label", "condition").agg(
        F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.round(F.avg("n_flaws"), 6).alias("mean_flaws"))
    return st.with_wilson(out, "n_hit", "n_items")


def _unpivoted(df: DataFrame, keep: list[str], names: list[str]) -> DataFrame:
    cases = F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("hit")) for f in names])).alias("c")
    return df.select(*keep, cases).select(*keep, "c.flag", "c.hit")


def flag_by_rule(spark, sf_dir):
    """Q5: prevalence of each flag by prompt."""
    return st.with_wilson(_sums(_unpivoted(main_flags(spark, sf_dir), ["condition"], FLAGS), ["flag", "condition"], "hit"), "n_hit", "n_items")


def mean_flaws_change(spark, sf_dir):
    """Q3: mean flaws per model, plain against guided."""
    df = main_flags(spark, sf_dir).groupBy("model_label").pivot("condition", ["plain", "guided"]).agg(F.avg("n_flaws"))
    return df.select("model_label", F.round("plain", 6).alias("plain"), F.round("guided", 6).alias("guided"), F.round(F.col("guided") - F.col("plain"), 6).alias("change"))


def key_position_chi2(spark, sf_dir):
    """Q5: key letters by model and prompt, chi-square against equal shares, Benjamini-Hochberg q by prompt."""
    out = main_flags(spark, sf_dir).groupBy("model_label", "condition").agg(*[F.count_if(F.col("key") == x).alias(f"key_{x.lower()}") for x in LETTERS])
    chi2, p = st.chi2_uniform([F.col(f"key_{x.lower()}").cast("double") for x in LETTERS])
    out = st.bh_adjusted(out.withColumns({"chi2": chi2, "p": p}), "p", ["condition"], ["model_label"])
    return out.withColumns({"chi2": F.round("chi2", 6), "p": F.round("p", 9), "q": F.round("q", 9)})


def tier_condition_pivot(spark, sf_dir):
    """Q8: share with a flaw by tier, prompts side by side and together."""
    df = main_flags(spark, sf_dir)
    share = F.round(F.avg("any_flaw"), 6)
    per = df.groupBy("tier").pivot("condition", ["plain", "guided"]).agg(share)
    both = df.groupBy("tier").agg(F.count("*").alias("n_items"), share.alias("both"))
    return per.join(both, "tier")


def specialty_condition(spark, sf_dir):
    """Q5: share with a flaw by specialty and prompt, with totals over each (rollup)."""
    df = main_flags(spark, sf_dir)
    return df.rollup("specialty", "condition").agg(
        F.grouping_id().cast("long").alias("level"), F.count("*").alias("n_items"), F.sum("any_flaw").alias("n_hit"), F.round(F.avg("any_flaw"), 6).alias("share"))


def unvalidated_only(spark, sf_dir):
    """Items flagged by rules without validation alone, by prompt."""
    df = main_flags(spark, sf_dir).withColumn("only", ((F.col("any_flaw") == 1) & (detector.any_flaw(VALIDATED) == 0)).cast("int"))
    return _sums(df, ["condition"], "only")


def alphabetical_key_share(spark, sf_dir):
    """Q34: share of key A where options stand in alphabetical order and where they don't."""
    df = main_flags(spark, sf_dir)
    out = df.groupBy("condition", "options_not_alphabetical").agg(F.count("*").alias("n_items"), F.sum("key_a").alias("n_hit"))
    return st.with_wilson(out, "n_hit", "n_items")


RATIOS = [1.0, 1.1, 1.15, 1.2, 1.25, 1.33, 1.5, 1.75, 2.0]
MIN_WORDS = [1, 3, 4]


def longest_threshold_sweep(spark, sf_dir):
    """Q24: the longest-key rule over a grid of 9 ratios and 3 least lengths."""
    base = detector.prepared(items(spark, sf_dir).filter("condition in ('plain', 'guided') and reasoning_mode = 'off'"))
    facts = base.select(
        F.length("_key_text").alias("k"), F.array_max(F.transform("_others", F.length)).alias("d"), F.size(tx.words(F.col("_key_text"))).alias("w"))
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), F.lit(m).alias("min_words")) for r in RATIOS for m in MIN_WORDS])).alias("g")
    hit = ((F.col("k") > F.col("g.ratio") * F.col("d")) & (F.col("w") >= F.col("g.min_words"))).cast("int")
    return facts.select("*", grid).groupBy("g.ratio", "g.min_words").agg(F.count("*").alias("n_items"), F.sum(hit).alias("n_hit"))


CVS = [0.4, 0.5, 0.6, 0.7, 0.8]


def nonparallel_sweep(spark, sf_dir):
    """Q24: the parallelism rule over thresholds of the coefficient of variation."""
    base = detector.prepared(items(spark, sf_dir))
    out = None
    columns = {f"c{i}": detector.rule_columns(at=detector.Thresholds(nonparallel_cv=v))["nonparallel_options"].cast("int") for i, v in enumerate(CVS)}
    wide = base.select(*[c.alias(n) for n, c in columns.items()]).agg(F.count("*").alias("n_items"), *[F.sum(n).alias(n) for n in columns])
    out = wide.select("n_items", F.explode(F.array(*[F.struct(F.lit(v).alias("cv"), F.col(f"c{i}").alias("n_hit")) for i, v in enumerate(CVS)])).alias("s"))
    return out.select("s.cv", "n_items", "s.n_hit")


def leave_one_rule_out(spark, sf_dir):
    """Q24: the composite without each rule in turn, by prompt."""
    df = main_flags(spark, sf_dir)
    cases = F.explode(F.array(*[F.struct(F.lit(r).alias("without"), detector.any_flaw([x for x in RULES if x != r]).alias("hit")) for r in RULES])).alias("c")
    return df.select("condition", cases).groupBy("condition", "c.without").agg(F.count("*").alias("n_items"), F.sum("c.hit").alias("n_hit"), F.round(F.avg("c.hit"), 6).alias("share"))


def absolute_terms_audit(spark, sf_dir):
    """Q22/Q38: absolute words by word and place (key or distractor): options and items."""
    base = detector.prepared(items(spark, sf_dir)).select("job_id", "_key", F.explode(F.arrays_zip(F.col("_o"), F.col("_absolute"))).alias("z"))
    hits = base.select("job_id", (F.col("z._o.l") == F.col("_key")).alias("in_key"), F.explode(F.array_distinct("z._absolute")).alias("word"))
    return hits.groupBy("word", "in_key").agg(F.count("*").alias("n_options"), F.count_distinct("job_id").alias("n_items"))


def absolute_distractors_only(spark, sf_dir):
    """Q38: items whose absolute words stand in distractors alone, in the key alone, or in both."""
    base = detector.prepared(items(spark, sf_dir)).select("job_id", "_key", F.explode(F.arrays_zip(F.col("_o"), F.col("_absolute"))).alias("z"))
    per = base.filter(F.size("z._absolute") > 0).groupBy("job_id").agg(F.bool_or(F.col("z._o.l") == F.col("_key")).alias("key"), F.bool_or(F.col("z._o.l") != F.col("_key")).alias("other"))
    place = F.when(F.col("key") & F.col("other"), "both").when(F.col("key"), "key").otherwise("distractors")
    return per.groupBy(place.alias("place")).agg(F.count("*").alias("n_items"))


CELL = ["model_label", "specialty", "topic_index", "condition", "reasoning_mode"]


def _repeated(spark, sf_dir):
    """Cells with exactly two repetitions: the texts (stem and all options) of both side by side."""
    text = F.concat_ws(" ", "stem", F.transform("options", lambda o: o["t"]))
    df = items(spark, sf_dir).select(*CELL, "job_id", text.alias("text"))
    cells = df.groupBy(*CELL).agg(F.count("*").alias("n"), F.min_by("text", "job_id").alias("a"), F.max_by("text", "job_id").alias("b"))
    return cells.filter("n = 2")


def repetition_similarity(spark, sf_dir):
    """Q17: three-word similarity of the two repetitions of a cell (stem and options), with totals by model (rollup).

    The upper median comes from counts of equal similarities, so no list of a group is built.
    """
    pairs = _repeated(spark, sf_dir).select("model_label", "condition", tx.jaccard(tx.shingles(F.col("a")), tx.shingles(F.col("b"))).alias("j"))
    keys = ["level", "model_label", "condition"]
    none = F.lit(None).cast("string")
    levels = [(0, F.col("model_label"), F.col("condition")), (1, F.col("model_label"), none), (3, none, none)]
    prefixes = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("level"), m.alias("model_label"), c.alias("condition")) for v, m, c in levels]))
    counts = pairs.groupBy("model_label", "condition", "j").agg(F.count("*").alias("n"))
    values = counts.select(prefixes.alias("p"), "j", "n").select("p.*", "j", "n").groupBy(*keys, "j").agg(F.sum("n").alias("n"))
    whole = W.partitionBy(*keys)
    joined = values.withColumn("upto", F.sum("n").over(whole.orderBy("j"))).withColumn("n_pairs", F.sum("n").over(whole))
    return joined.groupBy(*keys).agg(
        F.max("n_pairs").alias("n_pairs"), F.sum(F.when(F.col("j") >= 0.5, F.col("n")).otherwise(0)).alias("n_half"),
        F.sum(F.when(F.col("j") >= 0.8, F.col("n")).otherwise(0)).alias("n_most"), F.round(F.max("j"), 6).alias("largest"),
        F.round(F.min(F.when(F.col("upto") > F.floor(F.col("n_pairs") / 2), F.col("j"))), 6).alias("upper_median"))


def rationale_letter(spark, sf_dir):
    """Q16: rationales that name option letters but not the key."""
    df = items(spark, sf_dir).withColumn("named", tx.letter_mentions(F.col("rationale")))
    return df.groupBy("model_label").agg(
        F.count("*").alias("n_items"), F.count_if(F.size("named") > 0).alias("n_named"),
        F.count_if((F.size("named") > 0) & ~F.array_contains("named", F.upper(F.trim("answer")))).alias("n_mismatch"))


def rationale_lexical(spark, sf_dir):
    """Q16: rationales of three content words or more whose best matching option isn't the key, by two words or more."""
    df = items(spark, sf_dir).withColumn("r", tx.rationale_words(F.col("rationale")))
    df = df.withColumn("m", F.transform("options", lambda o: F.struct(o["l"].alias("l"), F.size(F.array_intersect("r", tx.rationale_words(o["t"]))).alias("k"))))
    own = F.coalesce(F.get(F.transform(F.filter("m", lambda x: x["l"] == F.upper(F.trim("answer"))), lambda x: x["k"]), F.lit(0)), F.lit(0))
    best = F.array_max(F.transform("m", lambda x: x["k"]))
    return df.groupBy("condition").agg(F.count("*").alias("n_items"), F.count_if(F.size("r") >= 3).alias("n_read"), F.count_if((F.size("r") >= 3) & (best - own >= 2)).alias("n_mismatch"))


def leadin(spark, sf_dir):
    """Q18: stems that never ask anything, by model and prompt."""
    return items(spark, sf_dir).groupBy("model_label", "condition").agg(F.count("*").alias("n_items"), F.count_if(~tx.has_lead_in(F.col("stem"))).alias("n_missing"))


def stem_quintiles(spark, sf_dir):
    """Q22: share with a flaw by fifths of stem length, edges over all items, equal lengths together."""
    df = flags(spark, sf_dir).withColumn("any_flaw", detector.any_flaw(RULES))
    edges = df.select(F.percentile("stem_words", [0.2, 0.4, 0.6, 0.8]).alias("e"))
    joined = df.crossJoin(F.broadcast(edges))  # one row of four numbers
    bin_of = reduce(lambda a, i: a + (F.col("stem_words") > F.get("e", F.lit(i))).cast("int"), range(4), F.lit(1))
    return joined.groupBy(bin_of.alias("fifth")).agg(F.count("*").alias("n_items"), F.min("stem_words").alias("least"), F.max("stem_words").alias("most"), F.sum("any_flaw").alias("n_hit"))


def length_tertiles(spark, sf_dir):
    """Q24: share of longest keys by thirds of mean distractor length."""
    df = flags(spark, sf_dir)
    edges = df.select(F.percentile("mean_distractor_chars", [1 / 3, 2 / 3]).alias("e"))
    third = 1 + (F.col("mean_distractor_chars") > F.get("e", F.lit(0))).cast("int") + (F.col("mean_distractor_chars") > F.get("e", F.lit(1))).cast("int")
    return df.crossJoin(F.broadcast(edges)).groupBy(third.alias("third")).agg(F.count("*").alias("n_items"), F.sum("longest_option_key").alias("n_hit"))


def figure_key_shares(spark, sf_dir):
    """Q25: stacked key shares by model."""
    df = flags(spark, sf_dir).groupBy("model_label").pivot("key", list(LETTERS)).agg(F.count(F.lit(1)))
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(x), F.lit(0)) for x in LETTERS])
    return df.select("model_label", *[F.round(F.coalesce(F.col(x), F.lit(0)) / total, 6).alias(f"share_{x.lower()}") for x in LETTERS])


def crude_odds(spark, sf_dir):
    """Crude odds ratio of a flaw, guided against plain, for each model, with its Woolf interval."""
    g = F.col("guided") == 1
    hit = F.col("any_flaw") == 1
    df = main_flags(spark, sf_dir).groupBy("model_label").agg(*[
        F.count_if(x).cast("double").alias(n) for n, x in (("a", g & hit), ("b", g & ~hit), ("c", ~g & hit), ("d", ~g & ~hit))])
    value, low, high = st.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return df.select("model_label", F.round(value, 6).alias("odds_ratio"), F.round(low, 6).alias("lo"), F.round(high, 6).alias("hi"))


def spearman_lengths(spark, sf_dir):
    """Q19: rank correlation of stem length and mean distractor length, ties at their mean rank."""
    df = flags(spark, sf_dir).select("stem_words", "mean_distractor_chars")
    df = st.average_rank(st.average_rank(df, "stem_words", "ra"), "mean_distractor_chars", "rb")
    return df.agg(F.count("*").alias("n_items"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def tidy_aggregate(spark, sf_dir):
    """Q35: aggregates as rows of quantity, name and value."""
    df = main_flags(spark, sf_dir)
    flags_part = _unpivoted(df, ["job_id"], RULES).groupBy("flag").agg(F.sum("hit").alias("value")).select(F.lit("flaw_count").alias("quantity"), F.col("flag").alias("name"), "value")
    keys = df.groupBy("key").agg(F.count("*").alias("value")).select(F.lit("key_count").alias("quantity"), F.col("key").alias("name"), "value")
    total = df.agg(F.count("*").alias("value")).select(F.lit("n").alias("quantity"), F.lit("items").alias("name"), "value")
    return flags_part.unionByName(keys).unionByName(total)


QUERIES = {f.__name__: f for f in (
    flag_prevalence, flag_by_rule, mean_flaws_change, key_position_chi2, tier_condition_pivot, specialty_condition, unvalidated_only,
    alphabetical_key_share, longest_threshold_sweep, nonparallel_sweep, leave_one_rule_out, absolute_terms_audit, absolute_distractors_only,
    repetition_similarity, rationale_letter, rationale_lexical, leadin, stem_quintiles, length_tertiles, figure_key_shares, crude_odds,
    spearman_lengths, tidy_aggregate)}


def _f(sql: str) -> str:
    return f"WITH {FLAGS_SQL} {sql}"


def _unpivot_sql(names: list[str], keep: str) -> str:
    return " UNION ALL ".join(f"SELECT {keep}, '{n}' AS flag, {n} AS hit FROM main" for n in names)


_GRID = ", ".join(f"({r}, {m})" for r in RATIOS for m in MIN_WORDS)
_ABS = f"""a1 AS (SELECT job_id, i, (i = ascii(key) - 64) AS in_key, list_distinct(list_intersect(regexp_extract_all({{}}, '[a-z][a-z\\-'']+'), {list(detector.ABSOLUTE_TERMS)})) AS ws
  FROM full_flags, unnest(generate_series(1, 5)) AS g(i))"""


def _abs_sql() -> str:
    from stemwright.plans.items import _exempt

    return _ABS.format(_exempt("o[i]"))


_SH = lambda x: f"list_distinct(list_transform(range(1, greatest(len({x}) - 1, 1)), lambda i: array_to_string({x}[i:i + 2], ' ')))"
_RSTOP = ", ".join(f"'{w}'" for w in tx.RATIONALE_STOP_WORDS)
_RW = lambda x: rf"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z][a-z\-'']{{3,}}'), lambda v: v NOT IN ({_RSTOP})))"
_CHI = "(pow(key_a - n / 5, 2) + pow(key_b - n / 5, 2) + pow(key_c - n / 5, 2) + pow(key_d - n / 5, 2) + pow(key_e - n / 5, 2)) / (n / 5)"

ORACLE = {
    "flag_prevalence": _f(f"""SELECT model_label, condition, n_items, n_hit, mean_flaws, {_wilson_sql('n_hit', 'n_items')} FROM (
SELECT model_label, condition, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit, round(avg(n_flaws), 6) AS mean_flaws FROM main GROUP BY ALL)"""),
    "flag_by_rule": _f(f""", u AS ({_unpivot_sql(FLAGS, 'condition')}) SELECT flag, condition, n_items, n_hit, {_wilson_sql('n_hit', 'n_items')} FROM (
SELECT flag, condition, count(*)::BIGINT AS n_items, sum(hit)::BIGINT AS n_hit FROM u GROUP BY ALL)"""),
    "mean_flaws_change": _f("""SELECT model_label, round(avg(n_flaws) FILTER (WHERE guided = 0), 6) AS plain, round(avg(n_flaws) FILTER (WHERE guided = 1), 6) AS guided,
round(avg(n_flaws) FILTER (WHERE guided = 1) - avg(n_flaws) FILTER (WHERE guided = 0), 6) AS change FROM main GROUP BY model_label"""),
    "key_position_chi2": _f(f""", k AS (SELECT model_label, condition, {', '.join(f"count(*) FILTER (WHERE key = '{x}') AS key_{x.lower()}" for x in LETTERS)}, count(*)::DOUBLE AS n FROM main GROUP BY model_label, condition),
c AS (SELECT *, {_CHI} AS chi2 FROM k), p AS (SELECT *, exp(-chi2 / 2) * (1 + chi2 / 2) AS p FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY p, model_label) AS rk, count(*) OVER (PARTITION BY condition) AS m FROM p),
q AS (SELECT *, least(1, min(p * m / rk) OVER (PARTITION BY condition ORDER BY rk DESC)) AS q FROM r)
SELECT model_label, condition, {', '.join(f'key_{x.lower()}' for x in LETTERS)}, round(chi2, 6) AS chi2, round(p, 9) AS p, round(q, 9) AS q FROM q"""),
    "tier_condition_pivot": _f("""SELECT tier, round(avg(any_flaw) FILTER (WHERE guided = 0), 6) AS plain, round(avg(any_flaw) FILTER (WHERE guided = 1), 6) AS guided,
count(*)::BIGINT AS n_items, round(avg(any_flaw), 6) AS "both" FROM main GROUP BY tier"""),
    "specialty_condition": _f("""SELECT specialty, condition, grouping_id(specialty, condition)::BIGINT AS level, count(*)::BIGINT AS n_items, sum(any_flaw)::BIGINT AS n_hit,
round(avg(any_flaw), 6) AS share FROM main GROUP BY ROLLUP (specialty, condition)"""),
    "unvalidated_only": _f(f"""SELECT condition, count(*)::BIGINT AS n_items, sum((any_flaw = 1 AND greatest({', '.join(VALIDATED)}) = 0)::INT)::BIGINT AS n_hit FROM main GROUP BY condition"""),
    "alphabetical_key_share": _f(f"""SELECT condition, options_not_alphabetical, n_items, n_hit, {_wilson_sql('n_hit', 'n_items')} FROM (
SELECT condition, options_not_alphabetical, count(*)::BIGINT AS n_items, sum(key_a)::BIGINT AS n_hit FROM main GROUP BY ALL)"""),
    "longest_threshold_sweep": _f(f"""SELECT ratio::DOUBLE AS ratio, min_words, count(*)::BIGINT AS n_items,
sum((len(kt) > ratio * list_max(list_transform(oth, lambda x: len(x))) AND len(list_filter(string_split(kt, ' '), lambda q: q <> '')) >= min_words)::INT)::BIGINT AS n_hit
FROM main, (VALUES {_GRID}) AS g(ratio, min_words) GROUP BY ratio, min_words"""),
    "leave_one_rule_out": _f(", u AS (" + " UNION ALL ".join(
        f"SELECT condition, '{r}' AS without, greatest({', '.join(x for x in RULES if x != r)}) AS hit FROM main" for r in RULES)
        + ") SELECT condition, without, count(*)::BIGINT AS n_items, sum(hit)::BIGINT AS n_hit, round(avg(hit), 6) AS share FROM u GROUP BY ALL"),
    "absolute_terms_audit": _f(f", {_abs_sql()}, a2 AS (SELECT job_id, in_key, unnest(ws) AS word FROM a1) SELECT word, in_key, count(*)::BIGINT AS n_options, count(DISTINCT job_id)::BIGINT AS n_items FROM a2 GROUP BY word, in_key"),
    "absolute_distractors_only": _f(f""", {_abs_sql()}, a2 AS (SELECT job_id, bool_or(in_key) AS k, bool_or(NOT in_key) AS d FROM a1 WHERE len(ws) > 0 GROUP BY job_id)
SELECT CASE WHEN k AND d THEN 'both' WHEN k THEN 'key' ELSE 'distractors' END AS place, count(*)::BIGINT AS n_items FROM a2 GROUP BY ALL"""),
    "repetition_similarity": f"""WITH {FLAGS_SQL.split('d1 AS (')[0].rstrip().rstrip(',')},
t AS (SELECT {', '.join(CELL)}, job_id, concat_ws(' ', stem, option_a, option_b, option_c, option_d, option_e) AS text FROM items),
c AS (SELECT {', '.join(CELL)}, count(*) AS n, arg_min(text, job_id) AS a, arg_max(text, job_id) AS b FROM t GROUP BY ALL HAVING count(*) = 2),
w AS (SELECT *, regexp_extract_all(lower(a), '[a-z0-9]+') AS wa, regexp_extract_all(lower(b), '[a-z0-9]+') AS wb FROM c),
s AS (SELECT *, {_SH('wa')} AS sa, {_SH('wb')} AS sb FROM w),
j AS (SELECT *, len(list_intersect(sa, sb))::DOUBLE / (len(sa) + len(sb) - len(list_intersect(sa, sb))) AS j FROM s)
SELECT model_label, condition, grouping_id(model_label, condition)::BIGINT AS level, count(*)::BIGINT AS n_pairs, count(*) FILTER (WHERE j >= 0.5)::BIGINT AS n_half,
count(*) FILTER (WHERE j >= 0.8)::BIGINT AS n_most, round(max(j), 6) AS largest, round(list_sort(list(j))[count(*) // 2 + 1], 6) AS upper_median FROM j GROUP BY ROLLUP (model_label, condition)""",
    "rationale_letter": _f(r""", n AS (SELECT model_label, key, list_distinct(list_transform(list_concat(
regexp_extract_all(coalesce(rationale, ''), '(?i)\b(?:option|choice|answer(?: is)?|alternative)\s*[:(]?\s*([A-E])\b', 1), regexp_extract_all(coalesce(rationale, ''), '(?i)\(([A-E])\)', 1)), lambda x: upper(x))) AS nm FROM full_flags)
SELECT model_label, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE len(nm) > 0)::BIGINT AS n_named, count(*) FILTER (WHERE len(nm) > 0 AND NOT list_contains(nm, key))::BIGINT AS n_mismatch FROM n GROUP BY model_label"""),
    "rationale_lexical": f"""WITH {FLAGS_SQL.split('d1 AS (')[0].rstrip().rstrip(',')},
r AS (SELECT condition, upper(trim(answer)) AS key, {_RW('rationale')} AS r, [{_RW('option_a')}, {_RW('option_b')}, {_RW('option_c')}, {_RW('option_d')}, {_RW('option_e')}] AS o FROM items),
m AS (SELECT condition, r, list_transform(o, lambda w: len(list_intersect(r, w))) AS k, ascii(key) - 64 AS i FROM r)
SELECT condition, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE len(r) >= 3)::BIGINT AS n_read, count(*) FILTER (WHERE len(r) >= 3 AND list_max(k) - k[i] >= 2)::BIGINT AS n_mismatch FROM m GROUP BY condition""",
    "leadin": f"""WITH {FLAGS_SQL.split('d1 AS (')[0].rstrip().rstrip(',')}, s AS (SELECT model_label, condition, trim(regexp_replace(coalesce(stem, ''), '\\s+', ' ', 'g')) AS s FROM items)
SELECT model_label, condition, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE NOT (contains(s, '?') OR s LIKE '%:' OR NOT regexp_matches(s, '[.!?:]$')
  OR regexp_matches(s, '(?i)(?:^|[.?!:]\\s+)({"|".join(tx.ASKING)})\\b')))::BIGINT AS n_missing FROM s GROUP BY ALL""",
    "stem_quintiles": _f(""", e AS (SELECT quantile_cont(stem_words, [0.2, 0.4, 0.6, 0.8]) AS e FROM full_flags)
SELECT (1 + (stem_words > e[1])::INT + (stem_words > e[2])::INT + (stem_words > e[3])::INT + (stem_words > e[4])::INT) AS fifth, count(*)::BIGINT AS n_items,
min(stem_words) AS least, max(stem_words) AS most, sum(any_flaw)::BIGINT AS n_hit FROM full_flags, e GROUP BY fifth"""),
    "length_tertiles": _f(""", e AS (SELECT quantile_cont(mean_distractor_chars, [1.0 / 3, 2.0 / 3]) AS e FROM full_flags)
SELECT (1 + (mean_distractor_chars > e[1])::INT + (mean_distractor_chars > e[2])::INT) AS third, count(*)::BIGINT AS n_items, sum(longest_option_key)::BIGINT AS n_hit FROM full_flags, e GROUP BY third"""),
    "figure_key_shares": _f("SELECT model_label, " + ", ".join(f"round(count(*) FILTER (WHERE key = '{x}') / count(*), 6) AS share_{x.lower()}" for x in LETTERS) + " FROM full_flags GROUP BY model_label"),
    "crude_odds": _f(""", c AS (SELECT model_label, count(*) FILTER (WHERE guided = 1 AND any_flaw = 1)::DOUBLE AS a, count(*) FILTER (WHERE guided = 1 AND any_flaw = 0)::DOUBLE AS b,
count(*) FILTER (WHERE guided = 0 AND any_flaw = 1)::DOUBLE AS c, count(*) FILTER (WHERE guided = 0 AND any_flaw = 0)::DOUBLE AS d FROM main GROUP BY model_label),
r AS (SELECT model_label, CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN a * d / (b * c) END AS v, 1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS h FROM c)
SELECT model_label, round(v, 6) AS odds_ratio, round(exp(ln(v) - h), 6) AS lo, round(exp(ln(v) + h), 6) AS hi FROM r"""),
    "spearman_lengths": _f(""", r AS (SELECT rank() OVER (ORDER BY stem_words) + (count(*) OVER (PARTITION BY stem_words) - 1) / 2 AS ra,
rank() OVER (ORDER BY mean_distractor_chars) + (count(*) OVER (PARTITION BY mean_distractor_chars) - 1) / 2 AS rb FROM full_flags)
SELECT count(*)::BIGINT AS n_items, round(corr(ra, rb), 6) AS rho FROM r"""),
    "tidy_aggregate": _f(f""", u AS ({_unpivot_sql(RULES, 'job_id')}) SELECT 'flaw_count' AS quantity, flag AS name, sum(hit)::BIGINT AS value FROM u GROUP BY flag
UNION ALL SELECT 'key_count', key, count(*)::BIGINT FROM main GROUP BY key UNION ALL SELECT 'n', 'items', count(*)::BIGINT FROM main"""),
    "nonparallel_sweep": _f("SELECT cv::DOUBLE AS cv, count(*)::BIGINT AS n_items, sum((nn >= 2 AND nn < len(o) OR ns BETWEEN 1 AND len(o) - 1 OR (mw >= 3 AND sd / mw > cv))::INT)::BIGINT AS n_hit FROM d6, (VALUES "
                            + ", ".join(f"({v})" for v in CVS) + ") AS g(cv) GROUP BY cv"),
}
# A statement that goes on after the common part begins with a comma.
ORACLE = {k: v.replace(" ,", ",", 1) if " ," in v else v for k, v in ORACLE.items()}
