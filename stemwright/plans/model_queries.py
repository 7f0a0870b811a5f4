"""Queries that fit models or pool estimates; closed forms serve as SQL where a model is saturated."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stemwright.operators import detector, exact, fit
from stemwright.operators.detector import CUEING, RULES
from stemwright.plans.items import FLAGS_SQL, main_flags
from stemwright.plans.flag_queries import reference_flags
from stemwright.session import table

_LOGIT = "term string, coef double, se double, z double, p double, odds_ratio double, lo double, hi double"
_OLS = "term string, coef double, se double, t double, p double, lo double, hi double"


def _frame(spark, rows: list[dict], schema: str):
    names = [f.split()[0] for f in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def logit_guided(spark, sf_dir):
    """Q5: effect of the guided prompt on any flaw, alone; the model is saturated, so the odds ratio is the crude one."""
    rows = fit.logit_cluster(main_flags(spark, sf_dir), "any_flaw", ["guided"], {}, "topic")
    return _frame(spark, rows, _LOGIT).select("term", F.round("coef", 5).alias("coef"), F.round("odds_ratio", 5).alias("odds_ratio"))


def logit_guided_errors(spark, sf_dir):
    """The same fit with its cluster-robust errors."""
    return _frame(spark, fit.logit_cluster(main_flags(spark, sf_dir), "any_flaw", ["guided"], {}, "topic"), _LOGIT)


def logit_adjusted(spark, sf_dir):
    """Q5: guided prompt and tier with their product, adjusted for specialty, clusters = topics."""
    df = main_flags(spark, sf_dir).withColumn("guided_flagship", F.col("guided") * F.col("flagship"))
    return _frame(spark, fit.logit_cluster(df, "any_flaw", ["guided", "flagship", "guided_flagship"], {"specialty": "surgery"}, "topic"), _LOGIT)


def _woolf(df):
    g, h = F.col("guided") == 1, F.col("any_flaw") == 1
    t = df.groupBy("model_label").agg(*[F.count_if(x).cast("double").alias(n) for n, x in (("a", g & h), ("b", g & ~h), ("c", ~g & h), ("d", ~g & ~h))])
    return t.filter("a > 0 and b > 0 and c > 0 and d > 0").select(
        "model_label", F.log(F.col("a") * F.col("d") / (F.col("b") * F.col("c"))).alias("y"), (1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")).alias("v"))


_ADJUSTED = "model_label string, status string, coef double, se double, odds_ratio double, lo double, hi double"


def _adjusted_odds(df) -> list[tuple]:
    """Of each model, the guided prompt's effect adjusted for specialty, clusters = topics; a model without an estimate says why.

    Each model is fitted in a task of its own on its counts by specialty, topic and prompt, in one job; the estimator is logit_fit()'s.
    """
    used = df.select("model_label", "specialty", "topic", "guided", "any_flaw").dropna()
    first = used.agg(F.min("specialty")).first()[0]

    def one(key, t):
        n, k, g = (t[c].to_numpy(dtype=float) for c in ("n", "k", "guided"))

        def row(status, *values):
            return pd.DataFrame([(key[0], status, *(values or [None] * 5))], columns=[f.split()[0] for f in _ADJUSTED.split(", ")])

        if len(np.unique(g)) < 2:
            return row("one prompt only")
        if any(not 0 < k[g == v].sum() < n[g == v].sum() for v in (0, 1)):
            return row("a prompt with no flaw or flaws only")
        levels = [v for v in sorted(t["specialty"].unique()) if v != first]
        x = np.column_stack([np.ones(len(t)), g, *[(t["specialty"] == v).to_numpy(dtype=float) for v in levels]])
        p, beta = x.shape[1], np.zeros(x.shape[1])
        for _ in range(100):
            mu = 1 / (1 + np.exp(-x @ beta))
            step = np.linalg.solve(x.T @ (x * (n * mu * (1 - mu))[:, None]) + 1e-8 * np.eye(p), x.T @ (k - n * mu))
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                break
        mu = 1 / (1 + np.exp(-x @ beta))
        bread = np.linalg.inv(x.T @ (x * (n * mu * (1 - mu))[:, None]) + 1e-8 * np.eye(p))
        u = pd.DataFrame(x * (k - n * mu)[:, None]).groupby(t["topic"].to_numpy()).sum().to_numpy()
        c, total = len(u), n.sum()
        v = (c / (c - 1) * (total - 1) / (total - p) * (bread @ u.T @ u @ bread))[1, 1] if c > 1 and total > p else math.nan
        if not (math.isfinite(beta[1]) and v > 0):
            return row("no standard error")
        e = math.sqrt(v)
        return row("estimated", beta[1], e, *(math.exp(beta[1] + z * e) for z in (0, -1.96, 1.96)))

    counts = used.groupBy("model_label", "specialty", "topic", "guided").agg(F.count("*").alias("n"), F.sum("any_flaw").alias("k"))
    return [tuple(r) for r in counts.groupBy("model_label").applyInPandas(one, _ADJUSTED).orderBy("model_label").collect()]  # one row for each model


def model_odds(spark, sf_dir):
    """Q7: each model's odds ratio of the guided prompt, specialty-adjusted with topic clusters; those that can't be estimated have a status."""
    return spark.createDataFrame(_adjusted_odds(main_flags(spark, sf_dir)), _ADJUSTED)


def pooled_adjusted_odds(spark, sf_dir):
    """Q7: random-effects pooling of model_odds, with the models left out for want of an estimate and the prediction interval."""
    rows = _adjusted_odds(main_flags(spark, sf_dir))
    used = [r for r in rows if r[1] == "estimated"]
    keys = ("mean", "se", "tau2", "i2", "q", "prediction_lo", "prediction_hi")
    out = exact.pooled_random_effects([r[2] for r in used], [r[3] for r in used]) if used else {k: None for k in keys}
    return spark.createDataFrame(
        [(len(used), [r[0] for r in rows if r[1] != "estimated"], *[out[k] for k in keys])],
        "n_models int, not_estimated array<string>, " + ", ".join(f"{k} double" for k in keys),
    )


def pooled_odds(spark, sf_dir):
    """Random-effects pooling of the models' crude (Woolf) log odds ratios, models with an empty cell left out; Q7 itself is pooled_adjusted_odds."""
    rows = _woolf(main_flags(spark, sf_dir)).collect()
    out = exact.pooled_random_effects([r.y for r in rows], [math.sqrt(r.v) for r in rows])
    return spark.createDataFrame([(len(rows), *[round(out[k], 6) for k in ("mean", "se", "tau2", "i2", "q")])], "n_models int, mean double, se double, tau2 double, i2 double, q double")


def model_contrasts(spark, sf_dir):
    """Q6: each model's effect on any flaw against the mean of all models (deviation coding), by prompt."""
    df = main_flags(spark, sf_dir)
    out = []
    levels = sorted(r[0] for r in df.select("model_label").distinct().collect())
    for condition in ("plain", "guided"):
        _, beta, cov = fit.logit_fit(df.filter(F.col("condition") == condition), "any_flaw", [], {"model_label": levels[0]}, "topic")
        out += [{"condition": condition, **c} for c in fit.deviation_contrasts(beta[1:], cov[1:, 1:], levels)]
    return _frame(spark, out, "condition string, level string, effect double, se double")


def _model_rates(spark, sf_dir):
    return main_flags(spark, sf_dir).filter("condition = 'plain'").groupBy("model_label").agg(F.min("tier").alias("tier"), F.avg("any_flaw").alias("rate"))


def tier_permutation(spark, sf_dir):
    """Q8: exact permutation test of the models' rates by tier (one rate for each model)."""
    rows = _model_rates(spark, sf_dir).orderBy("model_label").collect()
    seen, p, n = exact.permutation_p([r.rate for r in rows], [r.tier == "flagship" for r in rows])
    return spark.createDataFrame([(round(seen, 6), round(p, 6), n)], "difference double, p double, n_splits int")


def tier_welch(spark, sf_dir):
    """Q8: Welch's t of the models' rates by tier."""
    rows = _model_rates(spark, sf_dir).collect()
    t, df, p = exact.welch([r.rate for r in rows if r.tier == "flagship"], [r.rate for r in rows if r.tier != "flagship"])
    return spark.createDataFrame([(round(t, 5), round(df, 5))], "t double, df double")


def tier_intervals(spark, sf_dir):
    """Q7/ST12: mean rate of the models of each tier with its t interval."""
    by: dict[str, list[float]] = {}
    for r in _model_rates(spark, sf_dir).orderBy("model_label").collect():  # one row for each model
        by.setdefault(r.tier, []).append(r.rate)
    return spark.createDataFrame([(t, len(v), *[round(x, 6) for x in exact.t_interval(v)]) for t, v in sorted(by.items())], "tier string, n_models int, mean double, lo double, hi double")


def topic_bootstrap(spark, sf_dir):
    """Q7/ST24: interval of the share with a flaw by resampling topics, given as sums and sizes."""
    rows = main_flags(spark, sf_dir).groupBy("topic").agg(F.sum("any_flaw").alias("s"), F.count("*").alias("n")).orderBy("topic").collect()
    low, high = exact.cluster_bootstrap(np.array([float(r.s) for r in rows]), np.array([float(r.n) for r in rows]))
    return spark.createDataFrame([(len(rows), low, high)], "n_topics int, lo double, hi double")


def _psychometrics(spark, sf_dir):
    measured = table(spark, sf_dir, "reference_items").select("itemnum", "difficulty", F.log(F.greatest("response_time", F.lit(1.0))).alias("log_time"))
    return reference_flags(spark, sf_dir).join(measured, "itemnum").withColumns(
        {
            "cueing": detector.any_flaw(CUEING), "n_cueing": sum((F.col(c) for c in CUEING), F.lit(0)),
            "log_stem_words": F.log(F.greatest(F.col("stem_words").cast("double"), F.lit(1.0))),
        }
    )


def psychometrics_ols(spark, sf_dir):
    """Q23: difficulty and log response time of reference items on the number of cueing flaws and on each flag with enough cases,
    adjusted for log stem words, item type and exam; HC1 errors, q by outcome."""
    return _psychometrics_ols(spark, _psychometrics(spark, sf_dir))


def _psychometrics_ols(spark, df):
    counts = df.agg(
        *[F.sum(r).alias(r) for r in [*RULES, "cueing"]], F.count("*").alias("n"), F.count_distinct("n_cueing").alias("n_cueing"),
        F.min("itemtype").alias("itemtype"), F.min("exam").alias("exam"),
    ).first()
    out = []
    for outcome in ("difficulty", "log_time"):
        for flag in ["n_cueing", *RULES, "cueing"]:
            k = counts[flag] or 0
            if counts["n_cueing"] > 1 if flag == "n_cueing" else 5 <= k <= counts["n"] - 5:
                rows, _ = fit.ols_robust(df, outcome, [flag, "log_stem_words"], {c: counts[c] for c in ("itemtype", "exam")})
                out += [{"outcome": outcome, **r} for r in rows if r["term"] == flag]
    from stemwright.functions.stats import bh_adjusted

    return bh_adjusted(_frame(spark, out, "outcome string, " + _OLS), "p", ["outcome"], ["term"])


def psychometrics_difference(spark, sf_dir):
    """Q23: difference of mean difficulty, flagged against clean, from the regression on the composite."""
    df = _psychometrics(spark, sf_dir).withColumn("flagged", detector.any_flaw(RULES))
    rows, r2 = fit.ols_robust(df, "difficulty", ["flagged"], {})
    return spark.createDataFrame([(r["term"], round(r["coef"], 6)) for r in rows], "term string, coef double")


def source_comparison(spark, sf_dir):
    """Q22: prevalence of each composite among generated and reference items."""
    made = main_flags(spark, sf_dir).filter("condition = 'plain'").select(F.lit("generated").alias("source"), *RULES)
    ref = reference_flags(spark, sf_dir).select(F.lit("reference").alias("source"), *RULES)
    cases = F.explode(F.array(*[F.struct(F.lit(n).alias("composite"), detector.any_flaw(r).alias("hit")) for n, r in detector.COMPOSITES.items()])).alias("c")
    return made.unionByName(ref).select("source", cases).groupBy("source", "c.composite").agg(F.count("*").alias("n_items"), F.sum("c.hit").alias("n_hit"))


def source_logit(spark, sf_dir):
    """Q22/ST39: generated against reference items adjusted for stem length; generated items cluster by model."""
    made = main_flags(spark, sf_dir).filter("condition = 'plain'").select(F.col("model_label").alias("cluster"), F.lit(1).alias("generated"), "stem_words", "any_flaw")
    ref = reference_flags(spark, sf_dir).select(F.concat(F.lit("ref_"), "itemnum").alias("cluster"), F.lit(0).alias("generated"), "stem_words", detector.any_flaw(RULES).alias("any_flaw"))
    return _frame(spark, fit.logit_cluster(made.unionByName(ref), "any_flaw", ["generated", "stem_words"], {}, "cluster"), _LOGIT)


def dose_response(spark, sf_dir):
    """ST36: difficulty on the number of flaws as categories, the top one open."""
    df = _psychometrics(spark, sf_dir).withColumns({"flaws_1": (F.col("n_flaws") == 1).cast("int"), "flaws_2_up": (F.col("n_flaws") >= 2).cast("int")})
    rows, r2 = fit.ols_robust(df, "difficulty", ["flaws_1", "flaws_2_up"], {}) if df.filter("flaws_2_up = 1").count() >= 5 else fit.ols_robust(df, "difficulty", ["flaws_1"], {})
    return _frame(spark, rows, _OLS)


QUERIES = {f.__name__: f for f in (
    logit_guided, logit_guided_errors, logit_adjusted, model_odds, pooled_adjusted_odds, pooled_odds, model_contrasts, tier_permutation, tier_welch, tier_intervals, topic_bootstrap,
    psychometrics_ols, psychometrics_difference, source_comparison, source_logit, dose_response)}

_ABCD = """count(*) FILTER (WHERE guided = 1 AND any_flaw = 1)::DOUBLE AS a, count(*) FILTER (WHERE guided = 1 AND any_flaw = 0)::DOUBLE AS b,
count(*) FILTER (WHERE guided = 0 AND any_flaw = 1)::DOUBLE AS c, count(*) FILTER (WHERE guided = 0 AND any_flaw = 0)::DOUBLE AS d"""
ORACLE = {
    "logit_guided": f"""WITH {FLAGS_SQL}, t AS (SELECT {_ABCD} FROM main)
SELECT 'intercept' AS term, round(ln(c / d), 5) AS coef, round(c / d, 5) AS odds_ratio FROM t UNION ALL SELECT 'guided', round(ln(a * d / (b * c)), 5), round(a * d / (b * c), 5) FROM t""",
    "pooled_odds": f"""WITH {FLAGS_SQL}, t AS (SELECT model_label, {_ABCD} FROM main GROUP BY model_label),
y AS (SELECT ln(a * d / (b * c)) AS y, 1 / a + 1 / b + 1 / c + 1 / d AS v FROM t WHERE a > 0 AND b > 0 AND c > 0 AND d > 0),
f AS (SELECT sum(y / v) / sum(1 / v) AS m, sum(1 / v) AS w, sum(1 / (v * v)) AS w2, count(*) AS k FROM y),
q AS (SELECT sum(pow(y - m, 2) / v) AS q, any_value(w) AS w, any_value(w2) AS w2, any_value(k) AS k FROM y, f),
r AS (SELECT *, greatest(0, (q - (k - 1)) / (w - w2 / w)) AS tau2 FROM q),
s AS (SELECT sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mean, sqrt(1 / sum(1 / (v + tau2))) AS se FROM y, r)
SELECT k::INT AS n_models, round(mean, 6) AS mean, round(se, 6) AS se, round(tau2, 6) AS tau2, round(greatest(0, (q - (k - 1)) / q), 6) AS i2, round(q, 6) AS q FROM s, r""",
    "tier_welch": f"""WITH {FLAGS_SQL}, r AS (SELECT model_label, min(tier) AS tier, avg(any_flaw) AS rate FROM main WHERE condition = 'plain' GROUP BY model_label),
s AS (SELECT (tier = 'flagship') AS f, avg(rate) AS m, var_samp(rate) / count(*) AS v, count(*) AS n FROM r GROUP BY 1)
SELECT round((x.m - y.m) / sqrt(x.v + y.v), 5) AS t, round(pow(x.v + y.v, 2) / (pow(x.v, 2) / (x.n - 1) + pow(y.v, 2) / (y.n - 1)), 5) AS df FROM s x, s y WHERE x.f AND NOT y.f""",
    "tier_intervals": f"""WITH {FLAGS_SQL}, r AS (SELECT model_label, min(tier) AS tier, avg(any_flaw) AS rate FROM main WHERE condition = 'plain' GROUP BY model_label),
s AS (SELECT tier, count(*) AS n, avg(rate) AS m, {exact.T_975}[(count(*) - 1)::INT] * stddev_samp(rate) / sqrt(count(*)) AS h FROM r GROUP BY tier)
SELECT tier, n::INT AS n_models, round(m, 6) AS mean, round(m - h, 6) AS lo, round(m + h, 6) AS hi FROM s""",
}
