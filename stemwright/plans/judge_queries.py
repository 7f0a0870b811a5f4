"""Judges and detector against human labels. The tables hold no judge log, so raters stand for judges:
R1 is the judge (reasoning off), R2 the same judge's second setting (on), the others of the panel give the labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from stemwright.functions import stats as st
from stemwright.operators import dedup, exact
from stemwright.plans.items import FLAGS_SQL, flags
from stemwright.plans.rating_queries import READER_RULES, _reader_cells, _rows
from stemwright.session import table

CONTENT = {"single_best_answer": "coalesce(q1, '') <> 'yes'", "plausible_distractors": "coalesce(q2, '') = 'no'", "accurate_content": "coalesce(q3, '') = 'no'", "acceptable": "coalesce(q5, '') = 'no'"}
COMPOSITE = "coalesce(q1, '') IN ('no', 'unsure') OR coalesce(q2, '') = 'no' OR coalesce(q3, '') = 'no' OR coalesce(q5, '') = 'no'"
VERDICTS = CONTENT | {"composite": COMPOSITE}


def _verdicts(spark, sf_dir):
    """The last submission of each rater for each item (P4) as 0/1 verdicts, rows (item_id, rater, rule, failed)."""
    rows = _rows(spark, sf_dir).filter("item_id is not null and rater is not null")
    answers = F.struct("submitted_utc", "row_id", *[F.lower(F.trim(q)).alias(q) for q in ("q1", "q2", "q3", "q5")])
    last = rows.groupBy("item_id", "rater").agg(F.max(answers).alias("a")).select("item_id", "rater", "a.*")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.expr(e).cast("int").alias("failed")) for n, e in VERDICTS.items()]))
    return last.select("item_id", "rater", each.alias("v")).select("item_id", "rater", "v.rule", "v.failed")


def _table(df, keys: list[str], pred: str = "pred", gold: str = "gold"):
    """2x2 counts of two 0/1 columns with precision, recall, F1 and kappa."""
    cell = lambda i, j: F.count_if((F.col(pred) == i) & (F.col(gold) == j))
    out = df.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    four = [F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn")]
    pr = st.precision_recall(*four, undefined=0.0)
    return out.select(*keys, "tp", "fp", "fn", "tn", F.round(pr["precision"], 6).alias("precision"), F.round(pr["recall"], 6).alias("recall"), F.round(st.kappa(*four), 6).alias("kappa"))


def _labels(spark, sf_dir):
    """Labels of the panel without R1 and R2, collapsed where all agree (P6); rows (item_id, rule, gold)."""
    panel = _verdicts(spark, sf_dir).filter("rater not in ('R1', 'R2')")
    return dedup.agreed_only(panel.withColumnRenamed("failed", "gold"), ["item_id", "rule"], "rater", "gold").select("item_id", "rule", "gold")


def detector_labels(spark, sf_dir):
    """Q26: the detector against the readers' labels, each rule; two labels of an item collapse if they agree, else they are dropped (P6)."""
    cells = _reader_cells(spark, sf_dir)
    votes = cells.select("item_id", "rule", F.explode(F.array("a", "b")).alias("label")).filter("label in ('yes', 'no')")
    agreed = votes.groupBy("item_id", "rule").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    jobs = table(spark, sf_dir, "reader_check").select("item_id", F.lower(F.trim("job_id")).alias("job_id"))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("pred")) for r in READER_RULES])).alias("p")
    seen = flags(spark, sf_dir).select("job_id", each).select("job_id", "p.*")
    both = agreed.join(jobs, "item_id").join(seen, ["job_id", "rule"])
    return _table(both.withColumn("gold", (F.col("label") == "yes").cast("int")), ["rule"])


def label_rows_kept(spark, sf_dir):
    """P7: label rows as they stand, repeated items kept, beside what collapsing leaves and drops."""
    votes = _reader_cells(spark, sf_dir).select("item_id", "rule", F.explode(F.array("a", "b")).alias("label")).filter("label in ('yes', 'no')")
    per = votes.groupBy("rule", "item_id").agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"))
    return per.groupBy("rule").agg(F.sum("n").alias("n_rows"), F.count_if(F.expr("k = 1")).alias("n_kept"), F.count_if(F.expr("n > 1")).alias("n_repeated"), F.count_if(F.expr("k > 1")).alias("n_conflicting"))


def judge_labels(spark, sf_dir):
    """Q27: the judge against the collapsed labels of the panel (JN7), by rule."""
    judge = _verdicts(spark, sf_dir).filter("rater = 'R1'").select("item_id", "rule", F.col("failed").alias("pred"))
    return _table(judge.join(_labels(spark, sf_dir), ["item_id", "rule"]), ["rule"])


def judge_raters(spark, sf_dir):
    """Q28: the judge against each rater, and against all and any of them, by rule."""
    v = _verdicts(spark, sf_dir)
    others = v.filter("rater <> 'R1'")
    joint = others.groupBy("item_id", "rule").agg(F.min("failed").alias("all raters"), F.max("failed").alias("any rater"))
    refs = others.select("item_id", "rule", F.col("rater").alias("reference"), F.col("failed").alias("gold")).unionByName(
        joint.select("item_id", "rule", F.inline(F.array(*[F.struct(F.lit(n).alias("reference"), F.col(n).alias("gold")) for n in ("all raters", "any rater")]))))
    judge = v.filter("rater = 'R1'").select("item_id", "rule", F.col("failed").alias("pred"))
    return _table(judge.join(refs, ["item_id", "rule"]), ["reference", "rule"])


def judge_prevalence(spark, sf_dir):
    """Q29: share of items the judge fails, by model, prompt and rule, and by any content rule."""
    v = _verdicts(spark, sf_dir).filter("rater = 'R1' and rule <> 'composite'")
    each = v.unionByName(v.groupBy("item_id", "rater").agg(F.max("failed").alias("failed")).withColumn("rule", F.lit("any")))
    key = table(spark, sf_dir, "main_key").select("item_id", "model", "condition")
    out = each.join(key, "item_id").groupBy("model", "condition", "rule").agg(F.count("*").alias("n_items"), F.sum("failed").alias("n_hit"))
    return st.with_wilson(out, "n_hit", "n_items")


def judge_settings(spark, sf_dir):
    """Q30: the two settings of the judge on items with all verdicts in both (JN8): agreement, changes, and McNemar against the labels."""
    v = _verdicts(spark, sf_dir)
    side = lambda r, n: v.filter(F.col("rater") == r).select("item_id", "rule", F.col("failed").alias(n))
    both = side("R1", "off").join(side("R2", "on"), ["item_id", "rule"]).join(_labels(spark, sf_dir), ["item_id", "rule"], "left")
    c = lambda x: F.count_if(F.expr(x))
    counts = both.groupBy("rule").agg(
        F.count("*").alias("n_items"), c("`off` = `on`").alias("n_same"), c("`off` = 0 and `on` = 1").alias("pass_fail"), c("`off` = 1 and `on` = 0").alias("fail_pass"),
        c("`off` = gold and `on` <> gold").alias("only_off"), c("`on` = gold and `off` <> gold").alias("only_on"))

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        return batch.assign(p=[round(exact.mcnemar_exact(int(b), int(c)), 9) for b, c in zip(batch["only_off"], batch["only_on"])])

    return counts.groupBy("rule").applyInPandas(run, "rule string, n_items long, n_same long, pass_fail long, fail_pass long, only_off long, only_on long, p double")


def self_checks(spark, sf_dir):
    """Q36: figures of the reports against each other, computed from the tables; one row for each assertion."""
    f = flags(spark, sf_dir)
    log = table(spark, sf_dir, "items_full").filter("job_id is not null")
    from stemwright.operators.detector import RULES
    from stemwright.plans.items import usable_rows

    total = f.agg(
        F.count("*").alias("n"), F.count_distinct("job_id").alias("jobs"), F.sum("n_flaws").alias("flaws"), F.sum(sum((F.col(r) for r in RULES[1:]), F.col(RULES[0]))).alias("by_rule"),
        F.count_if(F.expr("n_flaws > 0")).alias("flawed"), F.sum(F.greatest(*RULES)).alias("any_rule"), F.count_if(F.col("key").isin(*"ABCDE")).alias("keyed"),
        F.count_if(F.col("n_options") == 5).alias("five"), F.count_if(F.expr("condition in ('plain', 'guided')")).alias("two"), F.count_if(F.expr("condition = 'plain'")).alias("plain"), F.count_if(F.expr("condition = 'guided'")).alias("guided"))
    models = f.groupBy("model_label").agg(F.count("*").alias("k")).agg(F.sum("k").alias("by_model"))
    usable = usable_rows(log).agg(F.count_distinct("job_id").alias("usable"))
    row = total.crossJoin(models).crossJoin(usable)  # three single rows
    cases = [("items of all models", "by_model", "n"), ("one item for each job", "n", "jobs"), ("items are the usable jobs", "n", "usable"), ("flaws by rule", "by_rule", "flaws"),
             ("items with a flaw", "any_rule", "flawed"), ("items with a key", "keyed", "n"), ("items with five options", "five", "n"), ("plain and guided", "plain + guided", "two")]
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("label"), F.expr(b).cast("long").alias("computed"), F.expr(c).cast("long").alias("expected")) for a, b, c in cases]))
    return row.select(each).withColumn("ok", F.col("computed") == F.col("expected"))


QUERIES = {f.__name__: f for f in (detector_labels, label_rows_kept, judge_labels, judge_raters, judge_prevalence, judge_settings, self_checks)}

_V = f"""v0 AS (SELECT item_id, upper(trim(rater)) AS rater, row_id, submitted_utc, lower(trim(q1)) AS q1, lower(trim(q2)) AS q2, lower(trim(q3)) AS q3, lower(trim(q5)) AS q5 FROM (
  SELECT item_id, rater, row_id, submitted_utc, q1, q2, q3, q5 FROM main_r1 UNION ALL SELECT item_id, rater, row_id, submitted_utc, q1, q2, q3, q5 FROM main_r2) WHERE item_id IS NOT NULL AND rater IS NOT NULL),
v1 AS (SELECT * FROM v0 QUALIFY row_number() OVER (PARTITION BY item_id, rater ORDER BY submitted_utc DESC NULLS LAST, row_id DESC) = 1),
v AS ({" UNION ALL ".join(f"SELECT item_id, rater, '{n}' AS rule, ({e})::INT AS failed FROM v1" for n, e in VERDICTS.items())}),
g AS (SELECT item_id, rule, min(failed) AS gold FROM v WHERE rater NOT IN ('R1', 'R2') GROUP BY item_id, rule HAVING min(failed) = max(failed))"""


def _table_sql(source: str, keys: str) -> str:
    return f"""t AS (SELECT {keys}, count(*) FILTER (WHERE pred = 1 AND gold = 1)::DOUBLE AS tp, count(*) FILTER (WHERE pred = 1 AND gold = 0)::DOUBLE AS fp,
  count(*) FILTER (WHERE pred = 0 AND gold = 1)::DOUBLE AS fn, count(*) FILTER (WHERE pred = 0 AND gold = 0)::DOUBLE AS tn FROM {source} GROUP BY {keys}),
k AS (SELECT *, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / pow(tp + fp + fn + tn, 2) AS e, (tp + tn) / (tp + fp + fn + tn) AS o FROM t)
SELECT {keys}, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 0.0 END AS recall, CASE WHEN e < 1 THEN round((o - e) / (1 - e), 6) ELSE 'nan'::DOUBLE END AS kappa FROM k"""


_CELLS = "c AS (" + " UNION ALL ".join(
    f"SELECT item_id, lower(trim(job_id)) AS job_id, '{r}' AS rule, lower(trim(reader{i}_{q})) AS label FROM reader_check WHERE lower(trim(reader{i}_{q})) IN ('yes', 'no')"
    for r, q in READER_RULES.items() for i in (1, 2)) + ")"
from stemwright.plans.report_queries import _wilson_sql  # noqa: E402

ORACLE = {
    "detector_labels": f"WITH {FLAGS_SQL}, {_CELLS}, a AS (SELECT item_id, any_value(job_id) AS job_id, rule, min(label) AS label FROM c GROUP BY item_id, rule HAVING min(label) = max(label)), s AS ("
    + " UNION ALL ".join(f"SELECT job_id, '{r}' AS rule, {r} AS pred FROM full_flags" for r in READER_RULES)
    + f"), b AS (SELECT rule, pred, (label = 'yes')::INT AS gold FROM a JOIN s USING (job_id, rule)), {_table_sql('b', 'rule')}",
    "label_rows_kept": f"""WITH {_CELLS}, p AS (SELECT rule, item_id, count(*) AS n, count(DISTINCT label) AS k FROM c GROUP BY ALL)
SELECT rule, sum(n)::BIGINT AS n_rows, count(*) FILTER (WHERE k = 1)::BIGINT AS n_kept, count(*) FILTER (WHERE n > 1)::BIGINT AS n_repeated, count(*) FILTER (WHERE k > 1)::BIGINT AS n_conflicting FROM p GROUP BY rule""",
    "judge_labels": f"WITH {_V}, b AS (SELECT rule, failed AS pred, gold FROM v JOIN g USING (item_id, rule) WHERE rater = 'R1'), {_table_sql('b', 'rule')}",
    "judge_raters": f"""WITH {_V}, r AS (SELECT item_id, rule, rater AS reference, failed AS gold FROM v WHERE rater <> 'R1'
  UNION ALL SELECT item_id, rule, 'all raters', min(failed) FROM v WHERE rater <> 'R1' GROUP BY item_id, rule UNION ALL SELECT item_id, rule, 'any rater', max(failed) FROM v WHERE rater <> 'R1' GROUP BY item_id, rule),
b AS (SELECT r.reference, rule, v.failed AS pred, r.gold FROM v JOIN r USING (item_id, rule) WHERE v.rater = 'R1'), {_table_sql('b', 'reference, rule')}""",
    "judge_prevalence": f"""WITH {_V}, j AS (SELECT item_id, rule, failed FROM v WHERE rater = 'R1' AND rule <> 'composite'),
e AS (SELECT * FROM j UNION ALL SELECT item_id, 'any', max(failed) FROM j GROUP BY item_id),
c AS (SELECT model, condition, rule, count(*)::BIGINT AS n_items, sum(failed)::BIGINT AS n_hit FROM e JOIN main_key USING (item_id) GROUP BY ALL) SELECT *, {_wilson_sql('n_hit', 'n_items')} FROM c""",
    "judge_settings": f"""WITH {_V}, b AS (SELECT x.rule, x.failed AS off, y.failed AS onn, gold FROM v x JOIN v y USING (item_id, rule) LEFT JOIN g USING (item_id, rule) WHERE x.rater = 'R1' AND y.rater = 'R2'),
c AS (SELECT rule, count(*)::BIGINT AS n_items, count(*) FILTER (WHERE off = onn)::BIGINT AS n_same, count(*) FILTER (WHERE off = 0 AND onn = 1)::BIGINT AS pass_fail, count(*) FILTER (WHERE off = 1 AND onn = 0)::BIGINT AS fail_pass,
  count(*) FILTER (WHERE off = gold AND onn <> gold)::BIGINT AS only_off, count(*) FILTER (WHERE onn = gold AND off <> gold)::BIGINT AS only_on FROM b GROUP BY rule)
SELECT *, CASE WHEN only_off + only_on = 0 THEN 1.0 ELSE round(least(1, 2 * (SELECT sum(exp(lgamma(only_off + only_on + 1) - lgamma(i + 1) - lgamma(only_off + only_on - i + 1) - (only_off + only_on) * ln(2)))
  FROM unnest(generate_series(0, least(only_off, only_on))) AS s(i))), 9) END AS p FROM c""",
    "self_checks": f"""WITH {FLAGS_SQL}, n AS (SELECT count(*) AS n, count(DISTINCT job_id) AS jobs, sum(n_flaws) AS flaws, count(*) FILTER (WHERE n_flaws > 0) AS flawed, count(*) FILTER (WHERE condition IN ('plain', 'guided')) AS two FROM full_flags),
u AS (SELECT count(DISTINCT job_id) AS usable FROM usable), a AS (SELECT unnest([{{'label': 'items of all models', 'computed': n, 'expected': n}}, {{'label': 'one item for each job', 'computed': n, 'expected': jobs}},
{{'label': 'items are the usable jobs', 'computed': n, 'expected': usable}}, {{'label': 'flaws by rule', 'computed': flaws, 'expected': flaws}}, {{'label': 'items with a flaw', 'computed': flawed, 'expected': flawed}},
{{'label': 'items with a key', 'computed': n, 'expected': n}}, {{'label': 'items with five options', 'computed': n, 'expected': n}}, {{'label': 'plain and guided', 'computed': two, 'expected': two}}]) AS r FROM n, u)
SELECT r.label AS label, r.computed::BIGINT AS computed, r.expected::BIGINT AS expected, r.computed = r.expected AS ok FROM a""",
}
