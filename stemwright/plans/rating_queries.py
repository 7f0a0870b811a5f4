"""Queries over ratings and reader checks: cell checks, defects, agreement, weighted precision and recall."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stemwright.functions import stats as st
from stemwright.operators import exact, parse
from stemwright.operators.detector import RULES
from stemwright.functions.text import norm
from stemwright.plans.items import _SPACE, FLAGS_SQL, flags, items
from stemwright.plans.report_queries import _wilson_sql
from stemwright.session import table

QS = ["q1", "q2", "q3", "q4", "q5"]
READER_RULES = {"longest_option_key": "q1_longest", "clang_cue": "q2_repetition", "absolute_terms": "q3_absolute"}


def _rows(spark, sf_dir):
    columns = ["item_id", "rater", "row_id", "submitted_utc", "justification", *QS, *[f"{q}_raw" for q in QS]]
    both = table(spark, sf_dir, "main_r1").select(*columns).unionByName(table(spark, sf_dir, "main_r2").select(*columns))
    return both.withColumn("rater", F.upper(F.trim("rater")))


def _latest(spark, sf_dir):
    """The last submission of each rater for each item, answers in lower case."""
    w = W.partitionBy("item_id", "rater").orderBy(F.desc_nulls_last("submitted_utc"), F.desc("row_id"))
    last = _rows(spark, sf_dir).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return last.select("item_id", "rater", *[F.coalesce(F.lower(F.trim(q)), F.lit("")).alias(q) for q in QS])


def _defect():
    return (F.col("q1").isin("no", "unsure") | (F.col("q2") == "no") | (F.col("q3") == "no") | (F.col("q5") == "no")).cast("int")


def rating_problems(spark, sf_dir):
    """PV10: cells that are blank, unknown or hold more than the rating, and missing justifications, by rater."""
    df = _rows(spark, sf_dir)
    known = {q: ["yes", "no", "unsure"] for q in QS[:4]} | {"q5": ["yes", "minor edits", "no"]}
    checks = []
    for q in QS:
        value = parse.rating_by_first_word(F.col(f"{q}_raw"))
        raw = F.lower(norm(F.col(f"{q}_raw"), fold_dashes=False))
        checks.append(F.when(value == "", f"{q} blank").when(~value.isin(known[q]), f"{q} unknown").when(raw != value, f"{q} extra text"))
    values = {q: parse.rating_by_first_word(F.col(f"{q}_raw")) for q in QS}
    unsure = reduce(lambda a, b: a | b, [values[q].isin("no", "unsure") for q in QS[:4]]) | values["q5"].isin("no", "minor edits")
    checks.append(F.when(unsure & (F.trim(F.coalesce("justification", F.lit(""))) == ""), "justification missing"))
    return df.select("rater", F.explode(F.array_compact(F.array(*checks))).alias("problem")).groupBy("rater", "problem").agg(F.count("*").alias("n_cells"))


def rating_contradictions(spark, sf_dir):
    """PV10: ratings that contradict each other, by rater."""
    df = _latest(spark, sf_dir)
    notes = F.array_compact(F.array(
        F.when((F.col("q1") == "no") & (F.col("q5") == "yes"), "key not best but accepted"),
        F.when((F.col("q5") == "no") & (F.col("q1") == "yes") & (F.col("q2") == "yes") & (F.col("q3") == "yes") & (F.col("q4") == "yes"), "rejected without a defect"),
        F.when((F.col("q3") == "no") & (F.col("q5") == "yes"), "inaccurate but accepted")))
    return df.select("rater", F.explode(notes).alias("note")).groupBy("rater", "note").agg(F.count("*").alias("n_items"))


def rating_normalisers(spark, sf_dir):
    """PV8/PV9: how often reading a cell by its first word and by its start agree."""
    df = table(spark, sf_dir, "calibration_r2")
    a, b = parse.rating_by_first_word(F.col("q1_raw")), parse.rating_by_prefix(F.col("q1_raw"))
    return df.select(F.upper(F.trim("rater")).alias("rater"), (a == b).alias("same")).groupBy("rater").agg(F.count("*").alias("n_cells"), F.count_if("same").alias("n_same"))


def content_defects(spark, sf_dir):
    """Q32: items with a content defect by rater and prompt, Wilson intervals."""
    key = table(spark, sf_dir, "main_key").select("item_id", "condition")
    out = _latest(spark, sf_dir).join(key, "item_id").groupBy("rater", "condition").agg(F.count("*").alias("n_items"), F.sum(_defect()).alias("n_hit"))
    return st.with_wilson(out, "n_hit", "n_items")


def rater_agreement(spark, sf_dir):
    """Q32: R1 against each other rater by question: raw agreement and kappa over all categories."""
    cells = F.explode(F.array(*[F.struct(F.lit(q).alias("question"), F.col(q).alias("v")) for q in QS])).alias("c")
    df = _latest(spark, sf_dir).select("item_id", "rater", cells).select("item_id", "rater", "c.question", "c.v")
    first = df.filter("rater = 'R1'").select("item_id", "question", F.col("v").alias("a"))
    pairs = df.filter("rater != 'R1'").select("item_id", "question", "rater", F.col("v").alias("b")).join(first, ["item_id", "question"])
    total = pairs.groupBy("rater", "question").agg(F.count("*").alias("n_items"), F.count_if(F.col("a") == F.col("b")).alias("n_same"))
    na = pairs.groupBy("rater", "question", F.col("a").alias("v")).agg(F.count("*").alias("na"))
    nb = pairs.groupBy("rater", "question", F.col("b").alias("v")).agg(F.count("*").alias("nb"))
    chance = na.join(nb, ["rater", "question", "v"]).groupBy("rater", "question").agg(F.sum(F.col("na") * F.col("nb")).alias("c"))
    po, pe = F.col("n_same") / F.col("n_items"), F.coalesce("c", F.lit(0)) / (F.col("n_items") * F.col("n_items"))
    return total.join(chance, ["rater", "question"], "left").select(
        "rater", "question", "n_items", F.round(po, 6).alias("raw_agreement"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def _defect_tables(spark, sf_dir):
    df = _latest(spark, sf_dir).select("item_id", "rater", _defect().alias("d"))
    pairs = df.filter("rater != 'R1'").join(df.filter("rater = 'R1'").select("item_id", F.col("d").alias("a")), "item_id")
    c = lambda x, y: F.count_if((F.col("a") == x) & (F.col("d") == y))
    return pairs.groupBy("rater").agg(c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))


def defect_agreement(spark, sf_dir):
    """Q32: the defect composite of R1 against each other rater: 2x2 table, kappa, positive agreement."""
    t = [F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn")]
    return _defect_tables(spark, sf_dir).select(
        "rater", "tp", "fp", "fn", "tn", F.round(st.kappa(*t), 6).alias("kappa"), F.round(st.precision_recall(*t)["positive_agreement"], 6).alias("positive_agreement"))


def defect_kappa_interval(spark, sf_dir):
    """ST22: bootstrap interval of those kappas; one row of four counts for each rater is resampled."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        r = batch.iloc[0]
        low, high = exact.kappa_interval(int(r.tp), int(r.fp), int(r.fn), int(r.tn))
        return pd.DataFrame([(r.rater, low, high)], columns=["rater", "kappa_lo", "kappa_hi"])

    return _defect_tables(spark, sf_dir).groupBy("rater").applyInPandas(run, "rater string, kappa_lo double, kappa_hi double")


def defect_crosstab(spark, sf_dir):
    """Q32: content defects by all and by any rater against structural flags of the same items."""
    per = _latest(spark, sf_dir).groupBy("item_id").agg(F.min(_defect()).alias("d_all"), F.max(_defect()).alias("d_any"))
    key = table(spark, sf_dir, "main_key").select("item_id", "condition", F.lower(F.trim("job_id")).alias("job_id"))
    flagged = flags(spark, sf_dir).select("job_id", F.greatest(*RULES).alias("flagged"))
    return per.join(key, "item_id").join(flagged, "job_id").groupBy("condition", "flagged").agg(
        F.count("*").alias("n_items"), F.sum("d_all").alias("n_all"), F.sum("d_any").alias("n_any"))


def defect_fisher(spark, sf_dir):
    """ST17: Fisher's exact test of defects by any rater, flagged against clean items, for each prompt."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        t = {int(r.flagged): (int(r.n_any), int(r.n_items) - int(r.n_any)) for r in batch.itertuples()}
        p = exact.fisher_two_sided(*t.get(1, (0, 0)), *t.get(0, (0, 0)), relative=0.0, absolute=1e-12)
        return pd.DataFrame([(batch.condition.iloc[0], p)], columns=["condition", "p"])

    return defect_crosstab(spark, sf_dir).groupBy("condition").applyInPandas(run, "condition string, p double")


def _reader_cells(spark, sf_dir):
    df = table(spark, sf_dir, "reader_check")
    s = lambda i, q: F.coalesce(F.lower(F.trim(f"reader{i}_{q}")), F.lit(""))
    cells = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(f"detector_{r}").alias("d"), s(1, q).alias("a"), s(2, q).alias("b")) for r, q in READER_RULES.items()
    ])).alias("c")
    return df.select("item_id", "stratum", cells).select("item_id", "stratum", "c.*")


def _coded(c, policy):
    return F.when(c == "yes", 1).when(c == "no", 0).when((c == "unsure") & (policy == "no"), 0).when((c == "unsure") & (policy == "yes"), 1)


def reader_agreement(spark, sf_dir):
    """Q33: readers against each other and against the detector, with 'unsure' read as no, yes or dropped."""
    df = _reader_cells(spark, sf_dir).withColumn("unsure_as", F.explode(F.array(*[F.lit(p) for p in ("no", "yes", "drop")])))
    df = df.withColumns({"x": _coded(F.col("a"), F.col("unsure_as")), "y": _coded(F.col("b"), F.col("unsure_as"))}).dropna(subset=["x", "y", "d"])
    df = df.withColumn("z", F.col("x") * F.col("y"))
    c = lambda p, q, i, j: F.count_if((F.col(p) == i) & (F.col(q) == j)).cast("double")
    four = lambda p, q: [c(p, q, 1, 1), c(p, q, 1, 0), c(p, q, 0, 1), c(p, q, 0, 0)]
    pr = st.precision_recall(*four("d", "z"), undefined=float("nan"))
    return df.groupBy("unsure_as", "rule").agg(
        F.count("*").alias("n_items"), F.sum("z").alias("n_both"), F.round(st.kappa(*four("x", "y")), 6).alias("kappa_readers"),
        F.round(st.kappa(*four("d", "z")), 6).alias("kappa_detector"), F.round(pr["precision"], 6).alias("precision"), F.round(pr["recall"], 6).alias("recall"))


def reader_mcnemar(spark, sf_dir):
    """ST18: exact test of the discordant answers of the two readers."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        r = batch.iloc[0]
        return pd.DataFrame([(r.rule, int(r.b), int(r.c), exact.mcnemar_exact(int(r.b), int(r.c)))], columns=["rule", "b", "c", "p"])

    counts = _reader_cells(spark, sf_dir).groupBy("rule").agg(
        F.count_if((F.col("a") == "yes") & (F.col("b") == "no")).alias("b"), F.count_if((F.col("a") == "no") & (F.col("b") == "yes")).alias("c"))
    return counts.groupBy("rule").applyInPandas(run, "rule string, b long, c long, p double")


def reader_exact_bounds(spark, sf_dir):
    """ST19: exact bounds of the share of items both readers call flawed."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        r = batch.iloc[0]
        return pd.DataFrame([(r.rule, int(r.k), int(r.n), *exact.clopper_pearson(int(r.k), int(r.n)))], columns=["rule", "k", "n", "lo", "hi"])

    counts = _reader_cells(spark, sf_dir).groupBy("rule").agg(F.count_if((F.col("a") == "yes") & (F.col("b") == "yes")).alias("k"), F.count("*").alias("n"))
    return counts.groupBy("rule").applyInPandas(run, "rule string, k long, n long, lo double, hi double")


def _stratum():
    n = reduce(lambda a, b: a + b, [F.col(r) for r in READER_RULES])
    return F.when(n == 0, "none").when(n >= 2, "multi").when(F.col("longest_option_key") == 1, "longest_only").when(F.col("clang_cue") == 1, "clang_only").otherwise("absolute_only")


def design_weighted(spark, sf_dir):
    """ST26: precision and recall of the detector, each item weighted by its stratum's population over its sample."""
    population = flags(spark, sf_dir).groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("pop"))
    df = _reader_cells(spark, sf_dir).withColumn("z", ((F.col("a") == "yes") & (F.col("b") == "yes")).cast("int"))
    sizes = df.groupBy("stratum").agg(F.count_distinct("item_id").alias("n"))
    weights = sizes.join(population, "stratum").select("stratum", (F.col("pop") / F.col("n")).alias("w"))
    s = lambda i, j: F.sum(F.when((F.col("d") == i) & (F.col("z") == j), F.col("w")).otherwise(0.0))
    pr = st.precision_recall(s(1, 1), s(1, 0), s(0, 1), s(0, 0), undefined=float("nan"))
    return df.join(weights, "stratum").groupBy("rule").agg(F.count("*").alias("n_items"), F.round(pr["precision"], 6).alias("precision"), F.round(pr["recall"], 6).alias("recall"))


def design_weighted_intervals(spark, sf_dir):
    """ST25: bootstrap intervals of the weighted precision: cell counts of each stratum are drawn again, so only counts move."""
    population = flags(spark, sf_dir).groupBy(_stratum().alias("stratum")).agg(F.count("*").alias("pop"))
    cells = _reader_cells(spark, sf_dir).withColumn("z", ((F.col("a") == "yes") & (F.col("b") == "yes")).cast("int"))
    counts = cells.groupBy("rule", "stratum", "d", "z").agg(F.count("*").alias("n")).join(population, "stratum")

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        strata = {s: (int(g["pop"].iloc[0]), g["d"].to_numpy(), g["z"].to_numpy(), g["n"].to_numpy()) for s, g in batch.groupby("stratum")}
        low, high = exact.stratified_precision(strata)
        return pd.DataFrame([(batch["rule"].iloc[0], low, high)], columns=["rule", "precision_lo", "precision_hi"])

    return counts.groupBy("rule").applyInPandas(run, "rule string, precision_lo double, precision_hi double")


def selection_audit(spark, sf_dir):
    """SM7: rated items by prompt and specialty, and how many of them the readers saw too."""
    key = table(spark, sf_dir, "main_key").withColumn("job_id", F.lower(F.trim("job_id")))
    read = table(spark, sf_dir, "reader_check").select(F.lower(F.trim("job_id")).alias("job_id"), F.lit(1).alias("r")).distinct()
    return key.join(read, "job_id", "left").groupBy("condition", "specialty").agg(F.count("*").alias("n_items"), F.count("r").alias("n_read_too"))


def unmatched_ids(spark, sf_dir):
    """Rated items without a key and keys without a rating."""
    rated = _rows(spark, sf_dir).select("item_id").distinct()
    key = table(spark, sf_dir, "main_key").select("item_id").distinct()
    out = rated.join(key, "item_id", "left_anti").withColumn("side", F.lit("no key"))
    return out.unionByName(key.join(rated, "item_id", "left_anti").withColumn("side", F.lit("no rating")))


def key_without_item(spark, sf_dir):
    """JN15: jobs of the key against the items of the log, as counts of a full outer join."""
    key = table(spark, sf_dir, "main_key").select(F.lower(F.trim("job_id")).alias("job_id")).distinct().withColumn("k", F.lit(1))
    have = items(spark, sf_dir).select("job_id").withColumn("i", F.lit(1))
    return key.join(have, "job_id", "full_outer").agg(
        F.count_if(F.col("k").isNotNull() & F.col("i").isNotNull()).alias("both"), F.count_if(F.col("i").isNull()).alias("key_only"), F.count_if(F.col("k").isNull()).alias("item_only"))


QUERIES = {f.__name__: f for f in (
    rating_problems, rating_contradictions, rating_normalisers, content_defects, rater_agreement, defect_agreement, defect_kappa_interval,
    defect_crosstab, defect_fisher, reader_agreement, reader_mcnemar, reader_exact_bounds, design_weighted, design_weighted_intervals, selection_audit, unmatched_ids, key_without_item)}

_R = ", ".join(["item_id", "upper(trim(rater)) AS rater", "row_id", "submitted_utc", "justification", *QS, *[f"{q}_raw" for q in QS]])
_ROWS = f"r AS (SELECT {_R} FROM main_r1 UNION ALL SELECT {_R} FROM main_r2)"
_LATEST = _ROWS + ", l AS (SELECT item_id, rater, " + ", ".join(f"coalesce(lower(trim({q})), '') AS {q}" for q in QS) + """ FROM r
QUALIFY row_number() OVER (PARTITION BY item_id, rater ORDER BY submitted_utc DESC NULLS LAST, row_id DESC) = 1),
d AS (SELECT *, (q1 IN ('no', 'unsure') OR q2 = 'no' OR q3 = 'no' OR q5 = 'no')::INT AS d FROM l)"""


def _tidy_sql(x: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '{_SPACE}', ' ', 'g')))"


def _first_word_sql(x: str) -> str:
    s = _tidy_sql(x)
    w = rf"regexp_replace(regexp_extract({s}, '^\S+'), '^[.,;:()\-]+|[.,;:()\-]+$', '', 'g')"
    return f"CASE WHEN {s} = '' THEN '' WHEN {w} LIKE 'y%' THEN 'yes' WHEN {w} LIKE 'n%' THEN 'no' WHEN {w} LIKE 'u%' THEN 'unsure' WHEN {w} LIKE 'm%' THEN 'minor edits' ELSE {s} END"


def _prefix_sql(x: str) -> str:
    s = _tidy_sql(x)
    return f"CASE WHEN {s} = '' THEN '' WHEN {s} LIKE 'yes%' THEN 'yes' WHEN {s} LIKE 'no%' THEN 'no' WHEN {s} LIKE 'unsure%' THEN 'unsure' WHEN {s} LIKE 'minor%' THEN 'minor edits' ELSE {s} END"


_KAPPA = "(({tp} + {tn}) / n - (({tp} + {fp}) * ({tp} + {fn}) + ({fn} + {tn}) * ({fp} + {tn})) / (n * n)) / (1 - (({tp} + {fp}) * ({tp} + {fn}) + ({fn} + {tn}) * ({fp} + {tn})) / (n * n))"
_CELLS = "x AS (" + " UNION ALL ".join(
    f"SELECT item_id, stratum, '{r}' AS rule, detector_{r} AS d, coalesce(lower(trim(reader1_{q})), '') AS a, coalesce(lower(trim(reader2_{q})), '') AS b FROM reader_check" for r, q in READER_RULES.items()) + ")"
_CODE = "CASE WHEN {0} = 'yes' THEN 1 WHEN {0} = 'no' THEN 0 WHEN {0} = 'unsure' AND u = 'no' THEN 0 WHEN {0} = 'unsure' AND u = 'yes' THEN 1 END"
_ALLOWED = {q: "('yes', 'no', 'unsure')" for q in QS[:4]} | {"q5": "('yes', 'minor edits', 'no')"}
ORACLE = {
    "rating_problems": f"WITH {_ROWS}, v AS (SELECT rater, justification, " + ", ".join(f"{_first_word_sql(q + '_raw')} AS v_{q}, {_tidy_sql(q + '_raw')} AS t_{q}" for q in QS) + " FROM r), p AS ("
    + " UNION ALL ".join(f"SELECT rater, CASE WHEN v_{q} = '' THEN '{q} blank' WHEN v_{q} NOT IN {_ALLOWED[q]} THEN '{q} unknown' WHEN t_{q} <> v_{q} THEN '{q} extra text' END AS problem FROM v" for q in QS)
    + " UNION ALL SELECT rater, CASE WHEN (" + " OR ".join(f"v_{q} IN ('no', 'unsure')" for q in QS[:4]) + """ OR v_q5 IN ('no', 'minor edits')) AND trim(coalesce(justification, '')) = '' THEN 'justification missing' END FROM v)
SELECT rater, problem, count(*)::BIGINT AS n_cells FROM p WHERE problem IS NOT NULL GROUP BY ALL""",
    "rating_contradictions": f"""WITH {_LATEST}, n AS (SELECT rater, 'key not best but accepted' AS note FROM l WHERE q1 = 'no' AND q5 = 'yes'
UNION ALL SELECT rater, 'rejected without a defect' FROM l WHERE q5 = 'no' AND q1 = 'yes' AND q2 = 'yes' AND q3 = 'yes' AND q4 = 'yes'
UNION ALL SELECT rater, 'inaccurate but accepted' FROM l WHERE q3 = 'no' AND q5 = 'yes') SELECT rater, note, count(*)::BIGINT AS n_items FROM n GROUP BY ALL""",
    "rating_normalisers": f"""SELECT upper(trim(rater)) AS rater, count(*)::BIGINT AS n_cells, count(*) FILTER (WHERE ({_first_word_sql('q1_raw')}) = ({_prefix_sql('q1_raw')}))::BIGINT AS n_same
FROM calibration_r2 GROUP BY ALL""",
    "content_defects": f"""WITH {_LATEST}, c AS (SELECT rater, condition, count(*)::BIGINT AS n_items, sum(d)::BIGINT AS n_hit FROM d JOIN main_key USING (item_id) GROUP BY ALL)
SELECT *, {_wilson_sql('n_hit', 'n_items')} FROM c""",
    "rater_agreement": f"WITH {_LATEST}, c AS (" + " UNION ALL ".join(f"SELECT item_id, rater, '{q}' AS question, {q} AS v FROM l" for q in QS) + """),
p AS (SELECT y.rater, y.question, x.v AS a, y.v AS b FROM c x JOIN c y USING (item_id, question) WHERE x.rater = 'R1' AND y.rater <> 'R1'),
t AS (SELECT rater, question, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = b) AS s FROM p GROUP BY ALL),
na AS (SELECT rater, question, a AS v, count(*) AS na FROM p GROUP BY ALL), nb AS (SELECT rater, question, b AS v, count(*) AS nb FROM p GROUP BY ALL),
e AS (SELECT rater, question, sum(na * nb) AS c FROM na JOIN nb USING (rater, question, v) GROUP BY ALL)
SELECT rater, question, n::BIGINT AS n_items, round(s / n, 6) AS raw_agreement, CASE WHEN coalesce(c, 0) / (n * n) < 1 THEN round((s / n - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)), 6) END AS kappa
FROM t LEFT JOIN e USING (rater, question)""",
    "defect_agreement": f"""WITH {_LATEST}, p AS (SELECT y.rater, x.d AS a, y.d AS b FROM d x JOIN d y USING (item_id) WHERE x.rater = 'R1' AND y.rater <> 'R1'),
c AS (SELECT rater, count(*)::DOUBLE AS n, count(*) FILTER (WHERE a = 1 AND b = 1) AS tp, count(*) FILTER (WHERE a = 1 AND b = 0) AS fp, count(*) FILTER (WHERE a = 0 AND b = 1) AS fn, count(*) FILTER (WHERE a = 0 AND b = 0) AS tn FROM p GROUP BY rater)
SELECT rater, tp, fp, fn, tn, round({_KAPPA.format(tp='tp', fp='fp', fn='fn', tn='tn')}, 6) AS kappa, CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) ELSE 0.0 END AS positive_agreement FROM c""",
    "defect_crosstab": f"""WITH {FLAGS_SQL}, {_LATEST.replace('d AS (SELECT', 'dd AS (SELECT')}, p AS (SELECT item_id, min(d) AS d_all, max(d) AS d_any FROM dd GROUP BY item_id),
k AS (SELECT item_id, condition, lower(trim(job_id)) AS job_id FROM main_key)
SELECT k.condition, any_flaw AS flagged, count(*)::BIGINT AS n_items, sum(d_all)::BIGINT AS n_all, sum(d_any)::BIGINT AS n_any FROM p JOIN k USING (item_id) JOIN full_flags f USING (job_id) GROUP BY ALL""",
    "reader_agreement": f"""WITH {_CELLS}, c AS (SELECT rule, u AS unsure_as, d, {_CODE.format('a')} AS x, {_CODE.format('b')} AS y FROM x, (VALUES ('no'), ('yes'), ('drop')) AS p(u)),
z AS (SELECT *, x * y AS z FROM c WHERE x IS NOT NULL AND y IS NOT NULL AND d IS NOT NULL),
t AS (SELECT unsure_as, rule, count(*)::DOUBLE AS n, sum(z) AS nz, count(*) FILTER (WHERE x = 1 AND y = 1) AS a1, count(*) FILTER (WHERE x = 1 AND y = 0) AS a2, count(*) FILTER (WHERE x = 0 AND y = 1) AS a3, count(*) FILTER (WHERE x = 0 AND y = 0) AS a4,
count(*) FILTER (WHERE d = 1 AND z = 1) AS b1, count(*) FILTER (WHERE d = 1 AND z = 0) AS b2, count(*) FILTER (WHERE d = 0 AND z = 1) AS b3, count(*) FILTER (WHERE d = 0 AND z = 0) AS b4 FROM z GROUP BY ALL)
SELECT unsure_as, rule, n::BIGINT AS n_items, nz::BIGINT AS n_both, round({_KAPPA.format(tp='a1', fp='a2', fn='a3', tn='a4')}, 6) AS kappa_readers,
round({_KAPPA.format(tp='b1', fp='b2', fn='b3', tn='b4')}, 6) AS kappa_detector, round(b1 / (b1 + b2), 6) AS precision, round(b1 / (b1 + b3), 6) AS recall FROM t""",
    "design_weighted": f"""WITH {FLAGS_SQL}, {_CELLS}, s AS (SELECT CASE WHEN longest_option_key + clang_cue + absolute_terms = 0 THEN 'none' WHEN longest_option_key + clang_cue + absolute_terms >= 2 THEN 'multi'
WHEN longest_option_key = 1 THEN 'longest_only' WHEN clang_cue = 1 THEN 'clang_only' ELSE 'absolute_only' END AS stratum, count(*) AS pop FROM full_flags GROUP BY 1),
w AS (SELECT stratum, pop / n AS w FROM (SELECT stratum, count(DISTINCT item_id) AS n FROM x GROUP BY stratum) JOIN s USING (stratum)),
y AS (SELECT rule, d, (a = 'yes' AND b = 'yes')::INT AS z, w FROM x JOIN w USING (stratum)),
t AS (SELECT rule, count(*)::BIGINT AS n_items, coalesce(sum(w) FILTER (WHERE d = 1 AND z = 1), 0) AS tp, coalesce(sum(w) FILTER (WHERE d = 1 AND z = 0), 0) AS fp, coalesce(sum(w) FILTER (WHERE d = 0 AND z = 1), 0) AS fn FROM y GROUP BY rule)
SELECT rule, n_items, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 'nan'::DOUBLE END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) ELSE 'nan'::DOUBLE END AS recall FROM t""",
    "selection_audit": """SELECT condition, specialty, count(*)::BIGINT AS n_items, count(r)::BIGINT AS n_read_too FROM main_key k
LEFT JOIN (SELECT DISTINCT lower(trim(job_id)) AS j, 1 AS r FROM reader_check) ON j = lower(trim(k.job_id)) GROUP BY ALL""",
    "unmatched_ids": f"""WITH {_ROWS} SELECT DISTINCT item_id, 'no key' AS side FROM r ANTI JOIN main_key USING (item_id)
UNION ALL SELECT DISTINCT item_id, 'no rating' FROM main_key ANTI JOIN r USING (item_id)""",
    "key_without_item": f"""WITH {FLAGS_SQL}, k AS (SELECT DISTINCT lower(trim(job_id)) AS job_id, 1 AS k FROM main_key), i AS (SELECT job_id, 1 AS i FROM items)
SELECT count(*) FILTER (WHERE k IS NOT NULL AND i IS NOT NULL)::BIGINT AS "both", count(*) FILTER (WHERE i IS NULL)::BIGINT AS key_only, count(*) FILTER (WHERE k IS NULL)::BIGINT AS item_only FROM k FULL JOIN i USING (job_id)""",
}
