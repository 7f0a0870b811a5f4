"""Parsing, policies, jobs, exact tests, regressions, drift, sources, sinks and streams."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from stemwright.functions import stats as st
from stemwright.functions import text as tx
from stemwright.operators import dedup, drift, exact, fit, jobs, parse, sampling
from stemwright.sources import readers, sinks

GOOD = {"stem": "S?", "options": {k: f"o{k}" for k in "ABCDE"}, "answer": "c", "rationale": "R"}
TEXT = json.dumps(GOOD)


@pytest.mark.parametrize("text, error, repair", [
    (TEXT, None, "none"), ("Sure: " + TEXT, None, "outer_braces"), (TEXT[:-1], None, "append_brace"), (TEXT[:-1] + ", }", None, "trailing_comma"),
    (TEXT + " bye", None, "outer_braces"), ("no", "not_json", None), ("", "empty", None), (None, "empty", None), ("[1]", "not_object", None),
    (json.dumps(GOOD | {"answer": "Z"}), "answer_not_in_options", None), (json.dumps(GOOD | {"options": list("vwxyz")}), None, "none"),
    (json.dumps(GOOD | {"options": {"A": 1, "a": 2}}), "duplicate_option_key", None), (json.dumps({k: v for k, v in GOOD.items() if k != "stem"}), "missing_fields", None),
    (json.dumps(GOOD | {"options": {k: "x" for k in "ABCD"}}), "wrong_option_count", None), (json.dumps(GOOD | {"options": {k: " " for k in "ABCDE"}}), "empty_option", None),
    (TEXT.replace("S?", "a\nb"), None, "none"), ('{"stem": "S", ""options": 1}', "missing_fields", None),
])
def test_parse(text, error, repair):
    item, found, how = parse.parsed(text)
    assert (found, how) == (error, repair) and (item is None) == (error is not None)


def test_parse_nested_answer(spark):
    nested = {"stem": "S", "options": GOOD["options"] | {"answer": "B"}}
    rows = [(json.dumps(nested),), (TEXT,), (TEXT + " x",), (None,)]
    out = [r.p for r in spark.createDataFrame(rows, "t string").select(parse.parse_item(F.col("t")).alias("p")).collect()]
    assert [p.strict for p in out] == [False, True, False, False]
    assert out[0].item.answer == "B" and out[1].item.options["E"] == "oE" and out[3].error == "empty"


def test_judge():
    assert parse.judged('ok {"a": "fail", "b": "pass"}', ["a", "b"]) == ({"a": True, "b": False}, None)
    assert parse.judged('{"a": "fail"}', ["a", "b"])[1] == "missing_rules" and parse.judged(None, ["a"])[1] == "empty"


def test_policies(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, None), ("b", 5, None), ("c", 6, "z"), ("c", 7, "z")], "k string, ord long, v string")
    got = lambda d: sorted((r.k, r.ord) for r in d.collect())
    ok = F.col("v").isNotNull()
    assert got(dedup.first_where(df, ["k"], "ord", ok)) == [("a", 2), ("c", 6)]
    assert got(dedup.success_else_first(df, ["k"], "ord", ok)) == [("a", 2), ("b", 4), ("c", 6)]
    assert got(dedup.last_row(df, ["k"], "ord")) == [("a", 3), ("b", 5), ("c", 7)]
    assert got(dedup.agreed_only(df, ["k"], "ord", "v")) == [("c", 6)]
    assert sorted(r.k for r in dedup.done_keys(df, ["k"], ok).collect()) == ["a", "c"]
    assert dedup.last_row(df.filter("false"), ["k"], "ord").count() == 0


def test_cost_cap_crosses_blocks(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 2 else None) for i in range(40)], "ord long, cost double")
    assert sorted(r.ord for r in jobs.within_cost(df, "ord", "cost", 5.0, block=8).collect()) == list(range(10))


def test_sample_sizes(spark):
    df = spark.createDataFrame([(f"j{i}", "big" if i % 10 else "small") for i in range(200)], "job_id string, stratum string")
    out = sampling.per_stratum(df, ["stratum"], "job_id", F.lit(30), 1)
    assert {r.stratum: r.n for r in out.groupBy("stratum").agg(F.count("*").alias("n")).collect()} == {"big": 30, "small": 20}


def test_exact():
    assert exact.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert exact.mcnemar_exact(1, 7) == pytest.approx(0.0703125) and exact.mcnemar_exact(0, 0) == 1
    low, high = exact.clopper_pearson(0, 10)
    assert low == 0 and high == pytest.approx(0.3084971, abs=1e-6)
    assert round(exact.kappa(8, 5, 4, 83), 2) == 0.59 and math.isnan(exact.kappa(0, 0, 0, 0))
    assert exact.permutation_p([1, 2, 3, 4], [True, True, False, False])[1:] == (pytest.approx(2 / 6), 6)
    assert exact.pooled_random_effects([0.5, 0.5], [0.1, 0.1])["tau2"] == 0
    assert all(type(v) is float for v in exact.pooled_random_effects([0.1, 0.9], [0.1, 0.1]).values())
    low, high = exact.kappa_interval(8, 5, 4, 83)
    assert low < 0.59 < high


@settings(max_examples=20, deadline=None)
@given(hs.lists(hs.floats(0, 1), min_size=1, max_size=12))
def test_bh_against_loop(spark, values):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(values)], "i int, p double")
    found = {r.i: r.q for r in st.bh_adjusted(rows.withColumn("f", F.lit(1)), "p", ["f"], ["i"]).collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    best, wanted = 1.0, {}
    for rank in range(len(order), 0, -1):
        best = min(best, values[order[rank - 1]] * len(values) / rank)
        wanted[order[rank - 1]] = best
    assert found == pytest.approx(wanted)


def test_wilson_and_chi2(spark):
    df = spark.createDataFrame([(98, 400), (0, 0)], "k long, n long")
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(st.wilson(F.col("k"), F.col("n")))]).collect()
    assert (round(rows[0].c1, 3), round(rows[0].c2, 3)) == (0.205, 0.289) and math.isnan(rows[1].c0)
    counts = spark.createDataFrame([(197.0, 111.0, 68.0, 20.0, 4.0)], "a double, b double, c double, d double, e double")
    chi2, p = st.chi2_uniform([F.col(x) for x in "abcde"])
    row = counts.select(chi2.alias("x"), p.alias("p")).first()
    assert round(row.x, 1) == 302.1 and row.p == pytest.approx(3.8e-64, rel=0.05)


def test_logit_against_numpy(spark):
    rng = np.random.default_rng(3)
    n = 600
    x, g = rng.normal(size=n), rng.integers(0, 3, n)
    c = rng.integers(0, 25, n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + 0.8 * x - 0.5 * (g == 1))))).astype(int)
    df = spark.createDataFrame([(int(a), float(b), "abc"[k], int(m)) for a, b, k, m in zip(y, x, g, c)], "y int, x double, g string, c int")
    rows = fit.logit_cluster(df, "y", ["x"], {"g": "a"}, "c")
    X = np.column_stack([np.ones(n), x, g == 1, g == 2]).astype(float)
    b = np.zeros(4)
    for _ in range(30):
        mu = 1 / (1 + np.exp(-X @ b))
        b = b + np.linalg.solve(X.T @ (X * (mu * (1 - mu))[:, None]), X.T @ (y - mu))
    mu = 1 / (1 + np.exp(-X @ b))
    bread = np.linalg.inv(X.T @ (X * (mu * (1 - mu))[:, None]))
    scores = np.array([((y - mu)[:, None] * X)[c == k].sum(axis=0) for k in np.unique(c)])
    G = len(scores)
    cov = G / (G - 1) * (n - 1) / (n - 4) * bread @ scores.T @ scores @ bread
    assert [r["coef"] for r in rows] == pytest.approx(b.tolist(), abs=1e-6)
    assert [r["se"] for r in rows] == pytest.approx(np.sqrt(np.diag(cov)).tolist(), abs=1e-6)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = 1 + 2 * x + rng.normal(size=300) * (1 + abs(x))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, x)] + [(None, 1.0)], "y double, x double")
    rows, r2 = fit.ols_robust(df, "y", ["x"], {})
    X = np.column_stack([np.ones(300), x])
    inv = np.linalg.inv(X.T @ X)
    b = inv @ X.T @ y
    e = y - X @ b
    cov = 300 / 298 * inv @ (X.T @ (X * (e**2)[:, None])) @ inv
    assert [r["coef"] for r in rows] == pytest.approx(b.tolist()) and [r["se"] for r in rows] == pytest.approx(np.sqrt(np.diag(cov)).tolist())
    assert r2 == pytest.approx(1 - e.var() / y.var())


def _lines(spark, files):
    rows, line = [], 0
    for name, (at, records) in files.items():
        for n, r in enumerate(records, 1):
            line += 1
            rows.append((line, "r", name, f"2031-01-{at:02d} 00:00:00", n, r if r is None or isinstance(r, str) else json.dumps(r), 0))
    df = spark.createDataFrame(rows, "line_id long, run string, file_name string, w string, line_no int, record string, kinds int")
    return df.withColumn("written_at", F.to_timestamp_ntz("w"))


def test_drift(spark):
    lines = _lines(spark, {
        "f1": (1, [{"job_id": "A", "tier": "base", "n": 1, "old": "x"}, {"job_id": "b", "tier": None, "n": 2, "old": "y"}, "{broken", "", None, '{"job_id": "c"} x']),
        "f2": (2, [{"job_id": " a", "n": "1", "new": "x", "extra": True}, {"job_id": "b", "n": "2", "new": "y"}, {"job_id": "z", "new": "other"}]),
        "f3": (3, [{"job_id": "q", "n": "1", "newer": [1]}, [1, 2], 5]),
    })
    found = {tuple(r) for r in drift.schema_changes(lines).select("file_name", "field_name", "change_kind").collect()}
    assert found == {("f2", "new", "renamed"), ("f2", "tier", "removed"), ("f2", "extra", "added"), ("f2", "n", "retyped"),
                     ("f3", "new", "removed"), ("f3", "extra", "removed"), ("f3", "newer", "added")}
    table, failures = drift.consistent_table(lines)
    assert table.count() == 6 and "old" not in table.columns or "new" not in table.columns
    assert drift.schema_changes(lines.filter("false")).count() == 0
    assert failures.columns


def test_drift_failed_casts(spark):
    lines = _lines(spark, {"f": (1, [{"job_id": str(i), "n": i} for i in range(5)] + [{"job_id": "x", "n": "many"}])})
    _, failures = drift.consistent_table(lines)
    assert [(r.field_name, r.n_failed, r.example) for r in failures.collect()] == [("n", 1, "many")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "items_full.jsonl").write_text('{"a": 1}\n\n{"a": 2} x\n{"a": 3}\n')
    (tmp_path / "items_pilot1.jsonl").write_text('{"a": 9}\n')
    df = readers.read_jsonl(spark, str(tmp_path / "items_full.jsonl"), "a int")
    assert [r.a for r in df.orderBy("ord").collect()] == [1, None, 3]
    assert readers.read_jsonl_tolerant(spark, str(tmp_path / "items_full.jsonl"), "a int").count() == 2
    assert {r.run for r in readers.read_runs(spark, str(tmp_path / "items_*.jsonl")).collect()} == {"full"}
    (tmp_path / "t.csv").write_text('﻿a,b\n1,"x ""y"", z"\n')
    assert [tuple(r) for r in readers.read_csv_text(spark, str(tmp_path / "t.csv")).select("a", "b").collect()] == [("1", 'x "y", z')]
    (tmp_path / "grid.json").write_text('{"s": ["t0", "t1"]}')
    assert readers.topic_grid(spark, str(tmp_path / "grid.json")).count() == 2
    (tmp_path / "rows.json").write_text('[["i1", "A"], ["i2"]]')
    assert sorted(map(tuple, readers.read_positional(spark, str(tmp_path / "rows.json"), ["item", "key"]).collect()), key=str) == [("i1", "A"), ("i2", None)]
    cells = spark.createDataFrame([("['a', 'b']",), ("nope",), (None,)], "t string").select(readers.python_list(F.col("t")).alias("v")).collect()
    assert [c.v for c in cells] == [["a", "b"], None, None]
    sinks.append_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "log"))
    sinks.append_jsonl(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert not sinks.write_csv(spark.createDataFrame([], "a int"), str(tmp_path / "none")) and not (tmp_path / "none").exists()
    assert sinks.manifest(spark, str(tmp_path / "t.csv")).first().n_bytes == (tmp_path / "t.csv").stat().st_size
    report = sinks.Report(["a protected text"])
    with pytest.raises(ValueError):
        report.add("has a protected text inside")
    out = spark.range(1).select(readers.render(F.lit("{{x}} {topic}"), topic=F.lit("gout")).alias("t")).first().t
    assert out == "{x} gout"


def test_text(spark):
    df = spark.createDataFrame([("a‑b  c\r\nd",), (None,)], "t string").select(tx.norm(F.col("t")).alias("n"), tx.shingles(F.col("t")).alias("s")).collect()
    assert [r.n for r in df] == ["a-b c d", ""] and df[0].s == ["a b c", "b c d"] and df[1].s == []


def test_stream(spark, sf_dir, tmp_path):
    from stemwright.plans.items import items
    from stemwright.streaming import flag_stream as fs

    (tmp_path / "in").mkdir()
    source = spark.read.parquet(f"{sf_dir}/items_full.parquet")
    source.write.parquet(str(tmp_path / "in/part"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in/*"))
    query = fs.write_stream(fs.flag_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("job_id").distinct().count() == items(spark, sf_dir).count()


def test_pooled_odds_are_adjusted(spark):
    """Estimates per model equal a direct fit with specialty dummies and topic clusters; a model with an empty cell is reported."""
    from stemwright.plans import model_queries

    rng = np.random.default_rng(8)
    n = 800
    s, t, m = rng.integers(0, 2, n), rng.integers(0, 20, n), rng.integers(0, 2, n)
    g = (rng.random(n) < 0.2 + 0.6 * s).astype(int)
    y = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * s + 0.5 * g))).astype(int)
    rows = [("AB"[a], "xy"[b], f"{b}:{c}", int(d), int(e)) for a, b, c, d, e in zip(m, s, t, g, y)]
    rows += [("C", "xy"[i % 2], f"0:{i}", i % 2, 0) for i in range(20)]
    df = spark.createDataFrame(rows, "model_label string, specialty string, topic string, guided int, any_flaw int")
    found = {r[0]: r[1:] for r in model_queries._adjusted_odds(df)}
    assert found["C"] == ("a prompt with no flaw or flaws only", None, None, None, None, None)
    for i, label in enumerate("AB"):
        at = m == i
        X, c = np.column_stack([np.ones(at.sum()), g[at], s[at]]).astype(float), (s * 20 + t)[at]
        b = np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-X @ b))
            b = b + np.linalg.solve(X.T @ (X * (mu * (1 - mu))[:, None]), X.T @ (y[at] - mu))
        bread = np.linalg.inv(X.T @ (X * (mu * (1 - mu))[:, None]))
        u = np.stack([(X * (y[at] - mu)[:, None])[c == k].sum(axis=0) for k in np.unique(c)])
        k, r = len(u), len(X)
        cov = k / (k - 1) * (r - 1) / (r - 3) * bread @ u.T @ u @ bread
        assert found[label][1] == pytest.approx(b[1], abs=1e-5) and found[label][2] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-5)


def test_psychometrics_are_adjusted(spark):
    """The flag's coefficient is that of the whole design, and the number of cueing flaws is a regressor."""
    from stemwright.operators.detector import CUEING, RULES
    from stemwright.plans import model_queries

    rng = np.random.default_rng(4)
    n, flag = 200, CUEING[0]
    f, kind, exam, words = (rng.random(n) < 0.4).astype(int), rng.integers(0, 2, n), rng.integers(0, 3, n), rng.integers(20, 200, n)
    f = np.where(kind == 1, 1 - (rng.random(n) < 0.2), f).astype(int)
    y = 0.5 * f + 2.0 * kind + 0.3 * exam + np.log(words) + rng.normal(size=n)
    names = [*RULES, "cueing"]
    rows = [(*[int(a) if r in (flag, "cueing") else 0 for r in names], int(a), float(np.log(w)), "ab"[k], "xyz"[e], float(v), float(v)) for a, k, e, w, v in zip(f, kind, exam, words, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in names) + ", n_cueing int, log_stem_words double, itemtype string, exam string, difficulty double, log_time double")
    found = {(r.outcome, r.term): r.coef for r in model_queries._psychometrics_ols(spark, df).collect()}
    X = np.column_stack([np.ones(n), f, np.log(words), kind == 1, exam == 1, exam == 2]).astype(float)
    wanted = np.linalg.lstsq(X, y, rcond=None)[0][1]
    for term in (flag, "n_cueing"):
        assert found["difficulty", term] == pytest.approx(wanted, abs=1e-6)


def test_exact_tails_of_large_counts():
    assert exact.binomial_cdf(3, 10, 0.3) == pytest.approx(0.6496107184) and exact.binomial_cdf(10, 10, 0.3) == 1 and exact.binomial_cdf(-1, 10, 0.3) == 0
    low, high = exact.clopper_pearson(3000, 6000)
    assert low == pytest.approx(0.48727, abs=1e-4) and high == pytest.approx(0.51273, abs=1e-4)
    assert 0.5 < exact.mcnemar_exact(2980, 3020) < 0.7 and exact.sign_test(0, 6000) == pytest.approx(0, abs=1e-12)
    assert exact.t_two_sided(2.2281, 10) == pytest.approx(0.05, abs=1e-4) and exact.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-5)
    assert exact.item_bootstrap(lambda x: float(x.mean()), [1.0] * 20) == (1.0, 1.0) and math.isnan(exact.item_bootstrap(lambda x: 0.0, [])[0])


def test_repeated_keys_and_trailing_text(spark, tmp_path):
    from stemwright.sources import readers

    lines = ['{"a":"1","a":"2"}', '{"a":"3"} x', '{"a":"4"}],[{"a":"5"}', '[{"a":"6"}]', '{"a":{"b":[{"c":1}]}}', "null"]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    rows = readers.read_jsonl_tolerant(spark, str(tmp_path / "x.jsonl"), "a string").collect()
    assert [r.a for r in rows] == ["2", '{"b":[{"c":1}]}']


def test_clusters_need_a_shared_folder():
    from types import SimpleNamespace

    from stemwright import session

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError):
        session.shared_dir(far)


def test_lead_in_and_letter_mentions(spark):
    from stemwright.functions import text as tx

    stems = {"A man coughs. Which is best? He waits.": True, "The diagnosis is": True, "The diagnosis is:": True, "He coughs. Select one.": True, "He coughs. He waits.": False, "He coughs!": False, "": True}
    rows = spark.createDataFrame(list(stems.items()), "s string, w boolean").select("s", "w", tx.has_lead_in(F.col("s")).alias("g")).collect()
    assert [(r.s, r.w) for r in rows if r.w != r.g] == []
    said = {"answer B is right": ["B"], "option: c": ["C"], "(d) and (D)": ["D"], "choice(A": ["A"], "the answer is E": ["E"], "a fine one": []}
    rows = spark.createDataFrame(list(said.items()), "s string, w array<string>").select("s", "w", tx.letter_mentions(F.col("s")).alias("g")).collect()
    assert [(r.s, r.g) for r in rows if r.w != r.g] == []
