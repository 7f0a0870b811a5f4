"""Regressions from distributed sums: only p x p matrices reach the driver, never rows.

Each pass adds X'WX and X'r (or the outer products of cluster scores) per Arrow batch; the batches are
summed in Spark. Design columns are numeric; categories become 0/1 columns of their sorted levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemwright.operators.exact import normal_tail


def design(df: DataFrame, terms: list[str], categorical: dict[str, str], carry: list[str]) -> tuple[DataFrame, list[str]]:
    """(rows with x0, x1, ... and the carried columns, names): intercept, terms, dummies without the reference level."""
    columns, names = [F.lit(1.0)], ["intercept"]
    for t in terms:
        columns.append(F.col(t).cast("double"))
        names.append(t)
    for c, reference in categorical.items():
        levels = sorted(r[0] for r in df.select(c).distinct().collect() if r[0] is not None)  # levels, not rows
        for level in levels:
            if level != reference:
                columns.append((F.col(c) == level).cast("double"))
                names.append(f"{c}[{level}]")
    return df.select(*carry, *[x.alias(f"x{i}") for i, x in enumerate(columns)]), names


def _summed(df: DataFrame, p: int, parts: Callable[[np.ndarray, pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """Sums of named matrices over all rows; `parts` maps the design of a batch to its share of each."""
    xs = [f"x{i}" for i in range(p)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(batch):
                for name, value in parts(batch[xs].to_numpy(dtype=float), batch).items():
                    totals[name] = totals.get(name, 0) + value
        if totals:
            yield pd.DataFrame(
                [(n, i, float(v)) for n, m in totals.items() for i, v in enumerate(np.ravel(m))], columns=["part", "i", "v"]
            )

    out: dict[str, dict[int, float]] = {}
    for part, i, v in df.mapInPandas(run, "part string, i int, v double").groupBy("part", "i").agg(F.sum("v")).collect():
        out.setdefault(part, {})[i] = v
    return {n: np.array([m[i] for i in range(len(m))]) for n, m in out.items()}


def _table(names: list[str], beta: np.ndarray, cov: np.ndarray) -> list[dict]:
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(cov[i, i]) if cov[i, i] >= 0 else math.nan  # separation in a nuisance dummy
        z = beta[i] / se if se else math.nan
        rows.append(
            {"term": name, "coef": float(beta[i]), "se": se, "z": float(z), "p": 2 * normal_tail(abs(z)) if not math.isnan(z) else math.nan,
             "odds_ratio": math.exp(beta[i]), "lo": math.exp(beta[i] - 1.96 * se), "hi": math.exp(beta[i] + 1.96 * se)}
        )
    return rows


def logit_cluster(df: DataFrame, outcome: str, terms: list[str], categorical: dict[str, str], cluster: str, **control: float) -> list[dict]:
    """Coefficient table of logit_fit()."""
    return _table(*logit_fit(df, outcome, terms, categorical, cluster, **control))


def logit_fit(
    df: DataFrame, outcome: str, terms: list[str], categorical: dict[str, str], cluster: str,
    max_iter: int = 100, tolerance: float = 1e-9, ridge: float = 1e-8,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(names, coefficients, covariance) of a logistic regression with cluster-robust (sandwich) errors.

    Rows with NULL in any column used are left out.
    """
    used = df.select(outcome, cluster, *terms, *categorical).dropna()
    rows, names = design(used, terms, categorical, [outcome, cluster])
    rows = rows.persist()
    try:
        p = len(names)
        beta = np.zeros(p)

        def newton(at: np.ndarray) -> Callable[[np.ndarray, pd.DataFrame], dict[str, np.ndarray]]:
            def parts(x: np.ndarray, batch: pd.DataFrame) -> dict[str, np.ndarray]:
                mu = 1 / (1 + np.exp(-x @ at))
                return {"h": x.T @ (x * (mu * (1 - mu))[:, None]), "g": x.T @ (batch[outcome].to_numpy(dtype=float) - mu)}
            return parts

        for _ in range(max_iter):
            sums = _summed(rows, p, newton(beta))
            step = np.linalg.solve(sums["h"].reshape(p, p) + ridge * np.eye(p), sums["g"])
            beta = beta + step
            if np.abs(step).max() < tolerance:
                break
        bread = np.linalg.inv(_summed(rows, p, newton(beta))["h"].reshape(p, p) + ridge * np.eye(p))
        fixed = beta

        def scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = batch[[f"x{i}" for i in range(p)]].to_numpy(dtype=float)
                    r = batch[outcome].to_numpy(dtype=float) - 1 / (1 + np.exp(-x @ fixed))
                    per = pd.DataFrame(x * r[:, None], columns=[f"x{i}" for i in range(p)]).groupby(batch[cluster].to_numpy()).sum()
                    yield per.rename_axis("c").reset_index().assign(n=len(batch) / max(1, len(per)))

        kind = dict(rows.dtypes)[cluster]
        fields = ", ".join(f"x{i} double" for i in range(p))
        by = rows.mapInPandas(scores, f"c {kind}, {fields}, n double").groupBy("c").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(p)], F.sum("n").alias("n"))
        meat = _summed(by, p, lambda x, batch: {"m": x.T @ x, "g": np.array([len(batch)]), "n": np.array([batch["n"].sum()])})
        g, n = float(meat["g"][0]), round(float(meat["n"][0]))
        small = (g / (g - 1)) * ((n - 1) / (n - p)) if g > 1 and n > p else math.nan
        return names, beta, small * bread @ meat["m"].reshape(p, p) @ bread
    finally:
        rows.unpersist()


def ols_robust(df: DataFrame, outcome: str, terms: list[str], categorical: dict[str, str]) -> tuple[list[dict], float]:
    """(coefficients with HC1 errors, R2) of a linear regression; rows with NULL in any column used are left out."""
    rows, names = design(df.select(outcome, *terms, *categorical).dropna(), terms, categorical, [outcome])
    p = len(names)

    def first(x: np.ndarray, batch: pd.DataFrame) -> dict[str, np.ndarray]:
        y = batch[outcome].to_numpy(dtype=float)
        return {"xx": x.T @ x, "xy": x.T @ y, "n": np.array([len(y), y.sum(), (y * y).sum()])}

    sums = _summed(rows, p, first)
    if not sums:
        return [], math.nan
    n, total, squares = sums["n"]
    inverse = np.linalg.inv(sums["xx"].reshape(p, p))
    beta = inverse @ sums["xy"]

    def second(x: np.ndarray, batch: pd.DataFrame) -> dict[str, np.ndarray]:
        e = batch[outcome].to_numpy(dtype=float) - x @ beta
        return {"m": x.T @ (x * (e * e)[:, None]), "e": np.array([e.sum(), (e * e).sum()])}

    rest = _summed(rows, p, second)
    cov = n / (n - p) * inverse @ rest["m"].reshape(p, p) @ inverse
    spread = squares / n - (total / n) ** 2
    r2 = 1 - (rest["e"][1] / n - (rest["e"][0] / n) ** 2) / spread if spread > 0 else math.nan
    out = []
    for i, name in enumerate(names):
        se = math.sqrt(max(0.0, cov[i, i]))
        t = beta[i] / se if se else math.nan
        out.append({"term": name, "coef": float(beta[i]), "se": se, "t": float(t), "p": 2 * normal_tail(abs(t)) if se else math.nan,
                    "lo": float(beta[i] - 1.96 * se), "hi": float(beta[i] + 1.96 * se)})
    return out, float(r2)


def deviation_contrasts(coefficients: np.ndarray, cov: np.ndarray, levels: list[str]) -> list[dict]:
    """Effects against the mean of all levels from reference-coded coefficients (the first level is the reference)."""
    k = len(levels)
    full = np.vstack([np.zeros(k - 1), np.eye(k - 1)])
    centred = full - full.mean(axis=0)
    beta, spread = centred @ coefficients, centred @ cov @ centred.T
    return [{"level": lv, "effect": float(b), "se": math.sqrt(max(0.0, spread[i, i]))} for i, (lv, b) in enumerate(zip(levels, beta))]
