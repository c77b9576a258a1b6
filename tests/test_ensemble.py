"""Risk ensemble against a pandas brute force on a small fixture."""

import hashlib

import pandas as pd
from pyspark.sql import functions as F

from riskframe.plans import ensemble


def _brute(pdf, holdout=0.1, seed=42):
    pdf = pdf.copy()
    pdf["h"] = [hashlib.md5(f"{seed}:holdout:{k}".encode()).hexdigest() for k in pdf.id]
    pdf = pdf.sort_values(["h", "id"]).reset_index(drop=True)
    n_hold = int(len(pdf) * holdout + 0.5)
    hold, core = pdf.iloc[:n_hold], pdf.iloc[n_hold:]

    def best(y, s, cands):
        scores = []
        for j, t in enumerate(cands):
            p = s > t
            tp, fp, fn = int((p & (y == 1)).sum()), int((p & (y == 0)).sum()), int((~p & (y == 1)).sum())
            f1 = 2 * tp / (2 * tp + fp + fn) if (2 * tp + fp + fn) else 0.0
            scores.append((-f1, j, t))
        return min(scores)[2]

    t1 = best(core.y1, core.a, [0.2, 0.5, 0.8])
    t2 = best(core.y2, core.b, [0.3, 0.6])
    score = (hold.a > t1).astype(int) + (hold.b > t2).astype(int)
    out = pd.DataFrame({"score": score, "risk": hold.r})
    return {int(k): (int(g.risk.sum()), len(g)) for k, g in out.groupby("score")}


def test_risk_ensemble_bruteforce(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"id": range(n), "a": rng.random(n), "b": rng.random(n)})
    pdf["y1"] = (pdf.a + rng.normal(0, 0.3, n) > 0.6).astype(int)
    pdf["y2"] = (pdf.b + rng.normal(0, 0.3, n) > 0.5).astype(int)
    pdf["r"] = (rng.random(n) < 0.3).astype(int)
    df = spark.createDataFrame(pdf)
    labs = [ensemble.Labeller("one", F.col("y1"), ensemble.ThresholdRule(F.col("a"), [0.2, 0.5, 0.8])),
            ensemble.Labeller("two", F.col("y2"), ensemble.ThresholdRule(F.col("b"), [0.3, 0.6]))]
    got = ensemble.risk_ensemble(df, ["id"], labs, {"r": F.col("r")}, 0.1).collect()
    assert {r.score: (r.risk, r.total) for r in got} == _brute(pdf)
