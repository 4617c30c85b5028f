"""The loop of the per-entity fits over all rows runs compiled, whatever the length of the base vectors."""

import random

import pytest
from pyspark.sql import functions as F

from pitlog.models import entity_fits as E


def test_entity_steps_run_compiled(spark, monkeypatch):
    plans, step = [], E._step

    def seen(*a):
        out = step(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(E, "_step", seen)
    r = random.Random(5)
    rows = [(i % 3, r.random(), r.randrange(3), [0.2, 0.3, 0.5]) for i in range(90)]
    df = spark.createDataFrame(rows, "e long, x double, y int, base array<double>")
    fitted = E.residual_logits(df, "e", [F.lit(1.0), F.col("x")], "y", "base", 3, steps=2, minimum=10)
    assert fitted.count() == 3 and len(plans) == 2
    # Below the aggregate lies the work on all rows; no lambda may be there.
    assert all("Generate" in p and "lambdafunction" not in p[p.index("Generate") :] for p in plans)


def test_vectors_of_another_length_move_nothing(spark):
    """A base vector that is too short or too long gives no slope, as its softmax is unknown."""
    good = [(1, 1.0, i % 3, [0.2, 0.3, 0.5]) for i in range(30)]
    odd = [(1, 1.0, 0, [0.5, 0.5]), (1, 1.0, 0, [0.1, 0.2, 0.3, 0.4])]
    schema = "e long, x double, y int, base array<double>"

    def fit(rows):
        x = [F.lit(1.0)]
        out = E.residual_logits(spark.createDataFrame(rows, schema), "e", x, "y", "base", 3, steps=1, minimum=10)
        row = out.first()
        return [b[0] * (row["n"] / 2 + 1) for b in row["beta"]]

    assert fit(good + odd) == pytest.approx(fit(good))
