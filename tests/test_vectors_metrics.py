import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.functions import vectors as V
from pitlog.models import transitions as T
from pitlog.plans import blending as B
from pitlog.plans import metrics as M


def one(spark, values, expr):
    df = spark.createDataFrame([(values,)], "v array<double>")
    return df.select(expr(F.col("v")).alias("r")).first()["r"]


def test_vector_basics(spark):
    v = [0.1, 0.4, 0.4, 0.1]
    assert one(spark, v, V.argmax) == 1
    assert one(spark, v, lambda c: V.top_k(c, 3)) == [2, 1, 3]
    assert one(spark, v, lambda c: V.pad(c, 6)) == v + [0.0, 0.0]
    assert one(spark, v, lambda c: V.pad(c, 3)) == v
    soft = one(spark, [1000.0, 1001.0], V.softmax)
    assert soft == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    zeros = one(spark, [1.0, 0.0], V.entropy)
    assert zeros == pytest.approx(0.0, abs=1e-8)
    assert one(spark, v, lambda c: V.at(c, F.lit(9))) is None


def test_stage_combination(spark):
    df = spark.createDataFrame(
        [([0.5, 0.3, 0.2], [0.5] + [0.1] * 5 + [0.0]), ([0.3, 0.5, 0.2], [0.5] + [0.1] * 5 + [0.0]),
         ([0.6, 0.2, 0.2], None)],
        "s array<double>, b array<double>",
    )
    got = [r["o"] for r in df.select(V.combine_stages(F.col("s"), F.col("b")).alias("o")).collect()]
    assert got[0] == pytest.approx([0.25] + [0.05] * 5 + [0.0, 0.3, 0.2])
    assert got[1] == pytest.approx([0.0] * 7 + [0.5, 0.2])
    assert got[2] == pytest.approx([0.0] * 7 + [0.2, 0.2])
    runs = df.select(V.expected_run_value(V.combine_stages(F.col("s"), F.col("b"))).alias("r")).collect()
    want = sum(p * S.RUN_VALUE[c] for p, c in zip(got[0], S.OUTCOME_CLASSES))
    assert runs[0]["r"] == pytest.approx(want)


def test_grid_has_all_combinations():
    grid = B.tenths_grid(3)
    assert len(grid) == 36 and len(set(grid)) == 36
    assert all(round(sum(w) * 10) == 10 for w in grid)


def scored_frame(spark, n=300, k=4, seed=2):
    rng = np.random.default_rng(seed)
    p = rng.integers(1, 6, size=(n, k)).astype(float)
    p /= p.sum(axis=1, keepdims=True)
    y = rng.integers(0, k, size=n)
    rows = [(i, int(y[i]), [float(x) for x in p[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, y int, probs array<double>"), y, p


def test_metrics_against_numpy(spark):
    df, y, p = scored_frame(spark)
    got = {r["metric"]: r["value"] for r in M.classification_metrics(df).collect()}
    assert got["accuracy"] == pytest.approx((p.argmax(axis=1) == y).mean())
    assert got["log_loss"] == pytest.approx(-np.log(p[np.arange(len(y)), y]).mean())
    top3 = np.argsort(p, axis=1, kind="stable")[:, -3:]
    assert got["top3_accuracy"] == pytest.approx(np.mean([y[i] in top3[i] for i in range(len(y))]))
    aucs = {r["class_id"]: r["auc"] for r in M.one_vs_rest_auc(df, 4).collect()}
    for c in range(4):
        pos, neg = p[y == c, c], p[y != c, c]
        wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
        assert aucs[c] == pytest.approx(wins / (len(pos) * len(neg)))


def test_auc_of_absent_class_is_null(spark):
    df = spark.createDataFrame([(0, [0.7, 0.3]), (0, [0.6, 0.4])], "y int, probs array<double>")
    assert {r["auc"] for r in M.one_vs_rest_auc(df, 2).collect()} == {None}


def test_per_class_handles_missing_sides(spark):
    matrix = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (2, 0, 2)], "y int, pred int, n long")
    got = {r["class"]: r for r in M.per_class(matrix, ["a", "b", "c"]).collect()}
    assert got["a"]["recall"] == 0.75 and got["a"]["precision"] == 0.6
    assert got["b"]["support"] == 0 and got["b"]["precision"] == 0.0 and got["b"]["recall"] is None
    assert got["c"]["recall"] == 0.0 and got["c"]["precision"] is None


def test_weight_search_joins_by_key_and_pads(spark):
    df, y, p = scored_frame(spark)
    short = df.select("id", F.slice("probs", 1, 3).alias("probs")).repartition(5)
    both = B.join_members([df.select("id", "probs"), short], ["id"], 4).join(df.select("id", "y"), "id")
    got = {r["combo"]: r["log_loss"] for r in B.score_weights(both, ["p0", "p1"], "y", B.SEQUENCE_WEIGHTS).collect()}
    q = p.copy()
    q[:, 3] = 0
    rows = np.arange(len(y))
    for i, (a, b) in enumerate(B.SEQUENCE_WEIGHTS):
        assert got[i] == pytest.approx(-np.log((a * p + b * q)[rows, y]).mean())


def test_regression_and_baselines(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (None, 1.0), (5.0, None)], "a double, b double")
    got = {r["metric"]: r["value"] for r in M.regression_metrics(df, "a", "b").collect()}
    assert got["rmse"] == pytest.approx(math.sqrt(0.5)) and got["mae"] == 0.5
    assert got["r2"] == pytest.approx(1 - 1 / 2)
    labels = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "t string")
    base = {r["metric"]: r["value"] for r in M.baselines(labels, "t").collect()}
    assert base == {"random_guess": 0.5, "largest_class": 2 / 3}


def test_transitions_back_off(spark):
    train = spark.createDataFrame(
        [("FF", "SL"), ("FF", "SL"), ("FF", "FF"), ("SL", "FF")], "prev string, pitch_type_can string"
    )
    contexts, classes = [[], ["prev"]], ["FF", "SL"]
    tables = T.transition_tables(train, contexts, classes=classes)
    rows = spark.createDataFrame([("FF",), ("unseen",)], "prev string")
    got = {r["prev"]: r["probs"] for r in T.transition_probabilities(rows, tables, contexts, 2).collect()}
    prior = (2 + 0.5) / 5
    assert got["unseen"] == pytest.approx([prior, 1 - prior])
    assert got["FF"] == pytest.approx([(1 + prior) / 4, (2 + 1 - prior) / 4])


def test_residual_keeps_base_below_the_minimum(spark):
    train = spark.createDataFrame(
        [(1, "0_0", "FF", "SL")] * 4 + [(2, "0_0", "FF", "SL")],
        "pitcher long, count_state string, prev_pitch_1 string, pitch_type_can string",
    )
    rows = spark.createDataFrame(
        [(1, "0_0", "FF", [0.5, 0.5]), (2, "0_0", "FF", [0.5, 0.5]), (1, "3_2", "FF", [0.5, 0.5])],
        "pitcher long, count_state string, prev_pitch_1 string, base array<double>",
    )
    out = T.residual_mix(rows, train, "base", classes=["FF", "SL"], minimum=4)
    got = {(r["pitcher"], r["count_state"]): r["mixed"] for r in out.collect()}
    assert got[(2, "0_0")] == [0.5, 0.5] and got[(1, "3_2")] == [0.5, 0.5]
    assert got[(1, "0_0")] == pytest.approx([0.85 * 0.5 + 0.15 * 0.1, 0.85 * 0.5 + 0.15 * 0.9])
