"""Cross-fitting, multiclass boosting, per-entity fits, context tree."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from pitlog import schema as S
from pitlog.catalog.model_queries import _features
from pitlog.functions import vectors as V
from pitlog.models import boosting as B
from pitlog.models import context_tree as C
from pitlog.models import entity_fits as E
from pitlog.models import heads as H
from pitlog.models import registry as R
from pitlog.operators.lineage import Succession, shared_folder
from pitlog.operators.splits import day_blocks
from pitlog.plans import metrics as M
from pitlog.plans import stacking as ST

SF = "/root/testdata/sf0.001"


# --- blocks and cross-fitting ------------------------------------------------------------


def labelled_days(spark, n=1500, seed=4, shuffled=False):
    """Rows of 50 days whose class follows ``x``; with ``shuffled`` the label is random."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, z = r.random(), r.random()
        true = "abc"[min(2, int(3 * x))] if r.random() < 0.9 else r.choice("abc")
        rows.append((i, f"2024-03-{1 + i * 30 // n:02d}", x, z, true, r.choice("abc") if shuffled else true))
    return spark.createDataFrame(rows, "i long, d string, x double, z double, truth string, c string").withColumn(
        "game_date", F.to_date("d")
    )


def test_blocks_keep_days_whole_and_in_order(spark):
    rows = [(f"2024-01-{d:02d}", d) for d in range(1, 21) for _ in range(d)] + [(None, 0)] * 7
    df = spark.createDataFrame(rows, "d string, n long").withColumn("game_date", F.to_date("d"))
    got = df.withColumn("b", day_blocks(df, 4)).groupBy("game_date").agg(
        F.min("b").alias("lo"), F.max("b").alias("hi"), F.count("*").alias("n")
    )
    days = sorted(got.collect(), key=lambda r: str(r.game_date or ""))
    assert all(r.lo == r.hi for r in days)
    upto, total = 0, len(rows)
    for r in days:
        assert r.lo == 4 * upto // total
        upto += r.n
    hot = spark.createDataFrame([("2024-01-01",)] * 90 + [("2024-01-02",)] * 10, "d string")
    hot = hot.withColumn("game_date", F.to_date("d"))
    # One day with most rows: the blocks it covers stay empty.
    assert {r[0] for r in hot.select(day_blocks(hot, 5)).distinct().collect()} == {0, 4}


def fit_on(label):
    def fit(train):
        return H.ClassHead("abc", label, H.FeatureSet([], ["x", "z"])).fit(train)

    return fit


def test_no_row_is_scored_by_a_head_that_saw_it(spark):
    seen = []

    class Head:
        classes = "abc"

        def __init__(self, train):
            seen.append({r.i for r in train.select("i").collect()})
            self.rows = seen[-1]

        def score_onto(self, df, name):
            inside = F.col("i").isin([F.lit(i) for i in sorted(self.rows)])
            return df.withColumn(name, F.array(F.when(inside, 1.0).otherwise(0.0)))

    table = ST.blocked(labelled_days(spark, 200), 4)
    out = ST.score_forward(table, ST.fit_forward(table, Head, 4), {"p": lambda p: p}).collect()
    assert len(out) == 200 and len(seen) == 3
    assert all((r.p is None) == (r.block == 0) for r in out)
    assert not any(r.p[0] for r in out if r.p)
    # What a head saw lies wholly before what it scores.
    order = {r.i: r.block for r in out}
    assert [max(order[i] for i in rows) for rows in seen] == [0, 1, 2]


def signal(df, label, p):
    """How often the most likely class is the true one."""
    hit = F.element_at(F.array(*[F.lit(c) for c in "abc"]), V.argmax(F.col(p)) + 1) == F.col(label)
    return df.where(F.col(p).isNotNull()).agg(F.avg(hit.cast("int"))).first()[0]


def test_shuffled_labels_give_stacked_features_without_signal(spark):
    table = ST.blocked(labelled_days(spark, shuffled=True), 5)
    out = ST.score_forward(table, ST.fit_forward(table, fit_on("c")), {"p": lambda p: p})
    assert signal(out, "c", "p") < 0.40
    inside = fit_on("c")(table).score_onto(table, "p")
    assert signal(inside, "c", "p") > 0.45  # what cross-fitting avoids
    real = ST.blocked(labelled_days(spark), 5)
    out = ST.score_forward(real, ST.fit_forward(real, fit_on("c")), {"p": lambda p: p})
    assert signal(out, "c", "p") > 0.8


def test_stacked_columns_and_reports(spark):
    table = ST.blocked(labelled_days(spark, 600).withColumn("y", F.instr(F.lit("abc"), "c") - 1), 4)
    out = ST.stacked(table, fit_on("c"), "abc", "P_", {"AB": ("a", "b")}, 4)
    row = out.where("block = 3").first()
    assert row["P_AB_GROUP"] == pytest.approx(row["P_a"] + row["P_b"])
    assert out.where("block = 0 AND (P_a IS NOT NULL OR P_MAX IS NOT NULL)").isEmpty()
    assert out.count() == 600
    blend, weights = ST.blended_members(table.drop("y").withColumn("y", (F.instr(F.lit("abc"), F.col("c")) - 1)),
                                        {"one": fit_on("c"), "two": fit_on("c")}, "y", "abc", 4)
    assert sum(weights) == pytest.approx(1.0)
    totals = blend.where("probs IS NOT NULL").select(V.total(F.col("probs")).alias("s"))
    assert totals.agg(F.min("s")).first()[0] == pytest.approx(1.0)
    report = {(r.model, r.metric): r.value for r in
              ST.against_prior(blend.where("block < 3"), blend.where("block = 3"), 3, "m").collect()}
    assert report["m", "log_loss"] < report["m_prior", "log_loss"]


# --- boosting ------------------------------------------------------------------------------


def boost_rows(spark, n=2500, seed=7, noise=0.1, held=True):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.random(), r.random(), r.random()
        y = (0 if a < 0.5 else 1) if b < 0.6 else 2
        rows.append((a, b, c, float(r.randrange(3) if r.random() < noise else y), 1.0 + i % 2, i % 4 == 0))
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, w double, held_out boolean")
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    return df if held else df.drop("held_out")


def test_targets_are_newton_steps_of_the_softmax_loss(spark):
    r = np.random.default_rng(1)
    rows = [([float(v) for v in r.normal(size=4) * 3], int(r.integers(4)), float(r.random())) for _ in range(50)]
    df = spark.createDataFrame(rows, "s array<double>, y int, w double")
    got = df.select("*", B.newton_targets(F.col("s"), F.col("y"), F.col("w")).alias("t")).collect()
    for row in got:
        p = np.exp(np.array(row.s) - max(row.s))
        p /= p.sum()
        for k, t in enumerate(row.t):
            curve = max(p[k] * (1 - p[k]), 1e-6)
            assert t.weight == pytest.approx(row.w * curve)
            assert t.step == pytest.approx(np.clip(((row.y == k) - p[k]) / curve, -4, 4))
        # The gradient is the slope of the loss itself.
        loss = lambda s: -math.log(np.exp(s[row.y]) / np.exp(s).sum())  # noqa: B023,E731
        for k in range(4):
            up, down = np.array(row.s), np.array(row.s)
            up[k] += 1e-5
            down[k] -= 1e-5
            assert (loss(down) - loss(up)) / 2e-5 == pytest.approx((row.y == k) - p[k], abs=1e-6)


def test_boosting_stops_by_itself_and_beats_the_prior(spark):
    rows = boost_rows(spark)
    model = B.MulticlassBooster(3, rounds=60, depth=3, rate=0.5, patience=3).fit(rows)
    assert 0 < model.rounds < 60 and len(model.losses) < 61
    assert model.losses[model.rounds] == min(model.losses) < 0.6 * model.losses[0]
    out = model.transform(rows.where("held_out")).withColumn("y", F.col("label").cast("int"))
    report = {r.metric: r.value for r in M.classification_metrics(out, "y", "probability").collect()}
    assert report["accuracy"] > 0.85
    # The ensemble of the kept rounds scores as the state of the loop did.
    loss = out.agg(F.sum(V.log_loss_of(V.at(F.col("probability"), F.col("y"))) * F.col("w")) / F.sum("w")).first()[0]
    assert loss == pytest.approx(model.losses[model.rounds], rel=1e-6)
    assert model.importances[0] > model.importances[2] and model.importances[1] > model.importances[2]


def test_boosting_noise_keeps_the_prior(spark):
    rows = boost_rows(spark, 800, noise=1.0)
    model = B.MulticlassBooster(3, rounds=30, depth=4, rate=0.8, patience=2).fit(rows)
    assert model.rounds <= 2
    none = B.MulticlassBooster(3, rounds=0).fit(rows)
    probs = none.transform(rows).select("probability").first()[0]
    assert none.rounds == 0 and sum(probs) == pytest.approx(1.0)


def test_boosted_head_saves_loads_and_blends(spark, tmp_path):
    df = labelled_days(spark, 800).withColumn("held", F.col("i") % 5 == 0).withColumn("w", F.lit(1.0))
    head = H.boosted_head(df, "c", "abc", H.FeatureSet([], ["x", "z"]), "w", "held", rounds=6, depth=3)
    linear = H.ClassHead("abc", "c", H.FeatureSet(["d"], ["x"], one_hot=True), H.ensemble_members(3)["linear"], "w").fit(df)
    root = str(tmp_path / "models")
    R.save_checkpoint(spark, root, {"boosted": head, "linear": linear}, 5, {"boosted": 0.75, "linear": 0.25})
    loaded = R.load_newest(spark, root)
    assert {n: w for n, (_, w) in loaded.items()} == {"boosted": 0.75, "linear": 0.25}
    for name, member in (("boosted", head), ("linear", linear)):
        want = [r.probs for r in member.score(df, ["i"]).orderBy("i").limit(20).collect()]
        got = [r.probs for r in loaded[name][0].score(df, ["i"]).orderBy("i").limit(20).collect()]
        for a, b in zip(got, want):
            assert a == pytest.approx(b)
    # New rows lack the label and an input.
    fresh = R.score_newest(df.select("i", "x"), root)
    assert fresh.select(V.total(F.col("probs")).alias("s")).agg(F.max("s")).first()[0] == pytest.approx(1.0)
    assert H.importances(head).first()["feature"] == "x"


def test_state_of_the_loop_does_not_pile_up(spark):
    state = Succession("pile")
    table = state.put(spark.range(3))
    for _ in range(4):
        table = state.put(table.select((F.col("id") + 1).alias("id")))
    assert sorted(r.id for r in table.collect()) == [4, 5, 6] and len(state.paths) == 2
    state.clear()
    import os

    assert not [p for p in os.listdir(shared_folder(spark)) if p.startswith("pile-")]


# --- per-entity fits ------------------------------------------------------------------------


def entity_rows(spark, n=2400, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # Entity 0 has a third of all rows; entity 9 has too few for a fit.
        e = 0 if i % 3 == 0 else 9 if i < 5 else 1 + r.randrange(6)
        x = r.gauss(0, 1)
        logits = [0.2 * e * x, 0.0, (e % 3 - 1) * x + 0.5]
        y = r.choices(range(3), [math.exp(v) for v in logits])[0]
        rows.append((e, x, y, [0.3, 0.4, 0.3], 2 * x + e + r.gauss(0, 0.1), x * x))
    return rows, spark.createDataFrame(rows, "e long, x double, y int, base array<double>, t double, u double")


def inputs():
    return [F.lit(1.0), F.col("x")]


def test_ridge_equals_each_entitys_own_fit(spark):
    rows, df = entity_rows(spark)
    fitted = E.ridge(df, "e", inputs(), [F.col("t"), F.col("u")], penalty=2.0, minimum=10)
    got = {r.e: np.array(r.beta) for r in fitted.collect()}
    assert 9 not in got and len(got) == 7
    for e, beta in got.items():
        x = np.array([[1.0, r[1]] for r in rows if r[0] == e])
        t = np.array([[r[4], r[5]] for r in rows if r[0] == e])
        assert beta == pytest.approx(np.linalg.solve(x.T @ x + 2 * np.eye(2), x.T @ t))
    out = E.apply_ridge(df, fitted, "e", inputs(), "p").collect()
    for r in out:
        want = None if r.e not in got else [1, r.x] @ got[r.e]
        assert r.p is None if want is None else r.p == pytest.approx(list(want))


def test_solve_inverts(spark):
    r = np.random.default_rng(2)
    a = r.normal(size=(6, 6))
    a = a @ a.T + np.eye(6)
    df = spark.createDataFrame([(a.tolist(),)], "a array<array<double>>")
    got = df.select(E.solve(F.col("a"), E.identity(6), 6).alias("x")).first().x
    assert np.array(got) == pytest.approx(np.linalg.inv(a))


def newton(x, y, base, steps, penalty, k=3):
    """The same bounded steps for one entity's rows; and the optimum if there are many."""
    beta = np.zeros((k, x.shape[1]))
    inverse = np.linalg.inv(0.5 * x.T @ x + penalty * np.eye(x.shape[1]))
    hot = np.eye(k)[y]
    for _ in range(steps):
        z = np.log(base) + x @ beta.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        beta = beta + ((hot - p).T @ x - penalty * beta) @ inverse
    return beta, (hot - p).T @ x - penalty * beta


def test_residual_fits_equal_each_entitys_own_fit(spark):
    rows, df = entity_rows(spark)
    fitted = E.residual_logits(df, "e", inputs(), "y", "base", 3, penalty=1.0, steps=6, minimum=10)
    got = {r.e: np.array(r.beta) for r in fitted.collect()}
    assert sorted(got) == list(range(7))
    for e, beta in got.items():
        own = [r for r in rows if r[0] == e]
        x, y = np.array([[1.0, r[1]] for r in own]), np.array([r[2] for r in own])
        assert beta == pytest.approx(newton(x, y, np.array([r[3] for r in own]), 6, 1.0)[0])
        best, slope = newton(x, y, np.array([r[3] for r in own]), 400, 1.0)
        assert abs(slope).max() < 1e-6  # many steps reach the optimum


def test_residuals_help_on_later_rows_and_spare_others(spark):
    _, train = entity_rows(spark, seed=3)
    _, later = entity_rows(spark, seed=5)
    fitted = E.residual_logits(train, "e", inputs(), "y", "base", 3, minimum=10)
    out = E.residual_mixture(later, fitted, "e", inputs(), "base", share=1.0)
    loss = lambda p: M.classification_metrics(out, "y", p).where("metric = 'log_loss'").first()["value"]
    assert loss("mixed") < loss("base") - 0.02
    assert {tuple(r.mixed) for r in out.where("e = 9").collect()} == {(0.3, 0.4, 0.3)}
    assert out.select(V.total(F.col("mixed")).alias("s")).agg(F.max("s")).first()[0] == pytest.approx(1.0)


# --- context tree -----------------------------------------------------------------------------


def chain(seed=3, n=4000):
    """The class follows the one before the last; the last one and ``z`` do not matter."""
    r = random.Random(seed)
    rows, one, two = [], "A", "A"
    for i in range(n):
        c = r.choices("ABC", {"A": [8, 1, 1], "B": [1, 8, 1], "C": [1, 1, 8]}[two])[0]
        rows.append((i, two, one, r.choice("xyzuvw"), c))
        one, two = c, one
    return rows


def test_counts_escape_and_probabilities(spark):
    rows = chain(n=600)
    df = spark.createDataFrame(rows, "i long, p2 string, p1 string, z string, c string")
    tree = C.fit(df, ["p2", "p1"], "c", "ABC")
    got = {(r.depth, r.p2, r.p1): r for r in tree.table.collect()}

    def probs(context):
        match = [r for r in rows if r[1 : 1 + len(context)] == context]
        counts = [sum(r[4] == c for r in match) for c in "ABC"]
        parent = probs(context[:-1])[0] if context else [1 / 3] * 3
        seen, n = sum(c > 0 for c in counts), sum(counts)
        return [(c + seen * p) / (n + seen) for c, p in zip(counts, parent)], counts, seen / (n + seen)

    assert len(got) == 1 + 3 + 9
    for (d, a, b), row in got.items():
        want, counts, esc = probs(tuple(x for x in (a, b) if x is not None))
        assert row.counts == counts and row.escape == pytest.approx(esc) and row.kept
        assert row.probs == pytest.approx(want) and sum(row.probs) == pytest.approx(1.0)


def test_held_out_rows_prune_what_does_not_help(spark):
    rows = chain()
    df = spark.createDataFrame(rows, "i long, p2 string, p1 string, z string, c string")
    tree = C.fit(df, ["p2", "z", "p1"], "c", "ABC", held=F.col("i") >= 3000)
    kept = {r.depth: r.n for r in tree.table.where("kept").groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert kept[1] == 3 and sum(kept.get(d, 0) for d in (2, 3)) < 20
    # Contexts below one that went are gone, and gains are those of whole subtrees.
    table = tree.table.collect()
    at = {(r.depth, r.p2, r.z, r.p1): r for r in table}
    for r in table:
        if r.depth == 2 and r.kept:
            assert at[1, r.p2, None, None].kept
        if r.depth == 1:
            below = sum(max(0.0, s.gain) for s in table if s.depth == 2 and s.p2 == r.p2)
            own = sum(h * (math.log(p) - math.log(q)) for h, p, q in
                      zip(r.held, r.probs, at[0, None, None, None].probs) if h)
            assert r.gain == pytest.approx(own + below)
    out = tree.predict(df.where("i >= 3000"))
    right = F.element_at(F.array(*[F.lit(c) for c in "ABC"]), V.argmax(F.col("probs")) + 1) == F.col("c")
    assert out.agg(F.avg(right.cast("int"))).first()[0] > 0.7
    # A context that was never seen falls back to the longest known one.
    odd = spark.createDataFrame([("A", "new", "new"), ("new", "x", "A")], "p2 string, z string, p1 string")
    got = {r.p2: r.probs for r in tree.predict(odd).collect()}
    assert got["A"] == pytest.approx(at[1, "A", None, None].probs)
    assert got["new"] == pytest.approx(at[0, None, None, None].probs)


def test_refit_uses_all_rows_and_empty_tables_work(spark):
    rows = chain(n=500)
    df = spark.createDataFrame(rows, "i long, p2 string, p1 string, z string, c string")
    tree = C.fit(df, ["p2"], "c", "ABC", held=F.col("i") >= 400, refit=True)
    root = tree.table.where("depth = 0").first()
    counts = [sum(r[4] == c for r in rows) for c in "ABC"]
    assert root.probs == pytest.approx([(n + 3 / 3) / (500 + 3) for n in counts])
    none = C.fit(df.limit(0), ["p2"], "c", "ABC")
    assert none.predict(df.limit(2)).first().probs == pytest.approx([1 / 3] * 3)


def test_type_ensemble_on_all_safe_features(spark):
    from pitlog.plans import training as T

    table = _features(spark, SF)
    text, numbers = T.model_inputs(table)
    assert {"stand", "prev_pitch_1"} <= set(text) and len(text) + len(numbers) > 90
    report = {(r.model, r.metric): r.value for r in T.boosting_report(table, rounds=2, depth=2).collect()}
    assert report["boosted", "rounds"] <= 2 and ("boosted_prior", "log_loss") in report
    assert len(S.SAFE_FEATURES) >= 97
