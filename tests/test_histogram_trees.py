"""The trees of a boosting round: MLlib's own, at one pass per level for all classes."""

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from pitlog.models import boosting as B
from pitlog.models import histogram_trees as HT
from pitlog.operators.lineage import Succession

FIRST = [-1.0, -1.1, -1.2]


def class_rows(spark, n=1500, seed=3):
    r = np.random.default_rng(seed)
    a, b, c = r.normal(size=n), r.gamma(2.0, size=n) * (r.random(n) < 0.7), r.choice(list("pqrst"), n)
    y = np.where(a + r.normal(size=n) / 2 > 0.4, 0, np.where((b > 1.5) ^ np.isin(c, ["q", "t"]), 1, 2))
    rows = [(float(u), float(v), str(t), float(k), float(w)) for u, v, t, k, w in zip(a, b, c, y, 0.5 + r.random(n))]
    df = spark.createDataFrame(rows, "a double, b double, c string, label double, w double")
    df = StringIndexer(inputCol="c", outputCol="code", stringOrderType="alphabetAsc").fit(df).transform(df)
    return VectorAssembler(inputCols=["a", "b", "code"], outputCol="features").transform(df)


def test_array_targets_are_the_column_targets(spark):
    r = np.random.default_rng(1)
    scores, y, w = r.normal(size=(40, 4)) * 4, r.integers(0, 4, 40), r.random(40)
    df = spark.createDataFrame([(s.tolist(), int(k), float(v)) for s, k, v in zip(scores, y, w)], "s array<double>, y int, w double")
    want = df.select(B.newton_targets(F.col("s"), F.col("y"), F.col("w")).alias("t")).collect()
    step, weight = HT.targets(scores, y, w)
    for i, row in enumerate(want):
        assert [t.step for t in row.t] == pytest.approx(step[:, i].tolist())
        assert [t.weight for t in row.t] == pytest.approx(weight[:, i].tolist())


def test_trees_are_those_mllib_grows(spark):
    rows = class_rows(spark)
    table = rows.select("features", F.col("label").cast("int").alias("y"), "w", F.lit(False).alias("held_out"))
    arity = HT.arities(rows)
    assert arity == {2: 5}
    x, y, w = HT.bounded_sample(table, rows.count(), HT.LEAST_SAMPLE, 42)
    coding = HT.Coding.of(x, arity)
    scores = np.tile(FIRST, (len(x), 1))
    cuts = coding.cuts(coding.codes(x), HT.targets(scores, y, w)[1], 32)
    trees = HT.grow(HT.start(table, coding, FIRST), coding, cuts, 4, 5)
    target = B.newton_targets(F.array(*[F.lit(f) for f in FIRST]), F.col("y"), F.col("w"))
    for k, tree in enumerate(trees):
        one = table.withColumn("t", target[k]).select("features", F.col("t.step").alias("label"), F.col("t.weight").alias("weight"))
        theirs = DecisionTreeRegressor(maxDepth=4, maxBins=32, minInstancesPerNode=5, weightCol="weight", seed=42).fit(one)
        mine = tree.model(coding)
        assert mine.depth == theirs.depth and mine.numNodes == theirs.numNodes
        assert mine.featureImportances.toArray() == pytest.approx(theirs.featureImportances.toArray())
        both = mine.setPredictionCol("mine").transform(theirs.setPredictionCol("theirs").transform(one))
        assert both.agg(F.max(F.abs(F.col("mine") - F.col("theirs")))).first()[0] < 1e-9
        # Codes route rows as the model routes vectors.
        want = [r.mine for r in mine.transform(one).select("mine").collect()]
        assert tree.steps(coding.codes(x).T).tolist() == pytest.approx(want)


def test_a_round_passes_once_a_level_for_all_classes(spark, monkeypatch):
    passes, best_cuts = [], HT._best_cuts
    monkeypatch.setattr(HT, "_best_cuts", lambda *a: passes.append(a) or best_cuts(*a))
    monkeypatch.setattr(DecisionTreeRegressor, "fit", lambda *a: pytest.fail("a fit per class counts, samples and bins anew"))
    model = B.MulticlassBooster(3, rounds=2, depth=3).fit(class_rows(spark, 600))
    assert model.rounds == 2 and len(passes) == 2 * 3
    assert spark.conf.get(B.SCAN_TASKS, None) is None


def test_more_rows_than_the_sample(spark, monkeypatch):
    monkeypatch.setattr(HT, "LEAST_SAMPLE", 300)
    rows = class_rows(spark, 4000).withColumn("held_out", F.rand(5) < 0.2)
    model = B.MulticlassBooster(3, rounds=15, depth=3, rate=0.4, max_bins=16).fit(rows)
    assert model.losses[-1] < 0.8 * model.losses[0]


def test_rows_to_fit_on_need_finite_inputs(spark):
    df = class_rows(spark, 200).drop("features").withColumn("bad", F.when(F.col("a") > 1.5, float("nan")).otherwise(F.col("a")))
    df = VectorAssembler(inputCols=["bad", "b"], outputCol="features", handleInvalid="keep").transform(df)
    booster = B.MulticlassBooster(3, rounds=1, depth=2)
    with pytest.raises(Exception, match="finite inputs"):
        booster.fit(df.withColumn("held_out", F.lit(False)))
    assert booster.fit(df.withColumn("held_out", F.isnan("bad"))).rounds <= 1


def test_nodes_without_a_cut_are_leaves(spark):
    rows = class_rows(spark, 9)
    model = B.MulticlassBooster(3, rounds=1, depth=3, least_rows=5).fit(rows)
    assert model.rounds == 1 and model.members[0].trees[0].numNodes == 1


def test_inputs_that_cut_the_same_rows_tie(spark):
    rows = class_rows(spark, 700).withColumn("twin", F.col("a") * 3 + 1)
    rows = VectorAssembler(inputCols=["twin", "b", "a"], outputCol="features").transform(rows.drop("features"))
    for parts in (1, 5):
        model = B.MulticlassBooster(3, rounds=2, depth=3).fit(rows.repartition(parts, "b"))
        assert all(m.featureImportances[2] == 0 for m in model.members)


def test_rows_are_written_once_for_the_rounds_of_a_short_fit(spark, monkeypatch):
    puts, put = [], Succession.put
    monkeypatch.setattr(Succession, "put", lambda self, df: puts.append(df) or put(self, df))
    rows = class_rows(spark, 600).withColumn("held_out", F.col("a") > 0.8)
    booster = B.MulticlassBooster(3, rounds=3, depth=2, patience=9)
    once = booster.fit(rows)
    assert len(puts) == 1
    monkeypatch.setattr(HT, "FOLD", 2)
    folded = booster.fit(rows)
    assert len(puts) == 3
    assert len(once.losses) == 4 and folded.losses == pytest.approx(once.losses, rel=1e-12)


def test_of_two_siblings_the_smaller_is_added_up(spark, monkeypatch):
    levels, best_cuts = [], HT._best_cuts
    monkeypatch.setattr(HT, "_best_cuts", lambda *a: levels.append((a[1], a[2])) or best_cuts(*a))
    B.MulticlassBooster(3, rounds=1, depth=3).fit(class_rows(spark, 2000))
    assert len(levels) == 3 and all(len(nodes) == 1 for nodes in levels[0][1].counted)
    trees, last = levels[2]
    for tree, nodes, counted in zip(trees, last.active, last.counted):
        for left, right in zip(nodes[::2], nodes[1::2]):
            few, many = sorted((left, right), key=lambda node: tree.sums[node][0])
            light = tree.sums[many][1] < HT.LEAST_SHARE * (tree.sums[few][1] + tree.sums[many][1])
            assert [n for n in counted if n in (left, right)] == ([few, many] if light else [few])


def test_joint_tables_hold_the_sums_of_each_input():
    r = np.random.default_rng(4)
    bins = [32, 32, 5, 3, 1, 200]
    codes = np.stack([np.where(r.random(3000) < 0.9, b // 2, r.integers(0, b, 3000)) for b in bins]).astype("<u2")
    joints = HT.joint_inputs(codes, bins, 2)
    assert sorted(f for j in joints for f in j.inputs) == list(range(6))
    assert len(joints) < 6 and all(2 * j.cells <= HT.JOINT for j in joints)
    for joint in joints:
        assert joint.usual == [bins[f] // 2 for f in joint.inputs]
        cell = sum(codes[f].astype(int) * s for f, s in zip(joint.inputs, joint.strides))
        table = np.bincount(cell, minlength=joint.cells)[None]
        for f, sums in joint.by_input(table):
            assert sums[0].tolist() == np.bincount(codes[f], minlength=bins[f]).tolist()


def test_what_is_left_of_weights_is_not_rounding():
    whole, part = np.array([[3.0, 0.3, 1.0, 1.0]]), np.array([[2.0, 0.1 + 0.2, 1.0, 1.0]])
    assert HT.difference(whole, part).tolist() == [[1.0, 0.0, 0.0, 0.0]]
