import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pitlog.llm import labelled
from pitlog.llm import quality_rules as Q
from pitlog.llm import toxicity as X


def brute(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if many[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if any(c not in "\t\n\x0b\x0c\r " for c in x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(inside),
    }


def test_statistics_are_those_of_plain_counting():
    r = random.Random(2)
    for _ in range(800):
        t = "".join(r.choice("ab é漢#|\n\t \x0b\xa0\x85") for _ in range(r.randrange(60)))
        got = Q.statistics(t.encode())
        assert {k: got[k] for k in brute(t)} == brute(t), repr(t)
    assert set(Q.statistics(None).values()) == {0}


def test_covering_finds_the_thresholds():
    r = np.random.default_rng(0)
    values = {n: r.uniform(0, 1, 3000) for n in Q.RATIOS}
    bad = (values["symbols_per_word"] > 0.8) | ((values["upper_per_char"] > 0.6) & (values["distinct_words"] <= 0.3))
    rules = Q.cover(values, bad)
    caught = np.zeros(3000, dtype=bool)
    for rule in rules.rules:
        caught |= Q._covers(list(rule), values, 3000)
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.02 * (~bad).sum()
    assert Q.cover(values, np.zeros(3000, dtype=bool)).rules == ()
    assert Q.cover({n: v[:0] for n, v in values.items()}, bad[:0]).rules == ()


def corpus(spark, n=240):
    r = random.Random(9)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % r.randrange(400) for _ in range(80)]
        poor, toxic = i % 4 == 0, i % 3 == 0
        if poor:
            words = [w + "###" for w in words]
        if toxic:
            words[r.randrange(80)] = r.choice(["idiot", "trash"])
            words[r.randrange(80)] = "vequ" + r.choice("abcdef")
        rows.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    rows += [(9000, None), (9001, ""), (0, rows[0][1])]
    labels += [(1, 0, 1), (None, 1, 0), (7777, 1, 1), (9000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit(1))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_sample_has_one_text_of_each_labelled_key(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(7, f"other {i}") for i in range(100)] + [(7, "same")] * 300
    rows += [(8, None)] * 20 + [(500, None), (None, "no id"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(500, 1)], "doc_id long, toxic int")
    pick = lambda d, n: sorted(map(tuple, labelled.sample(d, labels, F.col("toxic"), rows=n).collect()))
    got = pick(docs, 1000)
    assert [(k, y) for k, y, _ in got] == [*[(i, i % 2) for i in range(200)], (500, 1)]
    assert all(t == f"text {k}" for k, _, t in got if k not in (7, 500)) and got[-1][2] is None
    assert (7, got[7][2]) in rows
    assert pick(docs.repartition(5, "text"), 1000) == got
    few = pick(docs, 50)
    assert len(few) == 50 and set(few) <= set(got)
    # The model of a corpus does not change when one document is repeated.
    docs, labels_2 = corpus(spark)
    again = docs.unionAll(docs.where("doc_id = 3").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(150)))).drop("n"))
    assert Q.learn(again, labels_2) == Q.learn(docs, labels_2)


def test_rules_are_learned_from_labels_and_applied(spark):
    docs, labels = corpus(spark)
    rules = Q.learn(docs, labels)
    assert len(rules.rules) == 1
    kept = {r.doc_id for r in Q.keep_good(docs, rules).collect()}
    assert kept == {i for i in range(240) if i % 4}
    assert Q.keep_good(docs, rules).columns == docs.columns
    assert Q.learn(docs, labels.limit(0)).rules == ()
    assert Q.judge(docs.limit(0), rules, out="q").count() == 0
    assert Q.judge(docs, Q.DecisionList(), out="q").where("q.kept").count() == 241


def test_chain_catches_words_and_families(spark):
    docs, labels = corpus(spark)
    chain = X.learn(docs, labels)
    assert [link.name for link in chain.links] == ["insult", "contempt", "toxic"]
    assert [len(link.earlier) for link in chain.links] == [0, 1, 2]
    rows = X.score(docs, chain).select("doc_id", "toxicity.*").collect()
    assert {r.doc_id for r in rows if r.toxic >= 0.5} == {i for i in range(240) if i % 3 == 0}
    assert all(0 <= p <= 1 for r in rows for p in r[1:])
    assert X.learn(docs, labels) == chain
    none = X.learn(docs, labels.limit(0))
    assert X.score(docs, none).where("toxicity.toxic >= 0.5").count() == 0
    assert X.score(docs.limit(0), chain).count() == 0


def test_many_toxic_words_all_get_a_weight(spark):
    r = random.Random(3)
    bad = ["".join(r.choice("bcdfghjklm") for _ in range(11)) for _ in range(60)]
    rows, labels = [], []
    for i in range(2100):
        words = ["w%d" % r.randrange(400) for _ in range(10)]
        if i % 5 == 0:
            words[r.randrange(10)] = bad[i // 5 % 60]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    chain = X.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert set(bad) <= set(chain.links[-1].weights) and len(chain.links[-1].weights) >= 420
    found = {i for i in bad if chain.probabilities(X.Recogniser(chain.known())(i.encode()))[-1] >= 0.5}
    assert found == set(bad)


def test_sparse_fit_is_the_dense_one():
    r = np.random.default_rng(1)
    chosen = [f"f{i}" for i in range(300)]
    x = r.random((500, 300)) < 0.03
    before, y = r.random((500, 1)), (r.random(500) < 0.3).astype(float)
    link = X.fit_link("toxic", chosen, [{chosen[j] for j in np.flatnonzero(row)} for row in x], before, y)
    m = np.column_stack([np.ones(500), before, x.astype(float)])
    w = np.array([link.intercept, *link.earlier, *[link.weights[f] for f in chosen]])
    strength = np.full(302, X.PENALTY)
    strength[0] = 1e-6
    slope = m.T @ (1 / (1 + np.exp(-m @ w)) - y) + strength * w
    assert np.abs(slope).max() < 1e-2
    assert X.fit_link("toxic", [], [set()] * 500, before, y).weights == {}
