import random

import numpy as np
from pyspark.sql import functions as F

from pitlog.llm import jaccard_join as M
from pitlog.llm.components import components


def brute(rows, percent=80, k=5):
    """Components by comparing all pairs."""
    sets = [M.shingles(M.words_of((t or "").encode()), k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                top[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), doc if not sets[i] else least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=str
    )


def corpus(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["w%d" % r.randrange(3000) for _ in range(r.choice([0, 1, 3, 4, 6, 8, 9, 12, 20, 60, 200]))]
        rows.append((10 * i, " ".join(words)))
        for c in range(r.choice([0, 0, 1, 3])):
            words = list(words)
            for _ in range(r.randrange(3)):
                if words:
                    words[r.randrange(len(words))] = "e%d" % r.randrange(9)
            if r.random() < 0.5:
                words.append("tail")
            rows.append((10 * i + c + 1, " ".join(words).upper() if c else "\n".join(words)))
    return rows


def test_components_are_those_of_all_pairs(spark):
    rows = corpus(1)
    rows += [(5, "one text"), (5, "another text here"), (5, "another text here"), (None, "one text"), (None, "lone"),
             (3, None), (4, "\t"), (2, "One TEXT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = sorted(map(tuple, M.classes(docs).collect()), key=str)
    assert got == brute(rows)
    assert M.classes(docs.limit(0)).count() == 0


def test_groups_without_ids_and_under_one_id_leave_one(spark):
    base = ["w%d" % i for i in range(60)]
    near = lambda i: " ".join(base[:i] + ["x"] + base[i + 1 :])
    rows = [(None, near(59)), (None, near(59)), (5, near(58)), (5, near(59)), (6, near(57)), (5, "quite another text")]
    rows += [(None, "lone text"), (None, "lone text"), (None, ""), (7, None), (None, "lone  TEXT")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = M.one_of_each(docs).collect()
    near_left = [r for r in kept if r.text and r.text.startswith("w0")]
    assert len(near_left) == 1 and near_left[0].doc_id == 5
    rest = sorted(str((r.doc_id, (r.text or "").lower().split())) for r in kept if r not in near_left)
    want = [(5, ["quite", "another", "text"]), (None, ["lone", "text"]), (None, []), (7, [])]
    assert rest == sorted(map(str, want))


def test_large_group_of_near_copies_with_several_rounds(spark):
    # Copies that differ from each other by about as much as is allowed: many links only over others.
    r = random.Random(9)
    base = ["w%d" % i for i in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 4])):
            words[r.randrange(150)] = "v%d" % r.randrange(10**6)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, M.classes(docs).collect()), key=str) == brute(rows)


def test_one_of_each_component_stays(spark):
    rows = corpus(2, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    kept = M.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, c in brute(rows) if d == c)
    odd = [(1, "a b c"), (1, "a b c"), (2, "a b c"), (1, "other"), (None, "a b c"), (3, ""), (3, None)]
    kept = M.one_of_each(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    want = [(1, "a b c"), (3, ""), (3, None)]
    want.append((1, "other"))  # a component of its own
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)


def test_a_chain_of_near_copies_is_one_component(spark):
    # Neighbours are similar, the ends are not, so lists have to be followed past their heads.
    base = ["w%d" % i for i in range(120)]
    rows = [(i, " ".join(base[i * 4 : i * 4 + 60])) for i in range(15)]
    docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
    assert sorted(map(tuple, M.classes(docs).collect()), key=str) == brute(rows)


def test_similar_sets_share_a_key():
    r = np.random.default_rng(5)
    draw = lambda n: r.integers(0, 2**64 - 1, n, dtype=np.uint64)
    tried = 0
    while tried < 1500:
        n = int(np.exp(r.uniform(np.log(4), np.log(900))))
        a = np.unique(draw(n))
        gone = int(r.integers(0, n // 5 + 1))
        room = 100 * (n - gone) // 80 - n
        if room < 0:
            continue
        b = np.unique(np.concatenate([r.permutation(a)[gone:], draw(int(r.integers(0, room + 1)))]))
        common = len(np.intersect1d(a, b))
        if common == max(len(a), len(b)) or 100 * common < 80 * (len(a) + len(b) - common):
            continue
        tried += 1
        for n_sets in (1 << 10, 1 << 34):
            (one, may_one), (two, may_two) = M.index_keys(a, n_sets), M.index_keys(b, n_sets)
            order = {int(k): r.random() for k in np.union1d(one, two)}

            def first(keys, band, may):
                own = sorted((int(k) for k in keys[keys & 63 == band]), key=order.get)
                return set(own[: len(own) - may.get(band, 0)])

            # Whatever the order of the keys, leaving out the last ones spares a common key.
            if not any(first(one, k, may_one) & first(two, k, may_two) for k in range(64)):
                raise AssertionError((len(a), len(b)))
            changed = sum(int(x).bit_count() for x in (M.sketch(a) ^ M.sketch(b)).view(np.uint64))
            assert changed <= len(a) + len(b) - 2 * common


def test_components_of_paths_and_stars(spark):
    r = random.Random(4)
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 200 + i) for i in range(50)]
    edges = path + star + [(7, 7), (300, 301), (301, 300), (300, 301)]
    r.shuffle(edges)
    got = {(x.node, x.component) for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(i, 0) for i in range(41)} | {(100, 100)} | {(200 + i, 100) for i in range(50)} | {(300, 300), (301, 300)}
    assert got == want
