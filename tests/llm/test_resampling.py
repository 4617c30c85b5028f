import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pitlog.llm import resampling as M
from pitlog.llm.common import ranked

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text, least, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(least, longest + 1) for i in range(len(w) - n + 1)]


def bucket(feature, buckets):
    return zlib.crc32(feature.encode()) % buckets


def brute(docs, target, least=1, longest=1, buckets=10000, seed="2024", least_words=20, percent=10):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in grams(t, least, longest):
                out[bucket(f, buckets)] += 1
        return out

    s, t = counts([d for _, d in docs]), counts(target)
    gain = [math.floor(1000 * math.log((float(b + 1) * float(sum(s) + buckets)) / (float(a + 1) * float(sum(t) + buckets))))
            for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        f = grams(text, least, longest)
        weight = sum(gain[bucket(x, buckets)] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words(text)), len(f), weight, score, None])
    fit = [r for r in rows if r[1] >= least_words]
    fit.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=str)


def corpus(seed, n):
    r = random.Random(seed)
    lines = [" ".join("W%d" % r.randrange(60) for _ in range(r.randrange(0, 12))) for _ in range(40)]
    docs = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 9)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (3, docs[3][1]), (None, docs[5][1]), (None, docs[5][1]), (None, "É9 " * 25),
             (n + 2, "\n\n--\n"), (n + 3, "one\nTwo\n\nthree " * 3000)]
    return docs


def rows_of(df):
    return sorted(((r.id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


@pytest.mark.parametrize("least,longest,percent", [(1, 1, 10), (1, 3, 30), (2, 2, 100)])
def test_resample_equals_brute_force(spark, least, longest, percent):
    docs = corpus(1, 120)
    target = ["w1 w2 w3", "W4\nw5 w6", None, "w1 w1"]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("rank", F.lit("clash"))
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = M.resample(table, wanted, least=least, longest=longest, percent=percent)
    assert rows_of(got) == brute(docs, target, least, longest, percent=percent)


def test_line_and_crossing_runs_are_all_runs():
    r = random.Random(2)
    for _ in range(60):
        text = "".join(r.choice(["a ", "b ", "\n", "c\n", "\n\n", "d-"]) for _ in range(r.randrange(25)))
        lines = [line.encode().replace(b"-", b" ").split() for line in text.split("\n")]
        inside = [f for line in lines for f in M.features(line, 1, 4)]
        assert sorted(inside + list(M.crossing(lines, 1, 4))) == sorted(g.encode() for g in grams(text, 1, 4))


def test_ranks_of_many_ties(spark):
    # One text under missing ids: one score, whose rows are dealt to several tasks.
    docs = [(None, "same word " * 20)] * 500 + [(i, "other word " * 20) for i in range(50)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = M.resample(table, spark.createDataFrame([("word",)], "text string"), percent=90)
    ranks = sorted(r.rank for r in got.collect() if r.rank is not None)
    assert ranks == list(range(1, 496))
    assert rows_of(got) == brute(docs, ["word"], percent=90)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([("a",)], "text string")
    assert M.resample(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert rows_of(M.resample(some, target.limit(0))) == brute([(1, "a b")], [])


def test_score_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, resampling_words string")
    worth = M.gains(M.bucket_counts(docs), M.bucket_counts(docs))
    out = M.score(docs.withColumn("resampling", F.lit("old")), worth)
    row = out.first()
    assert out.columns == ["doc_id", "text", "resampling_words", "resampling"]
    assert row.resampling_words == "x" and row.resampling.n_features == 2 and row.resampling.weight == 0


def test_only_numbers_come_back_and_go_to_few_files(spark, monkeypatch):
    plans = []
    kept = M.keep

    def seen(df, *args, **kinds):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, *args, **kinds)

    monkeypatch.setattr(M, "keep", seen)
    docs = corpus(4, 300)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(12)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    got = M.resample(table, spark.createDataFrame([("w1 w2",)], "text string"), percent=50)
    assert rows_of(got) == brute(docs, ["w1 w2"], percent=50)
    new = {p.name.rsplit("-", 1)[0][:17]: len([*p.glob("part-*.parquet")]) for p in set(folder.iterdir()) - before}
    assert new == {"resampling-scores": 1, "ranked": 1}
    back = re.search(r"MapInArrow run\(.*?\)#\d+, \[(.*?)\]", plans[0]).group(1)
    assert re.findall(r"(\w+)#", back) == ["id", "found_words", "found_features", "found_weight"]


def test_score_with_chosen_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, y string, resampling long")
    worth = M.gains(M.bucket_counts(docs), M.bucket_counts(docs))
    whole, some = M.score(docs, worth), M.score(docs, worth, beside=["doc_id", "y"])
    assert some.columns == ["doc_id", "y", "resampling"]
    assert some.collect() == whole.select("doc_id", "y", "resampling").collect()


@pytest.mark.parametrize("rows,parts", [(None, 8), (100, 1), (45_000, 3), (10**9, 8)])
def test_ranges_by_rows(spark, monkeypatch, rows, parts):
    widths = []
    frame = type(spark.range(1))
    deal = frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda df, n, *c: widths.append(n) or deal(df, n, *c))
    got = ranked(spark.range(300).withColumn("v", 300 - F.col("id")), [F.asc("v")], "place", rows)
    assert sorted((r.v, r.place) for r in got.collect()) == [(i + 1, i) for i in range(300)]
    assert widths == [parts]
