import random

from pyspark.sql import functions as F

from pitlog.llm import decontaminate as M

VOCABULARY = [w.encode() for w in "a b c d e f".split()]


def brute(words, items, window):
    hit, found = set(), set()
    for item, ws in items:
        m = min(len(ws), window)
        wins = {tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(item)
    return hit, found


def test_scan_is_that_of_all_windows():
    r = random.Random(3)
    for trial in range(250):
        k = r.choice([2, 3, 6])
        draw = lambda n: [r.choice(VOCABULARY[:k]) for _ in range(n)]  # noqa: B023, E731
        items = [(str(i), draw(r.choice([0, 1, 2, 3, 5, 8, 13]))) for i in range(r.randrange(5))]
        words = draw(r.randrange(40))
        if items and r.random() < 0.5:
            words[5:5] = items[0][1]
        window = r.choice([3, 4, 5])
        spans, found = M.SuffixAutomaton(items, window).scan(words)
        hit, named = brute(words, items, window)
        assert {i for s, e in spans for i in range(s, e)} == hit, trial
        assert found == named and spans == sorted(spans)


def test_find_clean_and_their_edges(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame(
        [
            (1, f"Start, {passage.upper()}! end"),
            (2, "filler " * 400 + passage + " tail"),
            (3, None),
            (4, ""),
            (5, "nothing here"),
            (5, "nothing here"),
            (None, "short Item"),
        ],
        "doc_id long, text string",
    ).withColumn("contamination", F.lit("clash"))
    items = spark.createDataFrame(
        [(10, passage), (2, passage), (3, "short item"), (4, None), (None, "w1 w2")], "item_id long, text string"
    )
    got = M.find(docs, items, out="hits")
    assert got.columns == [*docs.columns, "hits"]
    by = {(r.doc_id, r.text): r.hits for r in got.collect()}
    first = by[1, f"Start, {passage.upper()}! end"]
    assert (first.n_words, first.n_hit, list(first["items"])) == (17, 15, ["10", "2", "null"])
    assert [(s.start, s.end) for s in first.spans] == [(1, 16)]
    assert by[None, "short Item"].n_hit == 2 and by[3, None].n_words == by[4, ""].n_words == 0
    kept = {(r.doc_id, r.text) for r in M.clean(docs, items).collect()}
    assert kept == {(2, "filler " * 400 + " tail"), (3, None), (4, ""), (5, "nothing here")}
    # Blocks of the benchmark, one pass each, give the same.
    monkeypatch.setattr(M, "BLOCK_BYTES", 40)
    again = M.find(docs, items, out="hits")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    assert M.find(docs, items.limit(0), out="hits").where("hits.n_hit > 0").count() == 0
    assert M.find(docs.limit(0), items, out="hits").count() == 0


def test_repeated_items_and_one_that_is_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_BYTES", 3_000)
    r = random.Random(8)
    words = ["v%d" % i for i in range(400)]
    rows = [(1, "the same item again and again")] * 3_000 + [(2, " ".join(r.choices(words, k=1_500)))]
    rows += [(10 + i, " ".join(r.choices(words, k=20))) for i in range(60)]
    items = spark.createDataFrame(rows, "item_id long, text string")
    n, read = M._blocks(items, "item_id", "text")
    blocks = [read(k) for k in range(n)]
    # The equal items are one; the long one is alone; the others share blocks of about the size.
    assert sorted(i for b in blocks for i, _ in b) == sorted({str(i) for i, _ in rows})
    sizes = [sum(len(t) for _, t in b) for b in blocks]
    assert max(s for s, b in zip(sizes, blocks) if b[0][0] != "2") < 6_000 and [len(b) for b in blocks][-1] == 1
    texts = [" ".join(r.choices(words, k=50)) for _ in range(20)]
    texts += [rows[-1][1] + " x " + rows[3_000][1][300:1_200], "so THE same item again and again", None, "long " * 50_000 + rows[-2][1]]
    docs = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumn("row", F.lit("clash")).withColumn("contamination", F.lit("clash"))
    got = M.find(docs, items)
    assert got.columns == ["doc_id", "text", "row", "contamination"]
    coded = [(str(i), t.encode().split()) for i, t in set(rows)]
    for g in got.collect():
        hit, found = brute((g.text or "").lower().encode().split(), coded, M.WINDOW)
        c = g.contamination
        assert {i for s in c.spans for i in range(s.start, s.end)} == hit and list(c["items"]) == sorted(found)
        assert c.n_hit == len(hit) and g.row == "clash"
