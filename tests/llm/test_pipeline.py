import random

import corpus_pipeline as P
from pitlog.llm import decontaminate, jaccard_join, mixing, pii, quality_rules


def test_each_stage_does_its_part(spark, tmp_path):
    r = random.Random(6)
    draw = lambda n: " ".join("w%d" % r.randrange(900) for _ in range(n))
    passage = draw(20)
    rows = [(i, draw(80)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)]  # copies
    rows += [(200 + i, rows[i][1] + " more") for i in range(5)]  # near copies
    rows += [(300 + i, " ".join(w + "##" for w in draw(80).split())) for i in range(30)]  # poor
    rows += [(400, draw(60) + " " + passage), (401, draw(900) + " " + passage)]
    rows += [(500, draw(70) + " write to a.b@c.org or +1 (202) 555-0143 now"), (600, None), (601, "too short")]
    docs = spark.createDataFrame(
        [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 300 <= i < 400), 0) for i, _ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    ids = lambda df: {x.doc_id for x in df.collect()}
    at = spark.read.parquet(f"{d}/documents.parquet")
    gone = [
        set(range(300, 330)) | {600, 601},
        set(range(100, 105)) | set(range(200, 205)),
        {400},
        set(),
    ]
    for (name, stage), drops in zip(P.STAGES, gone):
        after = stage(spark, at, d)
        assert after.columns == docs.columns and after.schema == at.schema, name
        assert ids(at) - ids(after) == drops, name
        at = after
    texts = {x.doc_id: x for x in at.collect()}
    assert passage not in texts[401].text and texts[401].n_chars == len(texts[401].text)
    assert texts[500].text.endswith("write to <EMAIL> or <PHONE> now")
    assert all(texts[i].text == t for i, t in rows if i < 60)
    mixed = P.STAGES[-1][1](spark, at, d)
    whole = P.run(spark, d)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))
    assert {x.doc_id for x in whole.collect()} <= set(texts)


def test_stages_name_their_operators():
    assert [n for n, _ in P.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "pii", "mixing"]
    assert all((quality_rules, jaccard_join, decontaminate, pii, mixing))
