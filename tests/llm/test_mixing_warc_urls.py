import io
import random
import re
from collections import defaultdict

import zstandard
from pyspark.sql import functions as F

from pitlog.llm import mixing, url_filter, warc


def fill(sizes, most=3.0):
    """Targets by repeated sharing."""
    weight = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target, free = sum(sizes.values()), {}, set(sizes)
    left = float(total)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s] + 1e-9}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_meets_targets(spark):
    r = random.Random(1)
    rows = [(i, r.choice("aab") if i % 9 else None, "w " * r.randrange(30)) for i in range(600)]
    rows += [(1000 + i, "tiny", "x y") for i in range(3)] + [(7, "a", "same id"), (None, "b", None), (None, "b", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for i, s, t in rows:
        sizes[s] += len((t or "").split())
    by_hash = defaultdict(set)
    for g in got:
        taken[g.source] += g.taken
        target[g.source] = g.target
        assert g.source_size == sizes[g.source] and g.taken <= 3 * g.size
        if g.size:
            by_hash[g.source, g.doc_id].add(g.taken / g.size)
    want = fill(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6
        assert target[s] - 40 <= taken[s] <= target[s] + 1e-9, s
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_a_hot_source_of_equal_ids_and_empty_texts(spark):
    docs = spark.createDataFrame(
        [(1, "a", "x")] * 5 + [(2, "b", ""), (3, None, None)], "doc_id long, source string, text string"
    )
    got = {(r.doc_id, r.source): (r.size, r.target, r.taken) for r in mixing.mix(docs).collect()}
    assert got == {(1, "a"): (1, 5.0, 1), (2, "b"): (0, 0.0, 0), (3, None): (0, 0.0, 0)}


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/x", "<p>é</p>"), (2, "http://b/ \n", "<p>é</p>"), (3, None, None), (4, "u", ""),
            (4, "u", ""), (None, "n", "<p>é</p>"), (5, "v", "long " * 100_000)]
    rows += [(100 + i, f"http://h/{i}", f"<html><body>page {i} " + "common words here " * 20) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    manifest = warc.write(pages, str(tmp_path / "out"))
    got = warc.read(manifest).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for g in got:
        assert g.payload_digest == warc.digest(html[g.page_id]) and g.payload_bytes == len(html[g.page_id])
        assert (g.payload == html[g.page_id]) if g.record_type == "response" else g.payload is None
    kinds = sorted((str(g.page_id), g.record_type, g.refers_to) for g in got if g.page_id is None or g.page_id < 6)
    assert kinds == [
        ("1", "revisit", 2), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None),
        ("4", "response", None), ("5", "response", None), ("None", "revisit", 2),
    ]
    one = warc.read(warc.write(pages, str(tmp_path / "more"), least_bytes=1), payloads=False).collect()
    assert sorted(g.record_type for g in one if g.payload_bytes == 0) == ["response"] * 3
    assert warc.read(warc.write(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_mix_meets_targets_without_ids_and_with_equal_rows(spark):
    r = random.Random(3)
    rows = [(i if i % 3 else None, "ab"[i % 2], "w " * (1 + r.randrange(20)) + str(i)) for i in range(900)]
    rows += [(None, "a", "the same words")] * 400 + [(3, "b", "again and again the same")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6)
    got = mixing.mix(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        sizes[g.source] += g.size
        taken[g.source] += g.taken
        target[g.source] = g.target
    want = fill(dict(sizes))
    longest = 21
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 and target[s] - longest <= taken[s] <= target[s] + 1e-9, s
    assert sorted(map(str, mixing.mix(docs.repartition(4)).collect())) == sorted(map(str, got))


def test_mix_of_many_sources(spark):
    rows = [(i, f"host{i % 500:03d}", "w " * (1 + (i * i) % 37)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(t.split())
    want = fill(dict(sizes))
    got = {g.source: g.target for g in mixing.mix(docs).collect()}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def archive_starts(manifest):
    return [open(r.path, "rb").read(4) for r in manifest.collect()]


def test_long_few_and_alike_pages_have_a_dictionary_too(spark, tmp_path):
    magic = warc.SKIPPABLE.to_bytes(4, "little")
    long = [(i, "u", f"<p>{i}</p>" + f"the words of page {i} go on " * 6000) for i in range(12)]
    few = [(1, "u", "<p>one</p>"), (2, "u", "<p>two</p>")]
    alike = [(i, "u", "<p>the very same page</p>") for i in range(50)]
    for name, rows in (("long", long), ("few", few), ("alike", alike)):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
        manifest = warc.write(pages, str(tmp_path / name))
        starts = archive_starts(manifest)
        assert starts and set(starts) == {magic}, name
        back = warc.read(manifest)
        assert back.rdd.getNumPartitions() == len(starts)
        found = {r.page_id: r.payload for r in back.collect() if r.payload is not None}
        html = {i: h.encode() for i, _, h in rows}
        assert all(html[i] == p for i, p in found.items()) and len(found) == len(set(html.values()))


def test_dictionary_is_in_a_leading_skippable_frame(tmp_path):
    samples = [f"<html>{i} the common words of every page {i * 7}</html>".encode() * 4 for i in range(400)]
    known = zstandard.train_dictionary(2048, samples).as_bytes()
    writer = warc.Writer(str(tmp_path), known)
    for i, s in enumerate(samples):
        writer.add(warc.record(i, "u", s, None, False))
    writer.close()
    data = open(writer.done[0][0], "rb").read()
    assert data[:4] == warc.SKIPPABLE.to_bytes(4, "little")
    read = [warc.parse(f) for f in warc.frames(io.BytesIO(data), chunk=100)]
    assert [r["warc-type"] for r in read] == [b"warcinfo"] + [b"response"] * 400
    assert [r[""].partition(b"\r\n\r\n")[2] for r in read[1:]] == samples


def test_hosts_paths_and_rules(spark):
    urls = [None, "", "no scheme/x", "HTTP://WWW.Example.COM/en/a?q#f", "http://example.com/en/1", "a://x.net/es/",
            "a://net/fr/x", "a://b.com", "a://xcom/", "http://e.net#/es/", "x://y://z.com/p", "http://É.com/\n?"]

    def brute(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").withColumn(
        "host", F.lit("clash")
    )
    got = url_filter.judge(pages).select("page_id", "url", "url_filter.*").collect()
    for g in got:
        assert (g.host, g.path) == brute(g.url), g
        fits = [
            (len(t), t, v)
            for v, t in url_filter.RULES
            if (g.host == t[: t.index("/")] or g.host.endswith("." + t[: t.index("/")]))
            and g.path.startswith(t[t.index("/") :])
        ]
        assert g.rule == (max(fits)[1] if fits else None)
        assert g.verdict in ("allow", "block") and (not fits or g.verdict == max(fits)[2])
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_trees_learn_from_labelled_urls(spark):
    r = random.Random(3)
    urls = []
    for i in range(600):
        bad = i % 2
        host = f"{'x-9-spam-%d' % r.randrange(999) if bad else 'site'}.example.{'org' if r.random() < .5 else 'net'}"
        urls.append((i, f"http://{host}/{'/'.join('a' * r.randrange(1, 4))}", bad))
    df = spark.createDataFrame(urls, "page_id long, url string, blocked int")
    train, test = df.where("page_id < 400"), df.where("page_id >= 400")
    got = url_filter.judge(test, rules=(), labelled=train).collect()
    right = sum((g.url_filter.verdict == "block") == bool(g.blocked) for g in got)
    assert right >= 0.95 * len(got)
