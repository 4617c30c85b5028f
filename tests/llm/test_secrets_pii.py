import base64
import json
import random
import re
from pathlib import Path

from pyspark.sql import functions as F

from pitlog.llm import pii, queries, secrets
from pitlog.llm.spans import line, replaced

ALPHABET = list("aA0123459.@+-_ ()%é:='\"#\nfbxyzK:/") + [
    "AKIA", "token", "PassWD", "secret=", "api_key: ", "1.2.3.4", "4111 1111 1111 1111", "+1 (555)", "@x.y", "deadbeef" * 4,
]


def texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(60))) for _ in range(n)]


def test_pii_base_is_that_of_the_plain_patterns():
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    count = lambda s: sum(c in "0123456789" for c in s)
    checks = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 13 <= count(s) <= 19 and pii.luhn(pii.digits(s)),
        "phone": lambda s: 9 <= count(s) <= 15,
    }
    for t in texts(3000, 1):
        want = [
            (k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t) if checks[k](m[0])
        ]
        assert pii.base_spans(t) == want, repr(t)
        base, wide = pii.candidate_spans(t)
        assert base == want
        assert all(b <= s or e <= a for _, s, e in wide for _, a, b in base)


def test_secret_base_is_that_of_the_plain_patterns():
    assign = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for t in texts(3000, 2):
        want = [("assign", *m.span()) for m in re.finditer(assign, t, re.ASCII) if len(m[1]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert secrets.base_spans(t) == sorted(want, key=lambda s: (s[1], secrets.KINDS.index(s[0]))), repr(t)


def der(tag, content):
    n = len(content)
    size = bytes([n]) if n < 128 else bytes([0x80 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + content


def rsa():
    r = random.Random(4)
    return der(0x30, der(2, b"\0") + b"".join(der(2, b"\x11" + r.randbytes(60)) for _ in range(8)))


def test_structures_are_confirmed_and_noise_is_not():
    part = lambda v: base64.urlsafe_b64encode(json.dumps(v).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJlLWJ5dGVz"
    key = base64.b64encode(rsa()).decode()
    field = lambda b: len(b).to_bytes(4) + b
    ssh = base64.b64encode(field(b"ssh-ed25519") + field(bytes(range(32)))).decode()
    assert [s[0] for s in secrets.confirmed_spans(f"x {token} y")] == ["jwt"]
    assert secrets.confirmed_spans(f"k={key}.") == [("der", 2, 2 + len(key))]
    assert [s[0] for s in secrets.confirmed_spans(rsa().hex())] == ["der"]
    assert [s[0] for s in secrets.confirmed_spans(f"a {ssh} me@host")] == ["ssh"]
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{key[:64]}\n{key[64:]}\n-----END RSA PRIVATE KEY-----"
    assert secrets.confirmed_spans(pem) == [("der", 0, len(pem))]
    broken = base64.b64encode(rsa()[:-1] + b"\0\0").decode()
    other = f"{part({'typ': 'JWT'})}.{part({'sub': '1'})}.c2ln"
    for noise in (broken, other, "M" * 80, "AAAA" + "B" * 60, "30" + "0" * 80):
        assert secrets.confirmed_spans(noise) == [], noise
    # Deep nesting ends early.
    deep = b""
    for _ in range(40):
        deep = der(0x30, deep)
    assert not secrets.is_private_der(deep)


def short_keys():
    """PKCS #8 Ed25519 and SEC1 P-256: DER of less than 128 bytes, so with lengths of one byte."""
    r = random.Random(5)
    ed25519 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, r.randbytes(32))))
    curve = der(0xA0, der(6, bytes.fromhex("2a8648ce3d030107")))
    public = der(0xA1, der(3, b"\0\4" + r.randbytes(64)))
    p256 = der(0x30, der(2, b"\1") + der(4, r.randbytes(32)) + curve + public)
    assert (len(ed25519), len(p256)) == (48, 121)
    return ed25519, p256


def test_keys_in_short_length_form_and_openssh_in_hex_are_confirmed():
    for key in short_keys():
        for run in (base64.b64encode(key).decode(), key.hex(), key.hex().upper()):
            assert secrets.confirmed_spans(f"k={run}.") == [("der", 2, 2 + len(run))], run
        for run in (base64.b64encode(key[:-1]).decode(), key[:-1].hex()):
            assert secrets.confirmed_spans(run) == [], run
    ssh = b"openssh-key-v1\0" + bytes(range(120))
    for run in (ssh.hex(), ssh.hex().upper(), base64.b64encode(ssh).decode()):
        assert secrets.confirmed_spans(f"k={run}.") == [("ssh", 2, 2 + len(run))], run
    # The digest inside a signature is laid out like an encrypted key.
    sha256 = der(0x30, der(6, bytes.fromhex("608648016503040201")) + der(5, b""))
    digest = der(0x30, sha256 + der(4, bytes(range(32))))
    for run in (base64.b64encode(digest).decode(), digest.hex()):
        assert secrets.confirmed_spans(run) == [], run


def wrapped_runs():
    """(text, kind, start, end) of keys and tokens that are broken over lines or begin with white space."""
    r = random.Random(6)
    field = lambda b: len(b).to_bytes(4) + b
    name = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4)
    ssh = name + field(r.randbytes(51)) + field(r.randbytes(136))
    public = field(b"ssh-ed25519") + field(r.randbytes(32))
    for breaks in ("\n", "\r\n", "\n    ", "\\n", "\\r\\n", "\\\\n", "\\u000a"):
        for key, kind in ((rsa(), "der"), (short_keys()[0], "der"), (short_keys()[1], "der"), (ssh, "ssh"), (public, "ssh")):
            run = base64.b64encode(key).decode()
            for width in (20, 64, 100):
                body = breaks.join(run[i : i + width] for i in range(0, len(run), width))
                pem = f"-----BEGIN PRIVATE KEY-----{breaks}{body}{breaks}-----END PRIVATE KEY-----"
                yield f'"key": "{pem}{breaks}"', kind, 8, 8 + len(pem)
                for before, after in (("k=", "."), (f"see{breaks}", f"{breaks}word{breaks}next"), (f"MAIN{breaks}", "")):
                    if width < len(run) or breaks != "\n":
                        yield before + body + after, kind, len(before), len(before) + len(body)
    part = lambda v: base64.urlsafe_b64encode(v.encode()).decode().rstrip("=")
    for space in ("", " ", "\n", "\r\n  ", "\t"):
        token = f"{part(space + json.dumps({'alg': 'HS256'}))}.{part(space + json.dumps({'sub': '1'}))}."
        for before in ("t=", "x\\n", "a-long-host-name.", "a-long-host-name.b."):
            for signature in ("", "c2lnbmF0dXJl"):
                run = token + signature
                yield f"{before}{run} y", "jwt", len(before), len(before) + len(run)


def test_broken_lines_are_joined_and_tokens_may_begin_with_white_space():
    for text, kind, start, end in wrapped_runs():
        assert secrets.confirmed_spans(text) == [(kind, start, end)], repr(text)
    # Two keys in one block of lines, and lines that only look like one.
    run = base64.b64encode(rsa()).decode().rstrip("=")
    body = "\n".join(run[i : i + 64] for i in range(0, len(run), 64))
    assert secrets.confirmed_spans(f"{body}\n{body}") == [("der", 0, len(body)), ("der", len(body) + 1, 2 * len(body) + 1)]
    for noise in (body[:-4], body[:100] + "/" + body[100:], "MAIN\nMIND\n" * 50, ("A" * 76 + "\n") * 50):
        assert secrets.confirmed_spans(noise) == [], noise


def test_digests_and_edges(spark):
    docs = spark.createDataFrame(
        [(1, "é token = \"abcdef12\""), (1, "é token = \"abcdef12\""), (2, None), (3, ""), (None, "mail a@b.co now")],
        "doc_id long, text string",
    ).withColumn("kind", F.lit("clash"))
    got = secrets.scan(docs)
    digests = got.select("doc_id", *[c.alias(n) for n, c in secrets.as_digest().items()]).collect()
    assert sorted((r.doc_id or 0, r.n_assign, r.spans) for r in digests) == [
        (0, 0, ""), (1, 1, "assign:2:19"), (1, 1, "assign:2:19"), (2, 0, ""), (3, 0, ""),
    ]
    seen = pii.candidates(docs)
    found = pii.judge(seen, pii.learn(seen))
    digests = found.select("doc_id", *[c.alias(n) for n, c in pii.as_digest().items()]).collect()
    assert {r.spans for r in digests} == {"", "email:5:11"}
    assert {r.text for r in pii.mask(docs).collect()} >= {"mail <EMAIL> now", None, ""}
    assert pii.mask(docs).columns == docs.columns
    assert pii.mask(docs.limit(0)).count() == 0 == secrets.scan(docs.limit(0)).count()


def test_labelers_reliability_and_classifier():
    counts = {"+++0+": 400.0, "+++++": 50.0, "0--0-": 300.0, "0--0+": 20.0, "0+++0": 5.0}
    found = pii.expectation_maximisation(counts)
    assert found.probability("+++0+") > 0.99 > 0.01 > found.probability("0--0-")
    rows = [("card", p, "4|5|", int(n)) for p, n in counts.items()]
    model = pii.fit(rows)
    assert model.probability("card", "+++0+", "4|5|") > 0.95 and model.probability("card", "0--0-", "4|5|") < 0.05
    assert pii.fit([]).probability("card", "+++0+", "4|5|") == 0.0
    assert pii.fit(list(reversed(rows))) == model


def test_added_spans_and_masks():
    base, wide = pii.candidate_spans("call 202-555-0143, ssn 123-45-6789, bob [at] site [dot] org")
    assert base == [] and line(wide) == "email:36:59,phone:5:17,id:23:34"
    assert replaced("a bcd e", [("x", 2, 5), ("y", 4, 7)]) == "a <X>"


PERSONAL = ["mail a@b.co now", "call 202-555-0143", "host 10.0.0.1", "+1 (202) 555-0143", "ssn 123-45-6789", "plain", "", None]


def personal(spark, rows=400):
    """Rows over 12 partitions; ids and texts repeat, some are null."""
    docs = [(i % 97 or None, PERSONAL[i % 8] and f"{PERSONAL[i % 8]} {i % 50} x@y.org" * (i % 3)) for i in range(rows)]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(12)


def test_only_candidates_come_back_and_go_to_few_files(spark, monkeypatch, tmp_path):
    plans, kept = [], queries.keep
    texts = personal(spark)
    texts.write.parquet(str(tmp_path / "documents.parquet"))

    def seen(df, *args, **kinds):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df, *args, **kinds)

    monkeypatch.setattr(queries, "keep", seen)
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    got = queries.op3_pii(spark, str(tmp_path))
    (new,) = set(folder.iterdir()) - before
    assert len([*new.glob("part-*.parquet")]) == 1
    back = re.search(r"MapInArrow run\(.*?\)#\d+, \[(.*?)\]", plans[0]).group(1)
    assert re.findall(r"(\w+)#", back) == ["doc_id", "candidates"]
    found = pii.candidates(texts)
    want = pii.judge(found, pii.learn(found)).select("doc_id", *[c.alias(n) for n, c in pii.as_digest().items()])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(got) == rows(want) and got.schema == want.schema and got.count() == 400


def test_masks_write_nothing_and_move_each_text_once(spark):
    docs = personal(spark).withColumn("source", F.lit("s")).select("doc_id", "text", "source")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    got = pii.mask(docs)
    assert set(folder.iterdir()) == before
    back = re.search(r"MapInArrow run\(.*?\)#\d+, \[(.*?)\]", got._jdf.queryExecution().analyzed().toString()).group(1)
    assert re.findall(r"(\w+)#", back) == ["doc_id", "source", "masked"]
    assert got.schema == docs.schema and got.count() == 400
    assert {r.source for r in got.collect()} == {"s"}
    # Spans of each text as the classifier of all rows judges them.
    found = pii.candidates(docs)
    judged = pii.judge(found, pii.learn(found)).select("doc_id", "text", "pii").collect()
    cut = lambda r: replaced(r.text, [(s.kind, s.start, s.end) for s in r.pii]) if r.pii else r.text
    assert sorted(str((r.doc_id, r.text)) for r in got.collect()) == sorted(str((r.doc_id, cut(r))) for r in judged)


def test_candidates_with_chosen_columns(spark):
    docs = personal(spark).withColumn("y", F.lit(1))
    whole, some, alone = pii.candidates(docs), pii.candidates(docs, beside=["doc_id", "y"]), pii.candidates(docs, beside=[])
    rows = lambda df: sorted(map(str, df.collect()))
    assert whole.columns == ["doc_id", "text", "y", "candidates"] and alone.columns == ["candidates"]
    assert some.columns == ["doc_id", "y", "candidates"] and rows(some) == rows(whole.select(*some.columns))
    assert rows(alone) == rows(whole.select("candidates"))
