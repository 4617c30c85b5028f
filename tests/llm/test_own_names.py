"""A column that has the name of an operator's result is replaced; long texts take linear time."""

import base64
import random
import time

import pytest
from pyspark.sql import functions as F

from pitlog.llm import decontaminate, licenses, pii, quality_rules, secrets, token_counts, url_filter
from pitlog.llm.common import add_columns


def docs(spark, name):
    table = spark.createDataFrame([(1, "mail a@b.co mit license", "http://h.com/x")], "doc_id long, text string, url string")
    return table.withColumn(name, F.lit("old"))


CASES = {
    "n_tokens": lambda d: token_counts.count_tokens(d),
    "secrets": lambda d: secrets.scan(d),
    "candidates": lambda d: pii.candidates(d),
    "quality": lambda d: quality_rules.judge(d, quality_rules.DecisionList()),
    "contamination": lambda d: decontaminate.find(d, d.select(F.lit(1).alias("item_id"), F.lit("x").alias("text"))),
    "url_filter": lambda d: url_filter.judge(d),
    "licenses": lambda d: licenses.scan(d),
}


@pytest.mark.parametrize("name", CASES)
def test_a_column_of_the_results_name_is_replaced(spark, name):
    out = CASES[name](docs(spark, name))
    assert out.columns.count(name) == 1
    row = out.select("doc_id", name).first()
    assert row.doc_id == 1 and row[name] != "old"


def test_new_columns_replace_those_of_their_name(spark):
    table = spark.createDataFrame([(1, "a")], "N long, t string")
    out = add_columns(table, [F.col("t"), F.col("N")], lambda: lambda t, n: (len(t) + n,), "n bigint")
    assert out.columns == ["t", "n"] and out.first().n == 2


def ssh_line(rest):
    return base64.b64encode((b"\x00\x00\x00\x07ssh-rsa" + rest)[:48].ljust(48, b"\x00")).decode()


def test_wrapped_lines_take_linear_time():
    r = random.Random(1)
    # Every line begins like the first field of a key, and the fields go on from each of them.
    lines = [ssh_line(b"\x00\x00\x00\x01x" * 7) for _ in range(30_000)]
    for text in ("\n".join(lines), "\n".join(ssh_line(r.randbytes(37)) for _ in range(30_000))):
        start = time.perf_counter()
        secrets.wrapped_spans(text)
        took = time.perf_counter() - start
        assert len(text) > 1_900_000 and took < 10, took


def test_a_wrapped_key_among_other_lines_is_found_whole():
    fields = [b"ssh-ed25519", b"k" * 32, b"p" * 64, b"c" * 40]
    data = b"".join(len(f).to_bytes(4) + f for f in fields)
    data += b"\x00\x00\x00" + bytes([57 - 4 - len(data) % 57 if len(data) % 57 <= 53 else 57 + 53 - len(data) % 57])
    data += b"z" * data[-1]
    assert len(data) % 57 == 0
    code = base64.b64encode(data).decode()
    lines = [code[i : i + 76] for i in range(0, len(code), 76)]
    text = "key:\n" + "\n".join(lines) + "\nnot base64 here"
    assert secrets.wrapped_spans(text) == [("ssh", 5, 5 + len("\n".join(lines)))]
