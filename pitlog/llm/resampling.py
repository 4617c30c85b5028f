"""Importance resampling towards a target distribution, with bucket counts from distinct lines.

Features are the runs of ``least`` to ``longest`` consecutive alphanumeric words (A-Z folded),
hashed into buckets. A bucket's gain is 1000 times the log ratio of its smoothed shares in the
target and in the raw texts, a document's weight the mean gain of its features, and its score the
weight plus Gumbel noise that depends on its id only. The highest scores among documents with
enough words are drawn, which samples without replacement in proportion to exp(weight / 1000).

Bucket counts of the corpus come from its segments. A newline separates words, so it cuts texts
into lines: equal lines are brought together by a grouped count that is combined before the
shuffle, the features of each distinct line are counted once and multiplied by its occurrences.
Runs that cross a line's end are counted where the documents lie and added; with runs of one
word there are none, and that pass is left out. Every task adds up an array of buckets and sends
only that. Gains travel to the tasks that score the documents.

The draw sorts nothing but the documents that score at least as high as the last one drawn,
dealt by ranges; scores are integers of a narrow range (``_by_score``), so their histogram is
small at any number of rows.

A null or empty text has no features, weight 0 and too few words to be drawn. Repeated rows are
scored and drawn each; a null id has the noise of the id "null" and comes last among ties, as
equal ids are ordered by their features and number. Very long texts are counted line by line and
scored as one row. Without documents there are no rows; without target texts every bucket's gain
follows from the corpus alone. Columns of the table that share the name of the new one are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import add_columns, folded, free_name, keep, ranked, small_batches, utf8

LEAST, LONGEST = 1, 1
BUCKETS = 10_000
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10
REMEMBERED = 200_000


class _Buckets(dict):
    """The bucket of a feature, remembered up to a bound."""

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.n
        return value


def features(words: list[bytes], least: int, longest: int) -> Iterator[bytes]:
    """All runs of ``least`` to ``longest`` words, joined by a space."""
    for n in range(least, longest + 1):
        if n == 1:
            yield from words
        else:
            yield from map(b" ".join, zip(*[words[i:] for i in range(n)]))


def crossing(lines: list[list[bytes]], least: int, longest: int) -> Iterator[bytes]:
    """The runs of a text's words that begin in one line and end in a later one."""
    words = [w for line in lines for w in line]
    home = [i for i, line in enumerate(lines) for _ in line]
    for n in range(max(least, 2), longest + 1):
        for i in range(len(words) - n + 1):
            if home[i] != home[i + n - 1]:
                yield b" ".join(words[i : i + n])


def _summed(rows: DataFrame, buckets: int, of: Callable[[bytes], Iterator[bytes]]) -> DataFrame:
    """(bucket, n): the features of column 0, each as often as column 1 says; one array a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, total = _Buckets(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            once: list[int] = []
            for text, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = map(memory.__getitem__, of(text))
                if times == 1:
                    once.extend(found)
                else:
                    np.add.at(total, list(found), times)
            total += np.bincount(once, minlength=buckets) if once else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "bucket bigint, n bigint")


def bucket_counts(
    docs: DataFrame, text: str = "text", least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS
) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    texts = docs.select(F.col(f"`{text}`").alias("t")).where("t is not null")
    lines = texts.select(F.explode(F.split("t", "\n")).alias("line")).where("line != ''")
    lines = lines.groupBy("line").agg(F.count("*").alias("n")).select(utf8("line").alias("line"), "n")
    parts = _summed(lines, buckets, lambda line: features(folded(line).split(), least, longest))
    if longest > 1:
        whole = texts.where(F.instr("t", "\n") > 0).select(utf8("t").alias("t"), F.lit(1).cast("bigint").alias("n"))

        def across(t: bytes) -> Iterator[bytes]:
            return crossing([folded(line).split() for line in t.split(b"\n")], least, longest)

        parts = parts.unionAll(_summed(whole, buckets, across))
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(float(t + 1) * (s_all + n)) / (float(s + 1) * (t_all + n)) for s, t in zip(corpus, target)]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], dtype=np.int64)


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln(u))), u from the first 32 bits of sha256 of ``seed:id``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(
    docs: DataFrame,
    worth: np.ndarray,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    seed: str = SEED,
    out: str = "resampling",
    beside: list[str] | None = None,
) -> DataFrame:
    """``docs`` (of its columns only ``beside``, if given) with a struct ``out``: n_words, n_features,
    weight and score; ``beside`` must have the key."""
    names = {k: free_name(docs, f"{out}_{k}") for k in ("words", "features", "weight")}

    def start() -> Callable[..., tuple]:
        memory, values = _Buckets(len(worth)), worth.tolist()
        bucket = memory.__getitem__

        def work(t: bytes | None) -> tuple:
            words = folded(t).split() if t else []
            found = list(map(bucket, features(words, least, longest)))
            total = sum(map(values.__getitem__, found))
            return len(words), len(found), total // len(found) if found else 0

        return work

    ddl = ", ".join(f"`{n}` bigint" for n in names.values())
    at = add_columns(docs, [utf8(f"`{text}`")], start, ddl, beside)
    struct = F.struct(
        F.col(names["words"]).alias("n_words"),
        F.col(names["features"]).alias("n_features"),
        F.col(names["weight"]).alias("weight"),
        (F.col(names["weight"]) + noise(F.col(f"`{key}`"), seed)).alias("score"),
    )
    stay = [c for c in docs.columns if c.lower() != out.lower() and (beside is None or c in beside)]
    return at.select(*[F.col(f"`{c}`") for c in stay], struct.alias(out))


def _by_score(scored: DataFrame) -> list[tuple[int, int]]:
    """(score, rows) from the highest score down.

    A gain is a log ratio of numbers below 2**63 and noise lies between -3,200 and 22,900, so
    there are fewer than 120,000 different scores whatever the number of rows.
    """
    return sorted(scored.groupBy("score").count().collect(), reverse=True)


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (id, n_words, n_features, weight, score) with ``rank``; null where not drawn."""
    fit = F.col("n_words") >= least_words
    counts = _by_score(scored.where(fit))
    wanted = percent * sum(n for _, n in counts) // 100
    last, upto = None, 0
    for last, n in counts if wanted else []:
        upto += n
        if upto >= wanted:
            break
    undrawn = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return scored.select("*", undrawn)
    near = fit & (F.col("score") >= last)
    # Ranges of the order, salted by the row so that equal rows can be dealt to several tasks.
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("n_words"), F.asc("salt")]
    drawn = ranked(scored.where(near).withColumn("salt", F.monotonically_increasing_id()), order, "place", upto)
    rank = F.col("place") + 1
    drawn = drawn.select(*scored.columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionAll(scored.where(~near).select("*", undrawn))


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    seed: str = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """A row per document: id, n_words, n_features, weight, score and rank (null: not drawn)."""
    worth = gains(
        bucket_counts(docs, text, least, longest, buckets),
        bucket_counts(target, target_text, least, longest, buckets),
    )
    only = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("t"))
    # Only numbers come back from Python, and go to few files.
    scored = score(only, worth, "id", "t", least, longest, seed, "found", ["id"]).select("id", "found.*")
    return draw(keep(scored, "resampling-scores", few=True), least_words, percent)
