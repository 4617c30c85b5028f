"""Quality filter: a learned decision list over text statistics.

The base filter rejects texts that are too short or mostly repeated three-word windows. For
the others, sequential covering learns from labelled statistics which are bad: it grows a
conjunction of thresholds by information gain on two thirds of the rows, prunes its last
conditions on the other third, keeps it if it is precise there, removes what it covers and goes
on. The list becomes one ordered Spark conditional expression, so judging is a projection.

A null or empty text has no words and all statistics 0; it fails the base filter. Repeated rows
are judged each; very long texts are judged whole. Of equally good conditions the first by name,
then the one below its threshold, then the smallest threshold is taken. Labels that are null,
contradict each other, or belong to no document are ignored. Without labels of both classes the
list is empty and keeps what the base filter keeps. A column with the name of the result is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm import labelled
from pitlog.llm.common import WHITE, add_columns, free_name, others, utf8

# Fixed values.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
PUNCTUATION = b"!?.,;:\"'()[]{}-_/\\=+~^`@"

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_upper",
    "n_digits",
    "n_punctuation",
)

MOST_RULES = 12
MOST_CONDITIONS = 4
LEAST_PRECISION = 0.95
LEAST_COVERED = 5


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*[words[k:] for k in range(window)]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = reached = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + window - max(i, reached)
            reached = i + window
    return total


def _share(text: bytes, letters: bytes) -> int:
    return len(text) - len(text.translate(None, letters))


def statistics(text: bytes | None) -> dict[str, int]:
    text = text or b""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip(WHITE)]
    # Code points are the bytes that do not continue another one.
    points = sum(map(len, words)) - _share(text, bytes(range(0x80, 0xC0)))
    return {
        "n_words": len(words),
        "word_chars": points,
        "n_symbols": _share(text, SYMBOLS),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_distinct_words": len(set(words)),
        "n_upper": _share(text, UPPER),
        "n_digits": _share(text, DIGITS),
        "n_punctuation": _share(text, PUNCTUATION),
    }


def with_statistics(docs: DataFrame, text: str = "text", out: str = "stats") -> DataFrame:
    """``docs`` with a struct of the counts of each text."""
    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    start = lambda: lambda t: (statistics(t),)
    return add_columns(docs, [utf8(f"`{text}`")], start, f"`{out}` struct<{fields}>")


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < LEAST_WORDS) | (
        100 * stats["n_repeat_words"] > MOST_REPEATED_PERCENT * stats["n_words"]
    )


# What the rules look at, as (numerator, denominator) of counts.
RATIOS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "duplicate_lines": ("n_dup_lines", "n_lines"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "distinct_words": ("n_distinct_words", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "punctuation_per_word": ("n_punctuation", "n_words"),
}


def ratio(stats: Column, name: str) -> Column:
    top, bottom = RATIOS[name]
    value = stats[top].cast("double")
    return value / F.greatest(stats[bottom], F.lit(1)) if bottom else value


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        v = values[self.name]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self, stats: Column) -> Column:
        v = ratio(stats, self.name)
        return v > self.threshold if self.above else v <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions; the first that holds rejects, and what none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def column(self, stats: Column) -> Column:
        """The number of the first rule that holds, from 1; null where the text is kept."""
        out = None
        for i, rule in enumerate(self.rules, 1):
            test = F.lit(True)
            for condition in rule:
                test = test & condition.column(stats)
            out = F.when(test, F.lit(i)) if out is None else out.when(test, F.lit(i))
        return F.lit(None).cast("int") if out is None else out

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, rule)) for rule in self.rules)


def _covers(rule: list[Condition], values: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, dtype=bool)
    for c in rule:
        out &= c.holds(values)
    return out


def _best_condition(values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Condition | None:
    """The threshold with the highest FOIL gain among the rows that the rule covers so far."""
    p0, n0 = int((bad & inside).sum()), int((~bad & inside).sum())
    if not p0 or not n0:
        return None
    base = math.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for name, column in sorted(values.items()):
        v, y = column[inside], bad[inside]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        low_p, low_n = np.cumsum(y)[cuts], np.cumsum(~y)[cuts]
        middle = (v[cuts] + v[cuts + 1]) / 2
        for above, p, n in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = float(gain[k]), Condition(name, above, float(middle[k]))
    return found


def cover(
    values: dict[str, np.ndarray],
    bad: np.ndarray,
    least_precision: float = LEAST_PRECISION,
    most_rules: int = MOST_RULES,
    most_conditions: int = MOST_CONDITIONS,
) -> DecisionList:
    """Sequential covering of the bad rows.

    At most ``most_rules`` rules of at most ``most_conditions`` conditions each, so that the list
    stays one a person can read; it ends before where the next rule would be too imprecise.
    """
    size = len(bad)
    prune_rows = np.arange(size) % 3 == 2
    left, rules = np.ones(size, dtype=bool), []
    while len(rules) < most_rules:
        grow, prune = left & ~prune_rows, left & prune_rows
        rule: list[Condition] = []
        inside = grow.copy()
        while len(rule) < most_conditions:
            condition = _best_condition(values, bad, inside)
            if condition is None:
                break
            rule.append(condition)
            inside &= condition.holds(values)
        if not rule:
            break

        def worth(part: list[Condition]) -> tuple[float, int]:
            covered = _covers(part, values, size) & prune
            p, n = int((covered & bad).sum()), int((covered & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0, -len(part)

        rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)
        covered = _covers(rule, values, size)
        p, n = int((covered & left & bad).sum()), int((covered & left & ~bad).sum())
        held_p, held_n = int((covered & prune & bad).sum()), int((covered & prune & ~bad).sum())
        if p < LEAST_COVERED or p < least_precision * (p + n) or held_p < least_precision * (held_p + held_n):
            break
        rules.append(tuple(rule))
        left &= ~covered
    return DecisionList(tuple(rules))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    key: str = "doc_id",
    text: str = "text",
    rows: int = labelled.SAMPLE_ROWS,
    most_rules: int = MOST_RULES,
    most_conditions: int = MOST_CONDITIONS,
) -> DecisionList:
    """A decision list from at most ``rows`` labelled documents; label 0 is bad.

    ``most_rules`` and ``most_conditions`` bound the list, as ``cover`` says.
    """
    picked = labelled.sample(docs, labels, F.col(label), key, text, rows)
    at = with_statistics(picked, text, "stats").where(~base_failed(F.col("stats")))
    found = at.select(
        F.col("labelled_key"), F.col("label"), *[ratio(F.col("stats"), n).alias(n) for n in RATIOS]
    ).toPandas()
    found = found.sort_values([*found.columns], kind="stable")
    values = {n: found[n].to_numpy(dtype=float) for n in RATIOS}
    bad = (found["label"] == 0).to_numpy(dtype=bool)
    return cover(values, bad, most_rules=most_rules, most_conditions=most_conditions)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", out: str = "quality") -> DataFrame:
    """``docs`` with a struct ``out``: stats, base_failed, rule (null: none) and kept."""
    mark = free_name(docs, "stats")
    at = with_statistics(docs, text, mark)
    failed, rule = base_failed(F.col(mark)), rules.column(F.col(mark))
    verdict = F.struct(
        F.col(mark).alias("stats"),
        failed.alias("base_failed"),
        rule.alias("rule"),
        (~failed & rule.isNull()).alias("kept"),
    )
    return at.select(*others(docs, out), verdict.alias(out))


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, unchanged."""
    mark: str = free_name(docs, "quality_verdict")
    at = judge(docs, rules, text, mark).where(F.col(mark)["kept"])
    return at.select(*[F.col(f"`{c}`") for c in docs.columns])


