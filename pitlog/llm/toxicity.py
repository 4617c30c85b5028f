"""Toxicity by a classifier chain.

Categories are predicted one after the other, each by a linear model over what words
a text has and the probabilities of the earlier categories. When a later model is trained, those
probabilities come from models that have not seen the row (out of fold), so it does not learn to
trust them more than they deserve; when scoring, they come from the models themselves.

Features are words and their beginnings. Models are fitted on a bounded sample of labelled rows,
given by a parameter, on all features that tell the classes apart in it. Scoring runs over all documents and whole texts.

A null or empty text has no words; its probabilities are those of the intercepts, and it is not
toxic. Repeated rows are scored each. Very long texts are scored whole, by the set of their words.
A probability equal to the threshold counts as toxic. Without labels of both classes a category's
probability is its share in the sample (0 without rows). An empty table gives no rows. A column
with the name of the result is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm import labelled
from pitlog.llm.common import add_columns, folded, keep, utf8

# Seed words of the categories that lead up to the overall label.
SEEDS = {
    "insult": ("idiot", "moron", "loser", "clown", "stupid", "scum"),
    "contempt": ("disgusting", "worthless", "pathetic", "trash", "garbage", "hate"),
}
OVERALL = "toxic"
FOLDS = 4
SAMPLE_ROWS = 8_000
PREFIXES = range(4, 10)  # code points
PENALTY = 1.0
MOST_STEPS = 1_000
REMEMBERED = 300_000
LEAST_Z = 4.0
LEAST_DOCUMENTS = 5
THRESHOLD = 0.5


Words = set[bytes]


def folded_words(text: bytes | None) -> Words:
    return set(folded(text).split()) if text else set()


def features_of(word: bytes) -> list[str]:
    """A word and its beginnings, which families of words share."""
    w = word.decode("utf-8", "replace")
    return [w, *[f"{w[:k]}*" for k in PREFIXES if k < len(w)]]


class Recogniser:
    """The features of texts that a chain knows; a word's are looked up once and remembered."""

    def __init__(self, known: set[str]):
        self.known, self.memory = known, {}

    def __call__(self, text: bytes | None) -> set[str]:
        out: set[str] = set()
        for word in folded_words(text):
            if word not in self.memory:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                self.memory[word] = tuple(f for f in features_of(word) if f in self.known)
            found = self.memory[word]
            if found:
                out.update(found)
        return out


@dataclass(frozen=True)
class Link:
    """One linear model: an intercept, feature weights, and weights of the earlier probabilities."""

    name: str
    intercept: float
    weights: dict[str, float]
    earlier: tuple[float, ...]

    def probability(self, features: set[str], before: Sequence[float]) -> float:
        x = self.intercept + sum(w * p for w, p in zip(self.earlier, before))
        x += math.fsum(self.weights[f] for f in features if f in self.weights)
        return 1 / (1 + math.exp(min(max(-x, -500), 500)))


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]

    def known(self) -> set[str]:
        return {f for link in self.links for f in link.weights}

    def probabilities(self, features: set[str]) -> list[float]:
        out: list[float] = []
        for link in self.links:
            out.append(link.probability(features, out))
        return out


def telling(counts: dict[str, tuple[float, float]], rows: float, positive: float) -> list[str]:
    """Features whose share differs between the classes by more than chance, the clearest first.

    ``counts`` has, for each feature, the rows and the positive rows it is in.
    """
    if not 0 < positive < rows:
        return []
    p, scored = positive / rows, []
    for name, (k, yes) in counts.items():
        if k >= LEAST_DOCUMENTS and k < rows:
            z = (yes - k * p) / math.sqrt(k * (1 - k / rows) * p * (1 - p))
            if abs(z) >= LEAST_Z:
                scored.append((-abs(z), name))
    return [name for _, name in sorted(scored)]


def solve(times: Callable[[np.ndarray], np.ndarray], target: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Conjugate gradients for a positive definite matrix that is given by its products."""
    x, left = np.zeros(len(target)), target.copy()
    z = left / diagonal
    way, now = z.copy(), float(left @ z)
    least = 1e-6 * now  # Newton steps need no more
    for _ in range(MOST_STEPS):
        if now <= least:
            break
        ahead = times(way)
        length = now / float(way @ ahead)
        x += length * way
        left -= length * ahead
        z = left / diagonal
        now, last = float(left @ z), now
        way = z + now / last * way
    return x


def fit_link(name: str, chosen: list[str], rows: list[set[str]], before: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression by Newton steps on the chosen features and the earlier probabilities."""
    width = before.shape[1]
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return Link(name, math.log(share / (1 - share)), {}, (0.0,) * width)
    # Features of the same rows get equal weights, so they are one column with a share of the penalty.
    places: dict[str, list[int]] = {f: [] for f in chosen}
    for r, present in enumerate(rows):
        for f in present:
            if f in places:
                places[f].append(r)
    groups: dict[tuple[int, ...], list[str]] = {}
    for f, found in places.items():
        groups.setdefault(tuple(found), []).append(f)
    index = {f: i for i, group in enumerate(groups.values(), 1 + width) for f in group}
    held: list[list[int]] = [[] for _ in rows]
    for i, group in enumerate(groups, 1 + width):
        for r in group:
            held[r].append(i)
    size = 1 + width + len(groups)
    # The features are sparse: the rows and columns of their ones.
    row = np.repeat(np.arange(len(rows)), [len(h) for h in held])
    col = np.fromiter((i for h in held for i in h), dtype=int, count=len(row))
    dense = np.column_stack([np.ones(len(rows)), before])

    def times(v: np.ndarray) -> np.ndarray:
        return dense @ v[: 1 + width] + np.bincount(row, v[col], minlength=len(rows))

    def gathered(u: np.ndarray, own: np.ndarray = dense) -> np.ndarray:
        out = np.bincount(col, u[row], minlength=size).astype(float)
        out[: 1 + width] += own.T @ u
        return out

    strength = np.full(size, PENALTY)
    strength[0] = 1e-6
    alike = np.array([len(group) for group in groups.values()], dtype=float)
    strength[1 + width :] /= alike
    w = np.zeros(size)
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        slope, spread = gathered(p - y) + strength * w, p * (1 - p)
        bend = lambda v: gathered(spread * times(v)) + strength * v
        step = solve(bend, slope, gathered(spread, dense**2) + strength)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-3:
            break
    weights = {f: float(w[index[f]] / alike[index[f] - 1 - width]) for f in chosen}
    return Link(name, float(w[0]), weights, tuple(map(float, w[1 : 1 + width])))


def _categories(label: str, seeds: dict[str, tuple[str, ...]]) -> list[str]:
    return [*[name for name in seeds if name != label], label]


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = OVERALL,
    seeds: dict[str, tuple[str, ...]] = SEEDS,
    key: str = "doc_id",
    text: str = "text",
    rows: int = SAMPLE_ROWS,
    folds: int = FOLDS,
) -> Chain:
    """A chain from at most ``rows`` labelled documents.

    The labels tell only whether a text is toxic. A category before that holds for the toxic
    texts with one of its seed words; the models then find what else goes with it. Features are
    counted by fold on Spark, so each model chooses its own from rows it may see; the sample
    that reaches the driver has only chosen features.
    """
    names = _categories(label, seeds)
    picked = labelled.sample(docs, labels, F.col(label), key, text, rows)

    def start() -> Callable[..., tuple]:
        seed = {n: {w.encode() for w in seeds.get(n, ())} for n in names[:-1]}

        def work(value: bytes | None, toxic: int) -> tuple:
            words = folded_words(value)
            marks = [int(bool(toxic and seed[n] & words)) for n in names[:-1]] + [toxic]
            return sorted({f for w in words for f in features_of(w)}), marks

        return work

    at = add_columns(
        picked.select("labelled_key", "label", text),
        [utf8(text), F.col("label")],
        start,
        "features array<string>, marks array<int>",
    )
    fold = F.pmod(F.xxhash64("labelled_key"), F.lit(folds)).cast("int")
    at = keep(at.select("labelled_key", fold.alias("fold"), "features", "marks"), "toxicity-sample")
    cells = [(f, c) for f in range(folds) for c in range(-1, len(names))]

    def cell(f: int, c: int) -> Column:
        value = F.lit(1) if c < 0 else F.col("marks")[c]
        return F.sum(F.when(F.col("fold") == f, value).otherwise(0)).cast("double").alias(f"c{f}_{c}")

    sums = at.agg(*[F.coalesce(cell(f, c), F.lit(0.0)).alias(f"c{f}_{c}") for f, c in cells]).first()
    splits = {held: [f for f in range(folds) if f != held] for held in range(-1, folds)}
    wanted = [(held, c) for held in splits for c in range(len(names))]

    def clear(held: int, c: int) -> Column:
        total = sum(sums[f"c{f}_-1"] for f in splits[held])
        positive = sum(sums[f"c{f}_{c}"] for f in splits[held])
        if not 0 < positive < total:
            return F.lit(False)
        k, p = sum(F.col(f"c{f}_-1") for f in splits[held]), positive / total
        yes = sum(F.col(f"c{f}_{c}") for f in splits[held])
        far = F.pow(yes - k * p, 2) >= LEAST_Z**2 * k * (1 - k / total) * p * (1 - p)
        return (k >= LEAST_DOCUMENTS) & far

    # What comes to the driver is bounded by the sample: the features that tell the classes of
    # some category apart in some folds.
    counted = (
        at.select(F.explode("features").alias("feature"), "fold", "marks")
        .groupBy("feature")
        .agg(*[cell(f, c) for f, c in cells])
        .where(reduce(or_, [clear(*w) for w in wanted]))
        .collect()
    )
    choices = {
        (held, c): telling(
            {
                r.feature: tuple(sum(r[f"c{f}_{x}"] for f in splits[held]) for x in (-1, c))
                for r in counted
            },
            sum(sums[f"c{f}_-1"] for f in splits[held]),
            sum(sums[f"c{f}_{c}"] for f in splits[held]),
        )
        for held, c in wanted
    }
    chosen_ones = sorted({f for chosen in choices.values() for f in chosen})
    known = {f: i for i, f in enumerate(chosen_ones)}
    lean = add_columns(
        at.select("labelled_key", "fold", "marks", "features"),
        [F.col("features")],
        lambda: lambda present: ([known[f] for f in present if f in known],),
        "known array<int>",
    )
    found = sorted((r.labelled_key, r.fold, r.marks, r.known) for r in lean.drop("features").collect())
    texts = [{chosen_ones[i] for i in f} for _, _, _, f in found]
    fold_of = np.array([f for _, f, _, _ in found], dtype=int)
    before, links = np.zeros((len(found), 0)), []
    for c, name in enumerate(names):
        y = np.array([m[c] for _, _, m, _ in found], dtype=float)
        links.append(fit_link(name, choices[-1, c], texts, before, y))
        unseen = np.zeros(len(found))
        for f in range(folds) if c + 1 < len(names) else ():
            seen, held = np.flatnonzero(fold_of != f), np.flatnonzero(fold_of == f)
            part = fit_link(name, choices[f, c], [texts[i] for i in seen], before[seen], y[seen])
            unseen[held] = [part.probability(texts[i], before[i]) for i in held]
        before = np.column_stack([before, unseen])
    return Chain(tuple(links))


def score(docs: DataFrame, chain: Chain, text: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``out`` of one probability per category, named after it."""
    names = [link.name for link in chain.links]

    def start() -> Callable[[bytes | None], tuple]:
        features = Recogniser(chain.known())
        return lambda t: (dict(zip(names, chain.probabilities(features(t)))),)

    fields = ", ".join(f"`{n}`: double" for n in names)
    return add_columns(docs, [utf8(f"`{text}`")], start, f"`{out}` struct<{fields}>")
