"""Exact Jaccard join of word shingle sets by partitioning the universe.

Two sets with similarity of at least t percent differ in at most d tokens, where
d (100 + t) <= (100 - t) (|r| + |s|). Tokens (hashed shingles) are dealt into m segments by
their hash. If every segment may differ in less than a tokens, the pigeonhole gives at least
m - floor(d / a) segments in which the two sets differ in less than a: with a = 1 the segments
are equal, with a = 2 one token apart, which shows as an equal pair among the segment and its
one-deletion neighbours. So sets that share a key for such a segment are the candidates.

Sizes fall into bands by d, which grow geometrically; a set joins the (one to three) bands of
its possible partners. Each band's a and m are allocated by cost: keys to index against the
candidates expected from segments that are empty by chance. There are more segments than the
pigeonhole needs, so that a set's full ones suffice: it is not indexed under empty segments,
which many sets have, unless too few are full.

What is indexed is one set per class of equal sets, by a 128-bit hash (its first half names it in
lists). Candidates are reduced before they are verified. All sets order keys alike, by the length
of their lists. Two similar sets share at least one key more than either may do without, and the
first one that they share has all others behind it; so each set leaves out as many of its last
keys as it may, which are those of passages that many texts share. In rounds each set then meets
one head of its lists that its sketch (parities of token counts) allows, at first the member with
the most company; sets found linked are one component, and lists within one component are done.
Rounds end when they find little more. At last every pair of a list whose components differ is
tried, at the first key that both list: if the sketches do not rule it out, it is verified. So no
link between components is lost, while a group of near copies costs a few checks a member and not
one a pair. Verification compares the shingles of the whole texts themselves.

A text without words (or null) has no shingles and links with nothing. Very long texts are taken
whole. Repeated rows and equal texts are one class. A row without an id takes part like others but names no component; a
component of such rows only has the id null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pitlog.llm.common import add_columns, free_name, keep, small_batches
from pitlog.llm.components import components

SHINGLE = 5
PERCENT = 80
BAND_GROWTH = 1.5
PAIR_COST = 20.0  # of a candidate pair, in index keys
IDS_BROADCAST = 500_000
SETS_BROADCAST = 50_000
ROUNDS = 8
LEAST_PROGRESS = 0.05  # of the open entries that a round has to close for another one
FIRST_KEYS = 24
SKETCH_WORDS = 16
REMEMBERED = 300_000

_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BAND = np.uint64(63)
_S30, _S27, _S31, _S32 = (np.uint64(k) for k in (30, 27, 31, 32))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = (x ^ (x >> _S30)) * _C1
    x = (x ^ (x >> _S27)) * _C2
    return x ^ (x >> _S31)


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes], k: int = SHINGLE) -> set[tuple[bytes, ...]]:
    """The exact set: runs of ``k`` words, or the whole of a shorter text."""
    if not words:
        return set()
    return set(zip(*[words[i:] for i in range(k)])) if len(words) >= k else {tuple(words)}


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def tokens(words: list[bytes], memory: dict[bytes, int], k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    n = len(words)
    w = np.fromiter(map(memory.__getitem__, words), dtype=np.uint64, count=n)
    k = min(k, n)
    h = np.full(n - k + 1 if n else 0, k, dtype=np.uint64)
    for i in range(k):
        h = _mix(h + _STEP) + w[i : n - k + 1 + i]
    return np.unique(_mix(h))


def most_different(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of similar sets of these sizes."""
    return (100 - percent) * (a + b) // (100 + percent)


def partner_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    return -(-percent * n // 100), 100 * n // percent


@lru_cache(None)
def band_limit(k: int) -> int:
    """The largest difference of band ``k``: 1, 2, 3, 4, 6, 9, ... (band -1 has none)."""
    if k < 0:
        return 0
    return max(band_limit(k - 1) + 1, int(band_limit(k - 1) * BAND_GROWTH))


def band_of(difference: int) -> int:
    k = 0
    while band_limit(k) < difference:
        k += 1
    return k


def _at_most(size: int, m: int, tokens: int) -> tuple[float, float]:
    """Mean and deviation of how many of m segments get at most ``tokens`` (0 or 1) of ``size``."""
    if m == 1:
        return float(size <= tokens), 0.0
    q = math.exp(-size / m) * (1 + (size / m if tokens else 0.0))
    return m * q, math.sqrt(m * q * (1 - q))


@lru_cache(None)
def allocation(band: int, n_sets: int, percent: int = PERCENT) -> tuple[int, int]:
    """(a, m) of a band with the least cost for a set of its smallest size.

    Cost is the number of keys plus the candidates that come from nearly empty segments: a set
    with too few full ones has to be indexed under its empty ones as well.
    """
    limit = band_limit(band)
    size = max(1, (band_limit(band - 1) + 1) * percent // (100 - percent))
    best = None
    for a in (1, 2):
        need = limit // a + 1
        for m in sorted({need + need * step // 20 for step in range(21)}):
            mean, deviation = _at_most(size, m, a - 1)
            over = (mean - (m - need)) - 0.5
            fails = float(over > 0) if not deviation else math.erfc(-over / deviation / math.sqrt(2)) / 2
            keys = (m + need) / 2 + (size if a == 2 else 0)
            cost = keys + PAIR_COST * n_sets * fails**2 * max(mean, 1.0) ** 2 / m
            if best is None or cost < best[0]:
                best = (cost, a, m)
    return best[1], best[2]


def index_keys(h: np.ndarray, n_sets: int, percent: int = PERCENT) -> tuple[np.ndarray, dict[int, int]]:
    """The keys under which a set may be found, and by band how many of them it may do without.

    ``h`` are its sorted distinct token hashes. A differing token spoils one segment, so of the
    segments with at least a tokens all but floor(d / a) are close to the partner's; so there is
    no key for an empty segment unless too few are full. What is spare beyond one common key may
    be left out, if both partners leave out their last keys in one order. The band is in the low
    bits of a key.
    """
    n = len(h)
    low, high = partner_sizes(n, percent)
    least, most = most_different(n, low, percent), most_different(n, high, percent)
    out, spare = [np.empty(0, dtype=np.uint64)], {}
    if not most:
        return out[0].view(np.int64), spare
    t = _mix(h + _STEP)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(t)])
    for band in range(band_of(max(least, 1)), band_of(most) + 1):
        a, m = allocation(band, n_sets, percent)
        need = min(most, band_limit(band)) // a + 1
        # Hashes are sorted, so a segment is a range of them.
        segment = ((h >> _S32) * np.uint64(m)) >> _S32
        at = np.searchsorted(segment, np.arange(m + 1, dtype=np.uint64))
        count = np.diff(at)
        full = int((count >= a).sum())
        some = count > 0 if full >= need else count >= 0
        if a == 1:
            spare[band] = max(0, full - need)
        salt = _mix((np.uint64(band + 1) << _S32) + np.arange(m, dtype=np.uint64))
        total = sums[at[1:]] - sums[at[:-1]]
        keys = [_mix(total + salt)[some]]
        if a == 2:
            row = segment.astype(np.int64)
            keys.append(_mix(total[row] - t + salt[row])[count[row] > 1 if full >= need else slice(None)])
        out.append((np.concatenate(keys) & ~_BAND) | np.uint64(min(band, int(_BAND))))
    return np.unique(np.concatenate(out)).view(np.int64), spare


def sketch(h: np.ndarray) -> np.ndarray:
    """One bit for each of 1,024 ranges: whether an odd number of tokens falls into it.

    A token that two sets do not share changes one bit, so they differ by as many at least.
    """
    odd = np.bincount((h >> np.uint64(64 - 10)).astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fingerprint(h: np.ndarray) -> bytes:
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def index(docs: DataFrame, key: str, text: str, n_sets: int, percent: int, k: int) -> DataFrame:
    """A row per document: doc, n, set (a hash of it), short (64 bits of that), sketch, keys, spare.

    A task gives the keys of a set only once, so exact copies cost nothing downstream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, seen = _Words(), set()
        for batch in batches:
            rows = []
            for value in batch.column(1).to_pylist():
                h = tokens(words_of(value), memory, k)
                if not len(h):
                    rows.append((0, None, None, None, None, None))
                    continue
                mark, keys, spare = fingerprint(h), None, None
                if mark not in seen:
                    seen.add(mark)
                    keys, spare = index_keys(h, n_sets, percent)
                    spare = [{"band": band, "may": may} for band, may in spare.items() if may]
                rows.append((len(h), mark, int.from_bytes(mark[:8], signed=True), sketch(h), keys, spare))
            kinds = [
                pa.int64(),
                pa.binary(),
                pa.int64(),
                pa.list_(pa.int64()),
                pa.list_(pa.int64()),
                pa.list_(pa.struct([("band", pa.int64()), ("may", pa.int64())])),
            ]
            made = [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *made], names=["doc", "n", "set", "short", "sketch", "keys", "spare"]
            )

    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(f"`{key}`").cast("bigint").alias("doc"), F.col(f"`{text}`").cast("binary").alias("t"))
    return chosen.mapInArrow(
        run,
        "doc bigint, n bigint, set binary, short bigint, sketch array<bigint>, keys array<bigint>, "
        "spare array<struct<band: bigint, may: bigint>>",
    )


def lists(rows: DataFrame) -> DataFrame:
    """(key, short, company) of the keys that several sets share, less those a set may do without.

    Each set leaves out the longest of its lists. Those of passages that many documents share are
    long, and few of a set's segments consist of one only. ``company`` is the length of all lists
    of a set together: most for the least changed of a group of near copies.
    """
    entries = rows.where("keys is not null").select(F.explode("keys").alias("key"), "short")
    every = W.partitionBy("key")
    shared = entries.select(
        "key",
        "short",
        F.min("short").over(every).alias("one"),
        F.max("short").over(every).alias("other"),
        F.count("*").over(every).alias("size"),
    )
    shared = shared.where("one != other").select("key", "short", "size").distinct()
    may = rows.where("spare is not null").select("short", F.explode("spare").alias("s"))
    may = may.select("short", F.col("s.band").alias("band"), F.col("s.may").alias("may")).distinct()
    # One order for all sets: what two of them leave out never holds the first key they share.
    place = F.row_number().over(W.partitionBy("short", "band").orderBy(F.desc("size"), "key"))
    company = F.sum("size").over(W.partitionBy("short"))
    return (
        shared.withColumn("band", F.col("key").bitwiseAND(63))
        .join(may, ["short", "band"], "left")
        .withColumns({"place": place, "company": company})
        .where("may is null or place > may")
        .select("key", "short", "company")
    )


def _differ(bits: str, other: str) -> Column:
    """In how many bits two sketches differ: no more than the sets differ in tokens."""
    return reduce(add, [F.bit_count(F.col(bits)[i].bitwiseXOR(F.col(other)[i])) for i in range(SKETCH_WORDS)])


def _allowed(percent: int) -> Column:
    """Whether sizes (n, n_2) and sketches (sketch, sketch_2) leave a link possible."""
    sizes = 100 * F.least("n", "n_2") >= percent * F.greatest("n", "n_2")
    most = F.floor((100 - percent) * (F.col("n") + F.col("n_2")) / (100 + percent))
    return sizes & (_differ("sketch", "sketch_2") <= most)


def nearest_heads(entries: DataFrame, sets: DataFrame, step: int, percent: int) -> DataFrame:
    """For each set (y, in component cy): the head (x, in cx), of another one, of most of its lists.

    ``entries`` are (key, short, company, component). A list's head is its member with the most
    company at first, then its least one by a seeded hash, another one in every round. Heads that
    sketches rule out are no candidates. Heads are grouped and joined back, so that a long list
    is combined before it is shuffled and its members may lie in several tasks.
    """
    rank = F.xxhash64("short", F.lit(step)) if step else -F.col("company")
    heads = entries.groupBy("key").agg(F.min(F.struct(rank.alias("h"), "short", "component")).alias("head"))
    met = entries.join(heads, "key").where("component != head.component")
    counts = met.groupBy("short", "component", "head.short", "head.component").agg(F.count("*").alias("n_keys"))
    counts = counts.toDF("y", "cy", "x", "cx", "n_keys")
    if step:
        one = sets.select(F.col("short").alias("x"), "n", "sketch")
        two = sets.select(F.col("short").alias("y"), F.col("n").alias("n_2"), F.col("sketch").alias("sketch_2"))
        counts = counts.join(one, "x").join(two, "y").where(_allowed(percent))
    best = counts.groupBy("y", "cy").agg(F.max(F.struct("n_keys", "x", "cx")).alias("best"))
    return best.select(F.col("best.x").alias("x"), "y", F.col("best.cx").alias("cx"), "cy")


def still_open(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``entries`` with linked components merged, less the lists that lie within one component.

    Each component hangs on the least of those it is linked to, and on what that hangs on. What
    is merged is connected; links that this leaves out are found again when components are built.
    """
    up = links.where("cx != cy").groupBy(F.greatest("cx", "cy").alias("c")).agg(F.min(F.least("cx", "cy")).alias("to"))
    up = keep(up, "jaccard-merges")
    top = up.select(F.col("c").alias("to"), F.col("to").alias("top"))
    few = up.count() <= IDS_BROADCAST
    up = up.join(F.broadcast(top) if few else top, "to", "left").select("c", F.coalesce("top", "to").alias("to"))
    at = entries.join(F.broadcast(up) if few else up, F.col("component") == F.col("c"), "left")
    at = at.select("key", "short", "company", F.coalesce("to", "component").alias("component"))
    spread = at.groupBy("key").agg(F.min("component").alias("one"), F.max("component").alias("other"))
    open_lists = spread.where("one != other").select("key")
    return keep(at.join(open_lists, "key"), "jaccard-open")


def _named(pairs: DataFrame, sets: DataFrame, few: bool) -> DataFrame:
    """Pairs of short hashes (x, y) with the set hashes (a, b)."""
    for side, name in (("x", "a"), ("y", "b")):
        one = sets.select(F.col("short").alias(side), F.col("set").alias(name))
        pairs = one.join(F.broadcast(pairs) if few else pairs, side)
    return pairs


def verify(
    docs: DataFrame, sets: DataFrame, pairs: DataFrame, key: str, text: str, percent: int, k: int
) -> DataFrame:
    """The pairs (x, y, cx, cy) of similar sets, with their set hashes (a, b).

    The shingles of the texts are compared as words.
    """
    pairs = keep(pairs, "jaccard-pairs")
    few = pairs.count() <= IDS_BROADCAST
    pairs = keep(_named(pairs, sets, few), "jaccard-pairs")
    wanted = pairs.select(F.col("a").alias("set")).unionAll(pairs.select("b")).distinct()
    wanted = keep(sets.select("set", "rep").join(F.broadcast(wanted) if few else wanted, "set"), "jaccard-wanted")
    named = docs.select(
        F.col(f"`{key}`").cast("bigint").alias("d"), F.col(f"`{text}`").cast("binary").alias("t")
    )
    ids, marks = wanted.select("rep").distinct(), wanted.select("set")
    texts = named.join(F.broadcast(ids) if few else ids, F.col("d").eqNullSafe(F.col("rep")), "left_semi")
    # An id may stand for several texts: each is hashed once, and one text of each set is taken.
    texts = with_set(texts, "t", "set", k).join(F.broadcast(marks) if few else marks, "set", "left_semi")
    texts = keep(texts.groupBy("set").agg(F.first("t").alias("t")), "jaccard-texts")
    left = texts.select(F.col("set").alias("a"), F.col("t").alias("text_a"))
    right = texts.select(F.col("set").alias("b"), F.col("t").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a")

    def similar() -> Callable[..., tuple]:
        last: list = [None, None]

        def work(a: bytes, one: bytes, two: bytes) -> tuple:
            if last[0] != a:
                last[:] = [a, shingles(words_of(one), k)]
            other = shingles(words_of(two), k)
            common = len(last[1] & other)
            return (100 * common >= percent * (len(last[1]) + len(other) - common),)

        return work

    judged = add_columns(both, [F.col("a"), F.col("text_a"), F.col("text_b")], similar, "linked boolean")
    return keep(judged.where("linked").select("x", "y", "cx", "cy", "a", "b"), "jaccard-links")


def with_set(docs: DataFrame, text: str, out: str, k: int) -> DataFrame:
    """``docs`` with the hash of the set of each text; null if it has no words."""

    def start() -> Callable[..., tuple]:
        memory = _Words()

        def work(t: bytes | None) -> tuple:
            h = tokens(words_of(t), memory, k)
            return (fingerprint(h) if len(h) else None,)

        return work

    return add_columns(docs, [F.col(f"`{text}`").cast("binary")], start, f"`{out}` binary")


def _crossing(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (x, y) of a list whose components differ and whose sketches allow a link.

    A pair of sets that share several keys comes from the first one only, if that is among the
    first keys of both; what is left of repetitions goes before the shuffle.
    """
    first = F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS)
    about = entries.groupBy("short").agg(first.alias("first")).join(sets.select("short", "n", "sketch"), "short")
    one = entries.select("key", "short", "component").join(about, "short").withColumnRenamed("short", "x")
    two = one.toDF("y", "key", "component_2", "first_2", "n_2", "sketch_2")
    fits = (F.col("x") < F.col("y")) & (F.col("component") != F.col("component_2")) & _allowed(percent)
    common = F.array_intersect("first", "first_2")
    fits &= (F.size(common) == 0) | (F.try_element_at(common, F.lit(1)) == one["key"])
    met = one.join(two, (one["key"] == two["key"]) & fits)
    return met.select("x", "y", F.col("component").alias("cx"), F.col("component_2").alias("cy")).distinct()


def labelled(
    docs: DataFrame, key: str, text: str, percent: int = PERCENT, k: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """(doc, n, set) of every document, and (set, label) of every set; a component is one label."""
    n_sets = max(1, docs.count())
    # Cost figures need only the order of magnitude; rounding keeps plans alike.
    rows = keep(index(docs, key, text, 1 << n_sets.bit_length(), percent, k), "jaccard-index")
    sets = keep(
        rows.where("set is not null")
        .groupBy("set")
        .agg(*[F.min(c).alias(a) for c, a in (("doc", "rep"), ("n", "n"), ("short", "short"), ("sketch", "sketch"))]),
        "jaccard-sets",
    )
    entries = keep(lists(rows), "jaccard-lists").withColumn("component", F.col("short"))
    links, left = [], entries.count()
    for step in range(ROUNDS):
        # Rounds against heads join most of what is similar; then all that is still apart is tried.
        links.append(verify(docs, sets, nearest_heads(entries, sets, step, percent), key, text, percent, k))
        entries = still_open(entries, links[-1])
        before, left = left, entries.count()
        if before - left < LEAST_PROGRESS * before or not left:
            break
    if left:
        links.append(verify(docs, sets, _crossing(entries, sets, percent), key, text, percent, k))
    found = keep(components(reduce(DataFrame.unionAll, [one.select("a", "b") for one in links])), "jaccard-components")
    few = found.count() <= IDS_BROADCAST
    found = found.withColumnRenamed("node", "set")
    known = sets.select("set", "rep").join(F.broadcast(found) if few else found, "set", "left")
    known = keep(known.select("set", "rep", F.coalesce("component", "set").alias("label")), "jaccard-labels")
    return rows.select("doc", "n", "set"), known


def classes(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = PERCENT,
    k: int = SHINGLE,
) -> DataFrame:
    """A row per document: key, n_shingles and component_id."""
    rows, known = labelled(docs, key, text, percent, k)
    least = known.groupBy("label").agg(F.min("rep").alias("component_id"))
    few = known.count() <= SETS_BROADCAST
    known = known.join(least, "label").select("set", "component_id")
    out = rows.join(F.broadcast(known) if few else known, "set", "left")
    return out.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, k: int = SHINGLE
) -> DataFrame:
    """``docs`` with one row left of each component: one with its smallest id (null last).

    Of several texts of a component under that id the one whose set has the least hash stays, of
    rows of equal sets one. Texts without words stay.
    """
    rows, known = labelled(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text, percent, k)
    few = known.count() <= SETS_BROADCAST
    known = known.select("set", "label")
    members = rows.where("set is not null").join(F.broadcast(known) if few else known, "set")
    order = F.struct(F.col("doc").isNull().alias("no_id"), "doc", "set")
    stays = members.groupBy("label").agg(F.min(order).alias("s")).select("s.doc", "s.set", F.lit(True).alias("stays"))
    stays = keep(stays, "jaccard-stays")
    few = stays.count() <= IDS_BROADCAST
    same = F.col("r.doc").eqNullSafe(F.col("s.doc")) & (F.col("r.set") == F.col("s.set"))
    at = rows.alias("r").join((F.broadcast(stays) if few else stays).alias("s"), same, "left")
    at = at.select("r.doc", (F.col("stays").isNotNull() | (F.col("n") == 0)).alias("stays"))
    ids = at.groupBy("doc").agg(F.max("stays").alias("some"), F.count("*").alias("n"))
    ids = keep(ids.where("not some or n > 1 or doc is null"), "jaccard-ids")
    name, mark = free_name(docs, "doc"), free_name(docs, "set")

    def listed(which: str) -> DataFrame:
        some = ids.where(which).select(F.col("doc").alias(name))
        return F.broadcast(some) if some.count() <= IDS_BROADCAST else some

    match = docs[key].cast("bigint").eqNullSafe(F.col(name))
    left = docs.join(listed("not some"), match, "left_anti")
    if ids.where("some and (n > 1 or doc is null)").isEmpty():
        return left
    # Only rows whose id is missing or repeated are hashed again, to tell their texts apart.
    odd = listed("some and (n > 1 or doc is null)")
    again = with_set(left.join(odd, match, "left_semi"), text, mark, k)
    empty = again.where(F.col(mark).isNull())
    chosen = stays.select(F.col("doc").alias(name), F.col("set").alias(f"{mark}_2"))
    chosen = F.broadcast(chosen) if few else chosen
    same = again[key].cast("bigint").eqNullSafe(F.col(name)) & (again[mark] == chosen[f"{mark}_2"])
    once = again.join(chosen, same, "left_semi").dropDuplicates([key, mark])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return left.join(odd, match, "left_anti").unionByName(once.unionByName(empty).select(*columns))
