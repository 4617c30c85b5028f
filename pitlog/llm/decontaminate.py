"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are cut into alphanumeric words (A-Z folded). The items go into one
automaton over words; a document's words stream through it while it tracks the longest match
that ends at each word. Where that length reaches ``window`` the matched words are hit; an
item shorter than the window, but not empty, is hit where it occurs as a whole. Each hit also
names the items it comes from. No n-gram table is built and nothing is shuffled: documents
are scanned where they lie.

The items travel to every task in blocks of about ``BLOCK_BYTES`` of text, dealt by a hash of
distinct items and read one at a time, so neither the driver nor what is broadcast grows with the
benchmark; a larger benchmark means more passes over the texts. Those passes write only the rows
that were hit, by a row number, and one last pass joins them to the documents. An item longer than
a block is a block of its own.

A null or empty text has no words, no hits and is not contaminated. Items without words match
nothing; a missing item id is named "null". Repeated items count once by their id; repeated
documents are judged one by one. Very long texts and items are taken whole. Without items nothing
is hit. A column with the name of the result is replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitlog.llm.common import add_columns, folded, free_name, keep, others, utf8

WINDOW = 13
LEAST_COVERAGE = 0.05
BLOCK_BYTES = 1_500_000

Spans = list[tuple[int, int]]


class SuffixAutomaton:
    """All word sequences of some items, with the items of each window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        coded = [(i, [self.words.setdefault(w, len(self.words)) for w in ws]) for i, ws in items if ws]
        ends = []  # (state of the whole item, item) of the short ones
        for item, codes in coded:
            state = 0
            for code in codes:
                state = self._extend(state, code)
            if len(codes) < window:
                ends.append((codes, item))
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        # The shortest state on the way to the root that still holds ``window`` words.
        self.wide = [-1] * len(self.link)
        for s in order:
            up = self.link[s]
            if self.length[s] >= window:
                self.wide[s] = s if self.length[up] < window else self.wide[up]
        self.items: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        for codes, item in ends:
            state = 0
            for code in codes:
                state = self.next[state][code]
            self.whole.setdefault(state, set()).add(item)
        for item, codes in coded:
            state = 0
            for k, code in enumerate(codes, 1):
                state = self.next[state][code]
                if k >= window:
                    self.items.setdefault(self.wide[state], set()).add(item)
        # The nearest state from here to the root at which a short item ends.
        self.short = [0] * len(self.link)
        for s in order:
            self.short[s] = s if s in self.whole else self.short[self.link[s]]
        self.least = min([window, *(len(codes) for codes, _ in ends)])

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.link) - 1

    def _split(self, state: int, code: int) -> int:
        """The state that ``code`` leads to from ``state``, holding no longer sequences than it should."""
        target = self.next[state][code]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(code) == target:
            self.next[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, state: int, code: int) -> int:
        if code in self.next[state]:
            return self._split(state, code)
        made = self._state(self.length[state] + 1, 0, {})
        while state >= 0 and code not in self.next[state]:
            self.next[state][code] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, code)
        return made

    def scan(self, words: list[bytes]) -> tuple[Spans, set[str]]:
        """Hit spans of word positions, disjoint and in order, and the items behind them."""
        following, link, length, least = self.next, self.link, self.length, self.least
        spans: Spans = []
        found: set[str] = set()
        state = matched = 0
        for i, code in enumerate(map(self.words.get, words)):
            if code is None:
                state = matched = 0
                continue
            target = following[state].get(code)
            if target is None:
                while code not in following[state]:
                    state = link[state]
                matched = length[state]
                target = following[state][code]
            state = target
            matched += 1
            if matched >= least:
                self._hit(state, matched, i + 1, spans, found)
        return spans, found

    def _hit(self, state: int, matched: int, end: int, spans: Spans, found: set[str]) -> None:
        longest = 0
        if matched >= self.window:
            longest = matched
            found |= self.items[self.wide[state]]
        short = self.short[state]
        while short:
            if self.length[short] <= matched:
                longest = max(longest, self.length[short])
                found |= self.whole[short]
            short = self.short[self.link[short]]
        if longest:
            add_span(spans, end - longest, end)


def add_span(spans: Spans, start: int, end: int) -> None:
    """Add a span whose end is not before the others' and merge what it touches or covers."""
    while spans and spans[-1][1] >= start:
        start = min(start, spans.pop()[0])
    spans.append((start, end))


def union(*parts: Spans) -> Spans:
    out: Spans = []
    for start, end in sorted((s for p in parts for s in p), key=lambda s: (s[1], s[0])):
        add_span(out, start, end)
    return out


_WORD = re.compile(rb"[^ ]+")


def without(text: bytes, spans: Spans) -> bytes:
    """``text`` less the words of ``spans`` and what stands between them."""
    at = [m.span() for m in _WORD.finditer(folded(text))]
    out, last = [], 0
    for start, end in spans:
        out.append(text[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*out, text[last:]])


_AUTOMATA: dict[str, SuffixAutomaton] = {}


Items = list[tuple[str, bytes]]


def _blocks(items: DataFrame, item_id: str, text: str) -> tuple[int, Callable[[int], Items]]:
    """How many blocks the distinct items make, and a reader of each."""
    sized = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), utf8(text).alias("text")
    ).where("text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    if total <= BLOCK_BYTES:
        return 1, lambda _: [(r.item, bytes(r.text)) for r in sized.distinct().collect()]
    # Repeated items are one before they are dealt, or a few could fill a block.
    sized = keep(sized.distinct(), "contamination-items")
    long = F.length("text") > BLOCK_BYTES
    row = sized.agg(F.sum(F.when(~long, F.length("text"))).alias("short"), F.count_if(long).alias("long")).first()
    n, lone = -(-(row.short or 0) // BLOCK_BYTES), row.long
    dealt = F.pmod(F.xxhash64("item", "text"), F.lit(max(n, 1)))

    def read(k: int) -> Items:
        if k < n:
            some = sized.where(~long & (dealt == k))
        else:
            some = sized.where(long).orderBy("item", "text").offset(k - n).limit(1)
        return [(r.item, bytes(r.text)) for r in some.collect()]

    return n + lone, read


def _scanner(block: Items, window: int, spark: SparkSession) -> Callable[[], Callable[..., tuple]]:
    """A task's function: words of a text, hit spans and items; one automaton a worker process."""
    shared, own = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    def start() -> Callable[..., tuple]:
        if own not in _AUTOMATA:
            _AUTOMATA.clear()
            _AUTOMATA[own] = SuffixAutomaton([(i, folded(t).split()) for i, t in shared.value], window)
        scan = _AUTOMATA[own].scan

        def work(t: bytes | None) -> tuple:
            words = folded(t).split() if t else []
            spans, items = scan(words)
            hits = sum(e - s for s, e in spans)
            return len(words), hits, sorted(items), [s for s, _ in spans], [e for _, e in spans]

        return work

    return start


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "contamination",
) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, n_hit, items (sorted) and spans of word positions."""
    names = {k: free_name(docs, f"{out}_{k}") for k in ("words", "hits", "items", "starts", "ends")}
    ddl = (
        f"`{names['words']}` bigint, `{names['hits']}` bigint, `{names['items']}` array<string>, "
        f"`{names['starts']}` array<bigint>, `{names['ends']}` array<bigint>"
    )
    n, read = _blocks(items, item_id, item_text)
    if n <= 1:
        at = add_columns(docs, [utf8(f"`{text}`")], _scanner(read(0), window, docs.sparkSession), ddl)
    else:
        at = _find_in_blocks(docs, text, n, read, window, names, ddl)
    struct = F.struct(
        F.col(names["words"]).alias("n_words"),
        F.col(names["hits"]).alias("n_hit"),
        F.col(names["items"]).alias("items"),
        F.arrays_zip(F.col(names["starts"]).alias("start"), F.col(names["ends"]).alias("end")).alias("spans"),
    )
    return at.select(*others(docs, out), struct.alias(out))


def _find_in_blocks(
    docs: DataFrame, text: str, n: int, read: Callable[[int], Items], window: int, names: dict[str, str], ddl: str
) -> DataFrame:
    """The hits of all blocks together; rows are known by a number, as ids may repeat."""
    row = free_name(docs, "row")
    at = keep(docs.withColumn(row, F.monotonically_increasing_id()), "contamination-rows")
    parts = []
    for k in range(n):
        found = add_columns(
            at.select(row, utf8(f"`{text}`").alias("t")),
            [F.col("t")],
            _scanner(read(k), window, docs.sparkSession),
            "words bigint, hits bigint, items array<string>, starts array<bigint>, ends array<bigint>",
        )
        parts.append(keep(found.where("hits > 0").select(row, "items", "starts", "ends"), "contamination-hits"))
    hit = reduce(DataFrame.unionAll, parts).groupBy(row).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(f"{row}_items"),
        F.collect_list(F.arrays_zip("starts", "ends")).alias(f"{row}_spans"),
    )
    joined = at.join(hit, row, "left")

    def start() -> Callable[..., tuple]:
        def work(t: bytes | None, items: list | None, spans: list | None) -> tuple:
            parts = [[(s["starts"], s["ends"]) for s in one] for one in spans or []]
            whole = union(*parts)
            words = len(folded(t).split()) if t else 0
            hits = sum(e - s for s, e in whole)
            return words, hits, items or [], [s for s, _ in whole], [e for _, e in whole]

        return work

    inputs = [utf8(f"`{text}`"), F.col(f"`{row}_items`"), F.col(f"`{row}_spans`")]
    return add_columns(joined, inputs, start, ddl).drop(row, f"{row}_items", f"{row}_spans")


def contaminated(found: Column, least_coverage: float = LEAST_COVERAGE) -> Column:
    """Whether the hit words are at least this share of all words."""
    hit, words = found["n_hit"], found["n_words"]
    return (hit > 0) & (hit >= F.lit(least_coverage).cast("decimal(18,9)") * words)


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    least_coverage: float = LEAST_COVERAGE,
) -> DataFrame:
    """``docs`` without contaminated rows; shorter shared spans are cut out of the others.

    Columns and untouched texts stay as they are.
    """
    mark, cut = free_name(docs, "contamination"), free_name(docs, "text_cut")
    at = find(docs, items, text, item_id, item_text, window, mark)
    at = at.where(~contaminated(F.col(mark), least_coverage))

    def start() -> Callable[..., tuple]:
        return lambda t, s, e: (without(t, list(zip(s, e))).decode("utf-8", "replace") if s else None,)

    spans = F.col(mark)["spans"]
    at = add_columns(at, [utf8(f"`{text}`"), spans["start"], spans["end"]], start, f"`{cut}` string")
    kept = F.coalesce(F.col(cut), F.col(f"`{text}`")).alias(text)
    return at.select(*[kept if c == text else F.col(f"`{c}`") for c in docs.columns])
