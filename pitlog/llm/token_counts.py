"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character; dynamic
programming carries the best score and its number of pieces, and no pieces are built. Of two
paths with the same score the one found first from the left wins, which is the one with the
longer last piece: the rule of the unigram tokenizers this one is tested against. A character
without a piece costs the lowest score minus 10 and counts as its UTF-8 bytes where the
vocabulary has byte pieces, else neighbouring ones count as one unknown piece. Scores are
doubles.

The text is prepared as the tokenizer does: a space becomes U+2581, one more goes in front. No
piece has U+2581 after another character, so every path passes the start of a U+2581 run and
the best path is the sum of the best paths between such points. Those parts are short and
repeat, so a task keeps the results of recent ones.

Null and empty texts have 0 tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import ahocorasick
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import add_columns

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64

_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with their scores, and whether there are byte pieces.

    A vocabulary is a fixed file of some 10,000 entries, so it may travel to every task.
    """
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.get_piece_size())
    plain = [i for i in ids if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i))]
    pieces = [(p.id_to_piece(i), p.get_score(i)) for i in plain]
    if any(SPACE in piece.lstrip(SPACE) for piece, _ in pieces):
        raise ValueError("a piece has a space after another character")
    if SPACE not in dict(pieces):
        raise ValueError("the space itself is no piece")
    return pieces, any(p.is_byte(i) for i in ids)


def segmenter(pieces: list[tuple[str, float]], has_bytes: bool) -> Callable[[str], tuple[int, float]]:
    """A function from a prepared text to its number of tokens and best score."""
    automaton = ahocorasick.Automaton()
    for piece, score in pieces:
        automaton.add_word(piece, (len(piece), score))
    automaton.make_automaton()
    unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
    minus = float("-inf")

    def best(part: str) -> tuple[int, float]:
        scores, counts = [0.0], [0]
        strange = {}  # ends where the best path's last character is an unknown one
        score, count, single, at = minus, 0, False, 1

        def close() -> None:
            # The candidates for the end ``at`` are all seen. If no piece is its last character
            # alone, that may stand as unknown; it starts last and so loses ties.
            nonlocal score, count, single, at
            if not single and scores[-1] + unknown > score:
                score, count, strange[at] = scores[-1] + unknown, counts[-1], True
                if has_bytes:
                    count += len(part[at - 1].encode("utf-8", "surrogatepass"))
                else:
                    count += at - 1 not in strange
            scores.append(score)
            counts.append(count)
            score, count, single, at = minus, 0, False, at + 1

        for last, (length, value) in automaton.iter(part):
            while at <= last:
                close()
            candidate = scores[at - length] + value
            if candidate > score:
                score, count = candidate, counts[at - length] + 1
            single = length == 1
        while at <= len(part):
            close()
        return counts[-1], scores[-1]

    return best


class Counts(dict):
    """Token counts of words, remembered up to a bound; keys lack the U+2581 in front."""

    def __init__(self, pieces: list[tuple[str, float]], has_bytes: bool):
        super().__init__()
        self.best = segmenter(pieces, has_bytes)
        # A line break is in no piece, so it stands alone: one byte, and a cut on both sides.
        self.cuts = has_bytes and not any("\n" in piece for piece, _ in pieces)
        self.rest: dict[str, int] = {}

    def __missing__(self, key: str) -> int:
        if self.cuts and "\n" in key:
            first, *others = key.split("\n")
            return self[first] + sum(1 + self.bare(part) for part in others)
        return self.learn(self, key, SPACE + key)

    def bare(self, part: str) -> int:
        """The count of a part that starts after a line break."""
        return self.rest[part] if part in self.rest else self.learn(self.rest, part, part)

    def learn(self, memory: dict, key: str, part: str) -> int:
        n = self.best(part)[0]
        if len(key) <= LONGEST_REMEMBERED:
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[key] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            keys = [part[1:] for part in _PARTS.findall(SPACE + text.replace(" ", SPACE))]
        else:
            keys = text.split(" ")
        return sum(map(self.__getitem__, keys))


_COUNTS: dict[str, Counts] = {}


def count_tokens(
    docs: DataFrame, text: str = "text", path: str = VOCABULARY, n_tokens: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the number of tokens of each text in the new column ``n_tokens``."""
    pieces, has_bytes = read_vocabulary(path)
    shared, own = docs.sparkSession.sparkContext.broadcast(pieces), uuid.uuid4().hex

    def start() -> Callable[[str | None], tuple[int]]:
        # One automaton for all tasks of a worker process.
        if own not in _COUNTS:
            _COUNTS.clear()
            _COUNTS[own] = Counts(shared.value, has_bytes)
        count = _COUNTS[own].count
        return lambda t: (count(t),)

    return add_columns(docs, [F.col(text)], start, f"`{n_tokens}` bigint")
