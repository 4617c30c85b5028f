"""Personal data by weak supervision.

Base spans (email, ip, card, phone) are plain patterns with checks and always stay. Around
them the scan collects wider candidates of the same kinds and of ``id`` numbers: spelled-out
email addresses, card numbers and local phone numbers without a country code, and so on. Five
labelers vote on every candidate, base ones included: the strict pattern, a check (Luhn,
parts, area code), a gazetteer (issuers, top-level domains, country codes), the words before
the span, and its edges. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is per kind and how likely each pattern is personal data. Those
probabilities are the soft labels of a logistic span classifier over votes and shape, which
judges the candidates that are not base spans.

Votes and shapes have few values, so what reaches the driver is a table of pattern counts with
a fixed bound, whatever the size of the corpus; all candidates of all documents are in it.

A null or empty text has no spans. Repeated rows are scanned each; a candidate that touches a
base span is dropped in its favour. Without candidates the classifier adds nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import add_columns, free_name
from pitlog.llm.spans import Span, replaced

# The base kinds in the order in which they are listed, then the added one.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("id",)
LABELERS = ("pattern", "check", "gazetteer", "context", "edges")
THRESHOLD = 0.9
CONTEXT = 40  # code points before a span

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
# A longer digit run cannot start in its middle, so looking behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}"
    r"(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63})+"
)

# Words that speak for a kind when they stand before a span, and against all.
SPEAKS_FOR = {
    "email": ("email", "e-mail", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "client"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell"),
    "id": ("ssn", "social", "security", "taxpayer", "insurance"),
}
SPEAKS_AGAINST = ("order", "invoice", "isbn", "version", "page", "total", "serial", "part", "hash")
# Common top-level domains, card issuer prefixes, and country calling codes.
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "44", "49", "52", "55", "61", "81", "86", "91")

_WORDS = re.compile(r"[a-z][a-z-]*")


def digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octets(span: str) -> bool:
    parts = [p.lstrip("0") for p in span.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _emails(text: str) -> list[Span]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append(("email", start, last))
        at = text.find("@", max(last, at + 1))
    return out


def _numbers(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans made of digits, and the card-like runs that fail the check."""
    base: list[Span] = []
    if "." in text:
        base += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    failed: list[Span] = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            number = digits(m[0])
            if 13 <= len(number) <= 19:
                (base if luhn(number) else failed).append(("card", *m.span()))
    if "+" in text:
        base += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return base, failed


def _order(span: Span) -> tuple[int, int, int]:
    return (*KINDS, *ADDED).index(span[0]), span[1], span[2]


def base_spans(text: str) -> list[Span]:
    """Base spans by kind as listed, then start."""
    return sorted(_emails(text) + (_numbers(text)[0] if _DIGIT.search(text) else []), key=_order)


def candidate_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and other spans that may be personal data and touch none of those."""
    base, wide = _emails(text), []
    if "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        wide += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _DIGIT.search(text):
        numbers, failed = _numbers(text)
        base, wide = base + numbers, wide + failed
        wide += [("id", *m.span()) for m in _ID.finditer(text)]
        wide += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
    if wide:
        taken = sorted((s, e) for _, s, e in base)
        free: list[Span] = []
        for span in sorted(wide, key=lambda s: (s[1], _order(s))):
            while taken and taken[0][1] <= span[1]:
                taken.pop(0)
            if not (taken and taken[0][0] < span[2]) and not (free and span[1] < free[-1][2]):
                free.append(span)
        wide = free
    return sorted(base, key=_order), sorted(wide, key=_order)


def votes(text: str, span: Span, base: bool) -> str:
    """One of "+", "-" and "0" (abstains) from each labeler."""
    kind, start, end = span
    inside, number = text[start:end], digits(text[start:end])
    check = {
        "email": lambda: len(inside) <= 254 and ".." not in inside,
        "ip": lambda: not number.startswith("0") and inside.split(".")[0] not in ("0", "127", "255"),
        "card": lambda: luhn(number),
        "phone": lambda: len(set(number)) > 2,
        "id": lambda: number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00",
    }[kind]()
    known = {
        "email": lambda: re.split(r"[^A-Za-z0-9]+", inside.rstrip("-."))[-1].lower() in DOMAINS,
        "card": lambda: number.startswith(ISSUERS),
        "phone": lambda: number.startswith(CALLING) if inside[0] == "+" else None,
    }.get(kind, lambda: None)()
    before = set(_WORDS.findall(text[max(0, start - CONTEXT) : start].lower()))
    speaks = None
    if before.intersection(SPEAKS_FOR[kind]):
        speaks = True
    elif before.intersection(SPEAKS_AGAINST):
        speaks = False
    glued = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    said = (base or None, check, known, speaks, not glued)
    return "".join("0" if v is None else "+" if v else "-" for v in said)


def shape(text: str, span: Span) -> str:
    """A few coarse traits of a span; their values are bounded."""
    inside = text[span[1] : span[2]]
    separators = "".join(sorted(set(inside) & set(" .-()")))
    return f"{min(len(inside) // 4, 8)}|{min(len(digits(inside)), 20) // 3}|{separators}"


@dataclass(frozen=True)
class Reliability:
    """Per kind: the share of personal data, and of each labeler how it votes on the two classes."""

    share: float
    given_yes: list[dict[str, float]]
    given_no: list[dict[str, float]]

    def probability(self, pattern: str) -> float:
        yes = math.log(self.share) + sum(math.log(p[v]) for p, v in zip(self.given_yes, pattern))
        no = math.log1p(-self.share) + sum(math.log(p[v]) for p, v in zip(self.given_no, pattern))
        return 1 / (1 + math.exp(min(max(no - yes, -500), 500)))


def expectation_maximisation(counts: dict[str, float], rounds: int = 100, prior: float = 1.0) -> Reliability:
    """Reliabilities from counts of vote patterns, starting at the majority's view."""
    likely = {p: 1 / (1 + math.exp(-(p.count("+") - p.count("-")))) for p in counts}
    found = None
    for _ in range(rounds):
        yes = sum(n * likely[p] for p, n in counts.items())
        total = sum(counts.values())

        def table(j: int, of: Callable[[str], float], mass: float) -> dict[str, float]:
            return {
                v: (sum(n * of(p) for p, n in counts.items() if p[j] == v) + prior) / (mass + 3 * prior)
                for v in "+-0"
            }

        found = Reliability(
            (yes + prior) / (total + 2 * prior),
            [table(j, lambda p: likely[p], yes) for j in range(len(LABELERS))],
            [table(j, lambda p: 1 - likely[p], total - yes) for j in range(len(LABELERS))],
        )
        now = {p: found.probability(p) for p in counts}
        moved = max(abs(now[p] - likely[p]) for p in counts)
        likely = now
        if moved < 1e-6:
            break
    return found


@dataclass(frozen=True)
class SpanClassifier:
    """Logistic model over the kind, the votes and the shape of a span."""

    weights: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, Reliability] = field(default_factory=dict)

    @staticmethod
    def traits(kind: str, pattern: str, form: str) -> list[str]:
        length, n_digits, separators = form.split("|")
        voted = [f"{kind}:{name}{v}" for name, v in zip(LABELERS, pattern)]
        return ["", kind, *voted, f"{kind}:length{length}", f"{kind}:digits{n_digits}", f"{kind}:parts{separators}"]

    def probability(self, kind: str, pattern: str, form: str) -> float:
        if not self.weights:
            return 0.0
        x = sum(self.weights.get(t, 0.0) for t in self.traits(kind, pattern, form))
        return 1 / (1 + math.exp(min(max(-x, -500), 500)))


def fit(patterns: Iterable[tuple[str, str, str, int]], penalty: float = 1.0, steps: int = 25) -> SpanClassifier:
    """A classifier from (kind, votes, shape, count), by Newton steps on the soft labels."""
    rows = list(patterns)
    if not rows:
        return SpanClassifier()
    by_kind: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for kind, pattern, _, n in rows:
        by_kind[kind][pattern] += n
    reliability = {kind: expectation_maximisation(dict(counts)) for kind, counts in sorted(by_kind.items())}
    names: dict[str, int] = {}
    cells = [[names.setdefault(t, len(names)) for t in SpanClassifier.traits(*row[:3])] for row in sorted(rows)]
    rows = sorted(rows)
    x = np.zeros((len(rows), len(names)))
    for i, cell in enumerate(cells):
        x[i, cell] = 1.0
    y = np.array([reliability[k].probability(p) for k, p, _, _ in rows])
    n = np.array([r[3] for r in rows], dtype=float)
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (p - y)) + penalty * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(names))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return SpanClassifier({t: float(w[i]) for t, i in names.items()}, reliability)


CANDIDATE = "struct<kind: string, start: bigint, `end`: bigint, base: boolean, votes: string, shape: string>"


def _scan(text: str | None) -> list[dict]:
    if not text:
        return []
    base, wide = candidate_spans(text)
    return [
        {
            "kind": s[0],
            "start": s[1],
            "end": s[2],
            "base": known,
            "votes": votes(text, s, known),
            "shape": shape(text, s),
        }
        for spans, known in ((base, True), (wide, False))
        for s in spans
    ]


def candidates(
    docs: DataFrame, text: str = "text", out: str = "candidates", beside: list[str] | None = None
) -> DataFrame:
    """``docs`` (of its columns only ``beside``, if given) with an array of candidates, the labelers'
    votes on each, and its shape."""
    return add_columns(docs, [F.col(text)], lambda: lambda t: (_scan(t),), f"`{out}` array<{CANDIDATE}>", beside)


def learn(found: DataFrame, column: str = "candidates") -> SpanClassifier:
    """The classifier for all candidates of all rows, through their pattern counts."""
    one = found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    return fit([tuple(r) for r in one.collect()])


SPAN = "struct<kind: string, start: bigint, `end`: bigint, base: boolean, probability: double>"


def _judged(found: list[dict] | None, model: SpanClassifier, threshold: float) -> list[dict]:
    out = []
    for c in found or []:
        p = model.probability(c["kind"], c["votes"], c["shape"])
        if c["base"] or p >= threshold:
            out.append({"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"], "probability": p})
    return sorted(out, key=lambda c: _order((c["kind"], c["start"], c["end"])))


def judge(
    found: DataFrame,
    model: SpanClassifier,
    column: str = "candidates",
    out: str = "pii",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``found`` with the array of spans that stay, by kind, then start."""
    start = lambda: lambda c: (_judged(c, model, threshold),)
    return add_columns(found, [F.col(column)], start, f"`{out}` array<{SPAN}>")


def mask(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced by its kind, as in <EMAIL>."""
    column, new = free_name(docs, "candidates"), free_name(docs, "masked")
    # Counted where they are found: what a scan finds is read once, so nothing is written.
    model = learn(candidates(docs.select(F.col(f"`{text}`")), text, column, []), column)

    def start() -> Callable[[str | None], tuple]:
        def work(t: str | None) -> tuple:
            spans = _judged(_scan(t), model, threshold)
            return (replaced(t, [(s["kind"], s["start"], s["end"]) for s in spans]) if spans else t,)

        return work

    beside = [c for c in docs.columns if c != text]
    at = add_columns(docs, [F.col(f"`{text}`")], start, f"`{new}` string", beside)
    return at.select(*[F.col(new).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns])


def as_digest(found: str = "pii") -> dict[str, Column]:
    """Digest columns: counts by base kind, hash of the base spans, all spans."""
    spans = F.col(found)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans, lambda s: s["base"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return {f"n_{kind}": of(kind) for kind in KINDS} | {
        "base_sha256": F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256),
        "spans": F.concat_ws(",", F.transform(spans, text)),
    }
