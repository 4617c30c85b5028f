"""Secret scans with structural confirmation.

Three base kinds are plain patterns: assignments to secret-like names, access key ids and long
hex runs. The method adds encoded credentials that no pattern can tell from noise: runs of
base64 or hex are decoded, and reported only if the bytes have the structure of a key:

- ``jwt``: three base64url parts of which the first is a JSON object with an ``alg`` text and
  the second a JSON object; the third, a signature, may be empty;
- ``der``: a DER sequence whose nested lengths fill it exactly and that starts like a private
  key (version, then integers or an algorithm with its key), in base64, hex or a PEM block;
- ``ssh``: an OpenSSH private key, or length-prefixed fields starting with a key type that fill
  the bytes exactly.

Base64 may go over several lines, and line breaks may be escaped, inside a PEM block or without
one. A candidate that does not parse is not reported, nor is DER that nests deeper than the
``DEEPEST`` levels that key formats stay below. Reported spans may lie inside base spans;
those stay as they are. Null and empty texts have no spans; repeated rows are scanned each;
long texts are scanned whole, in time linear in their length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitlog.llm.common import add_columns
from pitlog.llm.spans import Span

# The base kinds in the order in which they are listed.
KINDS = ("assign", "access", "hex")
CONFIRMED = ("jwt", "der", "ssh")

LEAST_VALUE = 6
LEAST_ACCESS = 20
LEAST_HEX = 24
LEAST_ENCODED = 32
DEEPEST = 8
LONGEST_DIGEST = 64

_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")  # what the pattern starts with
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A run of the class that a plain + would find is whole, so short ones can be left out here.
_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST_HEX},}}")
# Line breaks may be escaped, as in JSON and .env files, once or several times. What follows one
# starts a run although its last character is a letter.
_ESCAPED = r"\\++(?:[nrt]|u000[9aAdD])"
_BREAK = rf"[ \t]*+(?:[\r\n]|{_ESCAPED})(?:\s|{_ESCAPED})*+"
# The parts of a token are JSON in base64url; the shortest header is {"alg":""}.
_JWT = re.compile(
    r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt])|(?<=\\u000[9aAdD]))"
    r"(?=([A-Za-z0-9_-]{14,}+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]*+))"
)
_PEM = re.compile(
    rf"-----BEGIN ([A-Z ]{{0,40}}PRIVATE KEY)-----((?:[A-Za-z0-9+/=\s]|{_ESCAPED})++)-----END \1-----"
)
# Encoded runs start with what the structures start with: 0x30 and any length byte (DER), a
# four-byte length under 256 (SSH fields) or the OpenSSH name, in base64 or hex.
# The first character stands in front of the look behind it, as that is faster.
_START64 = (
    r"[MAb](?:(?<![A-Za-z0-9+/_-].)|(?<=\\[nrt].)|(?<=\\u000[9aAdD].))"
    r"(?:(?<=M)[A-P]|(?<=A)AAA|(?<=b)3BlbnNzaC1r)"
)
_BASE64 = re.compile(rf"{_START64}[A-Za-z0-9+/_-]{{{LEAST_ENCODED},}}={{0,2}}")
# The first of several lines, how the next ones go on, and padding.
_FIRST = re.compile(rf"{_START64}[A-Za-z0-9+/_-]*+(?={_BREAK}[A-Za-z0-9+/_-])")
_NEXT = re.compile(rf"{_BREAK}([A-Za-z0-9+/_-]++)")
_PADDING = re.compile(rf"(?:(?:{_BREAK})?=){{0,2}}")
_BROKEN = re.compile(rf"\s|{_ESCAPED}")
_HEXED = re.compile(
    r"[306](?:(?<![0-9A-Fa-f].)|(?<=\\u000[9aAdD].))"
    r"(?:(?<=3)0[0-9A-Fa-f]|(?<=0)00000|(?<=6)[Ff]70656[Ee]7373682[Dd]6[Bb])"
    rf"[0-9A-Fa-f]{{{2 * LEAST_ENCODED},}}"
)

_OPENSSH = b"openssh-key-v1\0"
_SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-")


def _bytes(run: str) -> bytes | None:
    """Decoded base64 of either alphabet; padding may be missing."""
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _json(run: str) -> dict | None:
    try:
        found = json.loads(_bytes(run) or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_token(header: str, claims: str) -> bool:
    top = _json(header)
    return top is not None and isinstance(top.get("alg"), str) and _json(claims) is not None


def elements(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER elements that fill ``data`` exactly, nested ones checked too."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            width = length & 0x7F
            if not 1 <= width <= 4 or at + width > len(data) or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + width]), at + width
            if length < 0x80:
                return None
        if at + length > len(data):
            return None
        content, at = data[at : at + length], at + length
        if tag & 0x20 and (depth >= DEEPEST or elements(content, depth + 1) is None):
            return None
        out.append((tag, content))
    return out


def is_private_der(data: bytes) -> bool:
    """Whether ``data`` is one sequence laid out like an RSA, EC or PKCS #8 private key."""
    if data[:1] != b"\x30":
        return False
    top = elements(data)
    if top is None or len(top) != 1:
        return False
    fields = elements(top[0][1]) or []
    tags = [tag for tag, _ in fields]
    if tags[:1] != [0x02] or len(fields[0][1]) != 1:
        # An encrypted PKCS #8 key is an algorithm and its bytes; so is the digest inside a
        # signature, but that algorithm has no parameters and the bytes are few.
        if tags != [0x30, 0x04]:
            return False
        method = [tag for tag, _ in elements(fields[0][1]) or []]
        return method[:1] == [0x06] and (method[1:2] == [0x30] or len(fields[1][1]) > LONGEST_DIGEST)
    numbers = len(tags) >= 9 and set(tags[:9]) == {0x02}
    pkcs8 = tags[1:3] == [0x30, 0x04] and (elements(fields[1][1]) or [(0, b"")])[0][0] == 0x06
    curve = tags[1:2] == [0x04] and fields[0][1] == b"\x01"
    return numbers or pkcs8 or curve


def is_ssh(data: bytes) -> bool:
    if data.startswith(_OPENSSH):
        return len(data) > 4 * len(_OPENSSH)
    at, fields = 0, []
    while at + 4 <= len(data):
        length = int.from_bytes(data[at : at + 4])
        at += 4
        if length > len(data) - at:
            return False
        fields.append(data[at : at + length])
        at += length
    return at == len(data) and len(fields) >= 2 and fields[0].startswith(_SSH_TYPES)


def _der_end(data: bytes) -> int:
    """Where the sequence that ``data`` begins with ends by its length; 0 if it cannot be a key."""
    width = data[1] & 0x7F if len(data) > 1 and data[1] & 0x80 else 0
    # What follows is a version or an algorithm.
    if data[:1] != b"\x30" or width > 4 or data[2 + width : 3 + width] not in (b"\x02", b"\x30"):
        return 0
    return 2 + width + (int.from_bytes(data[2 : 2 + width]) if width else data[1])


def _openssh_end(data: memoryview) -> int:
    """Where the OpenSSH key that ``data`` begins with ends by its lengths; 0 if it is none.

    The format has a count of keys, which is always one.
    """
    after = lambda at: at + 4 + int.from_bytes(data[at : at + 4])
    # A cipher, a derivation with options, the count of public keys, one of them, the private ones.
    at = after(after(after(len(_OPENSSH))))
    return after(after(at + 4)) if int.from_bytes(data[at : at + 4]) == 1 else 0


def _structure(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "der" if is_private_der(data) else "ssh" if is_ssh(data) else None


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then kind as listed."""
    out: list[Span] = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= LEAST_VALUE]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=_order)


def confirmed_spans(text: str) -> list[Span]:
    """Spans whose decoded bytes have the structure of a credential."""
    out: list[Span] = []
    done = 0
    for m in _JWT.finditer(text):
        if m.start() >= done and is_token(m[1], m[2]):
            done = m.end(3)
            out.append(("jwt", m.start(), done))
    pem: list[Span] = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            kind = _structure(_bytes(_BROKEN.sub("", m[2])))
            if kind:
                pem.append((kind, *m.span()))
    inside = [(start, end) for _, start, end in pem]
    pem += [s for s in wrapped_spans(text) if not any(a <= s[1] and s[2] <= b for a, b in inside)]
    out += pem
    inside = [(start, end) for _, start, end in pem]
    for pattern, decode in ((_BASE64, _bytes), (_HEXED, _unhex)):
        for m in pattern.finditer(text):
            kind = _structure(decode(m[0]))
            if kind and not any(a <= m.start() and m.end() <= b for a, b in inside):
                out.append((kind, *m.span()))
    return out


class _Run:
    """Lines of base64 that belong together, decoded once for each alignment that a line has."""

    def __init__(self, joined: str, stops: dict[int, int]):
        self.joined, self.stops = joined, stops
        self.decoded: dict[int, bytes] = {}
        self.known: dict[int, dict[int, int]] = {}

    def data(self, first: int) -> tuple[bytes, int]:
        """The decoded bytes of the alignment of place ``first``, and where that is in them."""
        r = first % 4
        if r not in self.decoded:
            length = len(self.joined) - r
            self.decoded[r] = _bytes(self.joined[r : r + length - (length % 4 == 1)]) or b""
        return self.decoded[r], (first - r) // 4 * 3

    @staticmethod
    def place(r: int, at: int) -> int:
        """The place in the joined lines that follows so many bytes of an alignment."""
        return r + at // 3 * 4 + (0, 2, 3)[at % 3]

    def fields_end(self, first: int) -> int:
        """The farthest line end that two or more length-prefixed fields from ``first`` reach; -1 if none.

        Fields after a byte are the same from wherever they are reached, so each is walked once.
        """
        data, at = self.data(first)
        r, known = first % 4, self.known.setdefault(first % 4, {})
        after = lambda p: p + 4 + int.from_bytes(data[p : p + 4])
        size = len(data)
        for _ in range(2):
            if at + 4 > size or after(at) > size:
                return -1
            at = after(at)
        path = []
        while at not in known:
            path.append(at)
            if at + 4 > size or after(at) > size:
                known[at] = at if self.place(r, at) in self.stops else -1
                break
            at = after(at)
        far = known[at]
        for p in reversed(path):
            far = known[p] = far if far >= 0 else p if self.place(r, p) in self.stops else -1
        return -1 if far < 0 else self.place(r, far)


def wrapped_spans(text: str) -> list[Span]:
    """Spans of structures in base64 over several lines without a header.

    What follows the last line may look like one more, so the structure's own lengths say where
    it ends, which must be the end of a line. Lines that belong together are decoded once.
    """
    out: list[Span] = []
    done, begins = 0, {}
    for m in _FIRST.finditer(text):
        if m.start() < done:
            continue
        if m.start() not in begins:
            # The lines that belong together, where each begins in them joined, and where each ends.
            at, begins, stops, parts = m.end(), {m.start(): 0}, {len(m[0]): m.end()}, [m[0]]
            size = len(m[0])
            while following := _NEXT.match(text, at):
                at = following.end()
                begins[following.start(1)] = size
                size += len(following[1])
                stops[size] = at
                parts.append(following[1])
            run = _Run("".join(parts), stops)
        first = begins[m.start()]
        data, start = run.data(first)
        head = data[start : start + 30]
        if head[4:].startswith(_SSH_TYPES):
            last = run.fields_end(first)
        else:
            if head.startswith(_OPENSSH):
                end = _openssh_end(memoryview(data)[start:])
            else:
                end = _der_end(head)
            last = run.place(first % 4, start + end) if end else -1
        if run.stops.get(last, 0) > m.end():
            kind = _structure(_bytes(run.joined[first:last]))
            if kind:
                done = _PADDING.match(text, run.stops[last]).end()
                out.append((kind, m.start(), done))
    return out


def _unhex(run: str) -> bytes | None:
    return bytes.fromhex(run) if len(run) % 2 == 0 else None


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], (*KINDS, *CONFIRMED).index(span[0]), span[2]


def scan(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` with an array ``out`` of (kind, start, end, confirmed), by start, then kind.

    ``confirmed`` marks the spans that the decoded structure has added.
    """

    def start() -> Callable[[str | None], tuple]:
        def work(value: str | None) -> tuple:
            if not value:
                return ([],)
            found = [(s, False) for s in base_spans(value)] + [(s, True) for s in confirmed_spans(value)]
            found.sort(key=lambda f: _order(f[0]))
            return ([{"kind": k, "start": a, "end": b, "confirmed": c} for (k, a, b), c in found],)

        return work

    kind = "array<struct<kind: string, start: bigint, `end`: bigint, confirmed: boolean>>"
    return add_columns(docs, [F.col(text)], start, f"`{out}` {kind}")


def as_digest(found: str = "secrets") -> dict:
    """Digest columns of a scan: counts by base kind, hash of the base spans, all spans."""
    spans = F.col(found)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter(spans, lambda s: ~s["confirmed"])
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint")
    return {f"n_{kind}": of(kind) for kind in KINDS} | {
        "base_sha256": F.sha2(F.concat_ws(",", F.transform(base, text)).cast("binary"), 256),
        "spans": F.concat_ws(",", F.transform(spans, text)),
    }
