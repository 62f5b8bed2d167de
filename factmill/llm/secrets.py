"""Secrets in texts: keyword search first, anchored patterns near its hits, then checksums.

One Aho-Corasick pass over a text finds the keywords that a secret begins with. Only there
is the secret's pattern tried, anchored at the hit. Hexadecimal runs have no keyword:
every run of n digits covers a multiple of n, so that only these places are looked at. A
token of a kind that carries a checksum counts only if it is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in the order that breaks ties, and their keywords and patterns.
KINDS = ("assign", "access", "hex", "checked", "private_key")
BASE = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_WORD = "akia"
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
KEY_WORD = "-----begin "
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
KEY_END = re.compile(r"-----END (?:[A-Z]+ )*PRIVATE KEY-----")
KEY_NEXT = "-----BEGIN "
# between lines of a key: white space, escaped line ends, quotes and marks of quoted lines
_GAP = r"""(?:[\s"'>#|,*]|\\+[rnt])*+"""
_RUN = r"(?:[A-Za-z0-9+/]{16,}+={0,2}|[A-Za-z0-9+/]++={0,2}(?=[ \t\"']*(?:[\r\n]|\\+[rn]|\Z)))"
KEY_BODY = re.compile(rf"(?:(?:{_GAP}[A-Z][A-Za-z0-9-]*:[^\r\n\\]*+)*+{_GAP}{_RUN})(?:{_GAP}{_RUN})*+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
        ]
    )
)
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_machine: list = []


def _automaton():
    if not _machine:
        import ahocorasick

        made = ahocorasick.Automaton()
        for kind, words in (
            ("assign", ASSIGN_WORDS),
            ("access", (ACCESS_WORD,)),
            ("checked", CHECKED_WORDS),
            ("private_key", (KEY_WORD,)),
        ):
            for word in words:
                made.add_word(word, (kind, len(word)))
        made.make_automaton()
        _machine.append(made)
    return _machine[0]


def _lowered(text: str) -> str:
    """Lower case of the same length, so that places in it are places in the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if c.isascii() else c for c in text)
    return low


def checksum_holds(payload: str, check: str) -> bool:
    """Whether ``check`` is the CRC-32 of the payload in base 62, six digits."""
    rest, digits = zlib.crc32(payload.encode("ascii")), ""
    for _ in range(len(check)):
        rest, digit = divmod(rest, 62)
        digits = BASE62[digit] + digits
    return digits == check


def hex_runs(data: np.ndarray, least: int = HEX_LEAST) -> Iterator[tuple[int, int]]:
    """All runs of at least ``least`` lower-case hexadecimal bytes, by place."""
    at = np.arange(least - 1, len(data), least)
    at = at[_HEX[data[at]]]
    # a run of that length through ``at`` also covers one of these two neighbours' places
    half = least // 2
    at = at[
        _HEX[data[at - half]] | _HEX[data[np.minimum(at + half, len(data) - 1)]]
    ]
    end = 0
    for place in at.tolist():
        if place < end:
            continue
        start = place
        while start > 0 and _HEX[data[start - 1]]:
            start -= 1
        end = place + 1
        while end < len(data):
            step = data[end : end + 4096]
            stop = np.flatnonzero(~_HEX[step])
            end += int(stop[0]) if len(stop) else len(step)
            if len(stop):
                break
        if end - start >= least:
            yield start, end


def key_end(text: str, body: int) -> int:
    """Where a private key ends whose BEGIN line ends at ``body``.

    That is behind its END line, which stands before any other BEGIN line; without one,
    behind its lines of base64.
    """
    following = text.find(KEY_NEXT, body)
    stop = len(text) if following < 0 else following
    match = KEY_END.search(text, body, stop) or KEY_BODY.match(text, body, stop)
    return match.end() if match else body


def scan(text: str) -> list[tuple[str, int, int]]:
    """All secrets of a text: kind, start and end in code points, by start and kind."""
    found = []
    behind = dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in _automaton().iter(_lowered(text)))
    for start, kind in hits:
        if start < behind[kind]:
            continue
        if kind == "assign":
            match = ASSIGN.match(text, start)
            good = match and len(match[2]) >= ASSIGN_LEAST
        elif kind == "access":
            match = ACCESS.match(text, start)
            good = match and match.end() - start >= ACCESS_LEAST
        elif kind == "checked":
            match = CHECKED.match(text, start)
            good = match and checksum_holds(match[1], match[2])
        else:
            match = good = PRIVATE_KEY.match(text, start)
        if match:
            end = key_end(text, match.end()) if kind == "private_key" else match.end()
            behind[kind] = end
            if good:
                found.append((kind, start, end))
    raw = text.encode("utf-8", "surrogatepass")
    data, seen, chars = np.frombuffer(raw, np.uint8), 0, 0
    for start, end in hex_runs(data):
        chars += len(raw[seen:start].decode("utf-8", "surrogatepass")) if len(raw) != len(text) else start - seen
        seen = start
        found.append(("hex", chars, chars + end - start))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _values(texts: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The texts as strings, of some rows at a time."""
    for at in range(0, len(texts), rows):
        yield from texts.slice(at, rows).to_pylist()


def find_secrets(text: Column | str) -> Column:
    """The secrets of a text, an array of (kind, start, end).

    Places are code points, the end exclusive, sorted by start and then in the order of
    ``KINDS``. Matches of one kind do not overlap, those of different kinds may. A null
    or empty text has none (an empty array).
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf(SPAN)
    def run(texts: pa.Array) -> pa.Array:
        spans = [
            [{"kind": k, "start": s, "end": e} for k, s, e in scan(value or "")]
            for value in _values(texts)
        ]
        return pa.array(spans, kind)

    return run(text)


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined in their order."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redacted(text: str) -> str | None:
    """The text with ``<kind>`` for each secret, None if there is none.

    Of overlapping secrets the first gives its kind.
    """
    out, at = [], 0
    for kind, start, end in scan(text):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]]) if out else None


def redact(text: Column | str) -> Column:
    """A text without its secrets; only changed texts come back from Python. Null stays null."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([redacted(value) if value else None for value in _values(texts)], pa.string())

    return F.coalesce(run(text), text if isinstance(text, Column) else F.col(text))
