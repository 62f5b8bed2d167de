"""Byte-level BPE by tree reduction: halves are encoded apart and joined at their seam.

The encoding of a text is a monoid: ``join(encode(a), encode(b)) = encode(a + b)``. A
join re-encodes a window around the seam. The window grows on either side until it ends
where *every* text has a cut: a match of the pattern that holds a letter, digit or mark
ends before a character of another class (only an apostrophe may take letters along, and
only white space may begin a match of another class). The matches outside the window are
therefore those of the halves, and so are their ids. Decoding concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LEAF = 1024
"""Characters, or ids, that are encoded or decoded in one go."""
# The code points that Unicode calls white space.
_SPACE = {
    chr(c)
    for c in [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
}
_open: dict[tuple[str, str], ByteBpe] = {}


def _kind(char: str) -> str:
    """S white space, L letter, N digit, P any other, "" unknown to this Unicode table."""
    if char in _SPACE:
        return "S"
    category = unicodedata.category(char)
    return "" if category == "Cn" else category[0] if category[0] in "LN" else "P"


def is_cut(before: str, after: str) -> bool:
    """Whether every text is cut between these two characters, whatever surrounds them."""
    a, b = _kind(before), _kind(after)
    return bool(a and b and a != "S" and a != b and not (before == "'" and b == "L"))


class ByteBpe:
    """An encoder for a file of ranks and a splitting pattern."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.coder = tiktoken.Encoding(
            path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )

    def leaf(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode_ordinary(text), np.uint32)

    def encode(self, text: str, leaf: int = LEAF) -> np.ndarray:
        if len(text) <= leaf:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left, leaf), right, self.encode(right, leaf))

    def join(self, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
        """The ids of ``left + right`` from those of both."""
        i = len(left) - 1
        while i > 0 and not is_cut(left[i - 1], left[i]):
            i -= 1
        j = 1
        while j < len(right) and not is_cut(right[j - 1], right[j]):
            j += 1
        i = max(i, 0)
        gone, taken = len(self.leaf(left[i:])), len(self.leaf(right[:j]))
        middle = self.leaf(left[i:] + right[:j])
        return np.concatenate([left_ids[: len(left_ids) - gone], middle, right_ids[taken:]])

    def decode(self, ids: np.ndarray, leaf: int = LEAF) -> bytes:
        if len(ids) <= leaf:
            return self.coder.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def coder(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """The encoder of this process, read once."""
    if (path, pattern) not in _open:
        _open[path, pattern] = ByteBpe(path, pattern)
    return _open[path, pattern]


def _coded(values: list, function: Callable, kind: pa.DataType) -> pa.Array:
    return pa.array([function(value) for value in values], kind)


def encode(text: Column | str, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers, a binary value.

    A null or empty text has no ids (an empty value).
    """

    @F.arrow_udf("binary")
    def run(texts: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        return _coded(texts.to_pylist(), lambda t: own.encode(t or "").astype("<u4").tobytes(), pa.binary())

    return run(text)


def decode(ids: Column | str, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """The bytes that a binary value of ids stands for; null ids decode to none."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        return _coded(values.to_pylist(), lambda v: own.decode(np.frombuffer(v or b"", "<u4")), pa.binary())

    return run(ids)


def digests(text: Column | str, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Column:
    """``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of a text's ids and their bytes.

    The same as the digests of ``encode`` and of ``decode`` of that, without sending ids
    back and forth between Spark and Python.
    """

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        counts, first, second = [], [], []
        for value in texts.to_pylist():
            ids = own.encode(value or "")
            counts.append(len(ids))
            first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            second.append(hashlib.sha256(own.decode(ids)).hexdigest())
        columns = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
        return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256"])

    return run(text)


def n_ids(ids: Column | str) -> Column:
    """The number of ids in a binary value of them."""
    return (F.octet_length(ids) / 4).cast("long")
