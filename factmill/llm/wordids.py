"""Ids of a lower-casing word tokenizer for whole columns of texts.

Texts are cut where no token of this tokenizer crosses: at ASCII white space and between
plain letters, digits and marks. Each distinct chunk is tokenized once per process; the
others of its kind are looked up by hash. New words of plain letters are merged together,
all words of a length at a time, by the ranks in the tokenizer's file; any other chunk goes
through the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa

from factmill.llm.words import LOWER, blocks, hashed_words, ragged

PATH = public_tokenizers.path("word_bpe_49k.json")
BLOCK = 1 << 20
"""Bytes of text tokenized at once; some 40 bytes each while they are."""
KEEP = 1_000_000
"""Chunks kept in a process before the table is begun anew."""
LONGEST = 40
"""Bytes of the longest word that is merged here rather than by the tokenizer."""
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(f"[!-@\\[-`{{-~{_LETTERS}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^0-9{_LETTERS}]+")
_NONE = np.iinfo(np.int32).max
_open: dict[tuple[str, bool], WordIds] = {}


_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[ord("'")] = 0
_KIND[0x30:0x3A] = 2
_KIND[0x61:0x7B] = 1


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and each byte's kind: 1 of a letter up to U+00FF, 2 digit, 3 mark, 0 other.

    Between two kinds other than 0, and beside a digit, every text is cut by the pattern.
    """
    data = LOWER[data]
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    trail = data[lead + 1]
    letter = (trail >= 0x80) & (trail <= 0xBF) & (trail != 0x97) & (trail != 0xB7)
    lead, trail = lead[letter], trail[letter]
    data[lead + 1] = np.where(trail < 0x9F, trail + 0x20, trail)
    kind[lead] = kind[lead + 1] = 1
    return data, kind


def _byte_characters() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class WordIds:
    """The tokenizer in ``path`` with a table of the chunks seen so far.

    With ``plain`` its added tokens (``<|endoftext|>``) are encoded like any other
    characters of a text; without it they are one id each, as the library has it.
    """

    def __init__(self, path: str = PATH, plain: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        added = [] if plain else whole["added_tokens"]
        self.added = {t["content"].encode(): t["id"] for t in added}
        self.added_at = re.compile(b"|".join(map(re.escape, self.added)))
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        self.size = self.tokenizer.get_vocab_size()
        self.type = np.uint16 if self.size <= 1 << 16 else np.uint32
        characters = _byte_characters()
        self.inner = np.array([vocabulary[c] for c in characters], np.int64)
        self.last = np.array([vocabulary[c + suffix] for c in characters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.type)
        self.parts: dict[str, np.ndarray] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def _merge(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for words of one length in bytes, one a row.

        In each round every word makes its best merge, the first of equal ones.
        """
        n, width = words.shape
        symbols = self.inner[words]
        symbols[:, -1] = self.last[words[:, -1]]
        out, length = symbols.copy(), np.full(n, width)
        live = np.arange(n)
        ranks = self._rank(symbols[:, :-1], symbols[:, 1:])[0]
        while len(live) and symbols.shape[1] > 1:
            best = ranks.argmin(1)
            going = ranks[np.arange(len(live)), best] < _NONE
            done = live[~going]
            out[done, : symbols.shape[1]] = symbols[~going]
            live, symbols, ranks, best = live[going], symbols[going], ranks[going], best[going]
            length[live] -= 1
            row, left = np.arange(len(live)), length[live]
            new = self._rank(symbols[row, best], symbols[row, best + 1])[1]
            place = np.arange(symbols.shape[1] - 1)
            shift = place[None, :] + (place[None, :] > best[:, None])
            symbols = np.take_along_axis(symbols, shift, 1)
            symbols[row, best] = new
            ranks = np.take_along_axis(ranks, shift[:, :-1], 1)
            for at in (best - 1, best):
                fits = (at >= 0) & (at + 1 < left)
                r, c = row[fits], at[fits]
                ranks[r, c] = self._rank(symbols[r, c], symbols[r, c + 1])[0]
            ranks[place[None, :-1] + 1 >= left[:, None]] = _NONE
        out[live, : symbols.shape[1]] = symbols
        return out, length

    def _by_tokenizer(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)

    def _chunk(self, text: str) -> np.ndarray:
        """Ids of a chunk that is not one plain word."""
        low = text.lower()
        if not _PLAIN.fullmatch(low):
            return self._by_tokenizer(text)
        parts = _PARTS.findall(low)
        for part in parts:
            if part not in self.parts:
                self.parts[part] = self._by_tokenizer(part)
        return np.concatenate([self.parts[part] for part in parts])

    def _learn(self, data: np.ndarray, odd: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Tokenize chunks that are new and put them into the table; ``odd``: places of no letter."""
        width = ends - starts
        plain = (np.searchsorted(odd, ends) == np.searchsorted(odd, starts)) & (width <= LONGEST)
        count = np.zeros(len(starts), np.int64)
        groups = []
        for size in np.unique(width[plain]):
            which = np.flatnonzero(plain & (width == size))
            ids, n = self._merge(data[starts[which, None] + np.arange(size)])
            count[which] = n
            groups.append((which, ids, np.arange(size) < n[:, None]))
        if len(self.parts) > KEEP:
            self.parts = {}
        others = []
        for which in np.flatnonzero(~plain):
            text = data[starts[which] : ends[which]].tobytes().decode("utf-8", "replace")
            others.append((which, self._chunk(text)))
            count[which] = len(others[-1][1])
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), self.type)
        for which, ids, mask in groups:
            flat[(first[which, None] + np.arange(ids.shape[1]))[mask]] = ids[mask]
        for which, ids in others:
            flat[first[which] : first[which] + len(ids)] = ids
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known = np.insert(self.known, at, hashes[order])
        self.first = np.insert(self.first, at, first[order] + len(self.flat))
        self.count = np.insert(self.count, at, count[order])
        self.flat = np.concatenate([self.flat, flat])

    def column(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of rows: first, behind the last, their ids, and where each row's ids begin."""
        for i, j, raw, bounds in blocks(texts, BLOCK):
            yield i, j, *self._with_added(raw, bounds)

    def _with_added(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a run and where each row's begin; added tokens are one id each."""
        found = list(self.added_at.finditer(raw)) if self.added else []
        if not found:
            return self._run(raw, bounds)
        at, to = (np.array([f(m) for m in found]) for f in (re.Match.start, re.Match.end))
        # what begins in one row and ends in another is no token
        inside = to <= bounds[np.searchsorted(bounds, at, "right")]
        own = np.array([self.added[m[0]] for m in found], self.type)[inside]
        at, to = at[inside], to[inside]
        edges = np.unique(np.concatenate([bounds, at, to]))
        ids, begin = self._run(raw, edges)
        first, count = begin[:-1].copy(), np.diff(begin)
        parts = np.searchsorted(edges, at)
        first[parts], count[parts] = len(ids) + np.arange(len(at)), 1
        total = np.concatenate([[0], np.cumsum(count)])
        ids = ragged(np.concatenate([ids, own]), first, count)
        return ids, total[np.searchsorted(edges, bounds)]

    def _run(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a run, added tokens as other characters, and where each row's begin."""
        data, kind = _lowered(raw)
        before, after = kind[:-1], kind[1:]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (before > 0) & (after > 0) & ((before != after) | (after == 2))
        cut[bounds] = True
        starts, ends, hashes = hashed_words(data, np.flatnonzero(cut))
        # numbered by a table of hashes, without sorting all chunks
        coded = pa.array(np.ascontiguousarray(hashes[:, 0])).dictionary_encode()
        kinds, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        if len(self.known) > KEEP:
            self.clear()
        at = np.searchsorted(self.known, kinds)
        new = np.ones(len(kinds), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != kinds[inside]
        if new.any():
            odd = np.flatnonzero(kind != 1)
            where = np.zeros(len(kinds), np.int64)
            where[code] = np.arange(len(code))
            at = where[new]
            self._learn(data, odd, starts[at], ends[at], kinds[new])
        at = np.searchsorted(self.known, kinds)[code]
        count = self.count[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = ragged(self.flat, self.first[at], count)
        return ids, total[np.searchsorted(starts, bounds)]


def word_ids(path: str = PATH, plain: bool = True) -> WordIds:
    """The tokenizer of this process, read once."""
    if (path, plain) not in _open:
        _open[path, plain] = WordIds(path, plain)
    return _open[path, plain]
