"""Tokens of two tokenizers over the same bytes, aligned with Arrow's own operations.

Tokenizer A encodes a space and the text, tokenizer B the text, before which it puts a space
itself; both split the same bytes. Tokens of A and B are linked where their byte ranges
overlap. Where a token of A and one of B both end, the text is cut into groups.

1. Texts are cut into units where both tokenizers must cut: before a single space between two
   characters that are surely not white space (A's pattern begins a match there, and no piece
   of B has a space behind another character). The tokens of a unit do not depend on its
   neighbours, so each distinct unit of a block of texts is encoded once.
2. The ids lie in list arrays, a list a unit. ``list_flatten`` and ``list_parent_indices``
   give tokens and their units, the running sum of their byte lengths less that of the units
   before gives their ends.
3. A full outer hash join on (unit, end) lines them up. In order of the ends, filling nulls
   backwards, each row is one link: the token of A and the token of B that reach to or over
   that end. Rows with both sides are the ends of groups.
4. Texts are lists of units; counts and groups are gathered by flattening these lists, and
   ``Table.group_by`` counts the links of each text, and of many texts, by pair of ids.
   Spark adds these partial counts up.

Pairs so frequent that at most ``HEAD`` reach their count are sent to every task, the others
are joined with the texts that have them.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.distinct import HEAD, exact_ids, gathered, head_bound, with_tail
from factmill.llm.rows import numbered
from factmill.llm.words import blocks, ragged
from factmill.session import settle

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
A_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
BLOCK = 4 << 20
"""Bytes of text whose distinct units are encoded together."""
CHUNK = 4096
"""Bytes of units that are encoded as one text."""
# ASCII and letters of two bytes up to U+024F, whose kind no version of Unicode disputes
_PLAIN = re.compile(rb"(?:[\x00-\x7f]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])*")
_GRAPHIC = np.zeros(256, bool)
_GRAPHIC[0x21:0x7F] = True
_LETTER = np.zeros(256, bool)
_LETTER[0xC3:0xE0] = True
_open: dict[tuple[str, str, str], Tokenizers] = {}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a: str = A_PATH, ranks: str = A_RANKS, b: str = B_PATH) -> None:
        import sentencepiece
        import tiktoken
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            own = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
        # the same vocabulary, several times as fast, for texts on whose pattern all agree
        self.quick = tiktoken.Encoding(
            ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}
        )
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in own.items():
            self.a_bytes[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        ]

    def encode_a(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that begin with their space."""
        out: list[np.ndarray | None] = [None] * len(texts)
        slow = []
        for k, text in enumerate(texts):
            if _PLAIN.fullmatch(text):
                out[k] = np.array(self.quick.encode_ordinary(text.decode()), np.int64)
            else:
                slow.append(k)
        coded = self.a.encode_batch([texts[k].decode("utf-8", "replace") for k in slow], add_special_tokens=False)
        for k, code in zip(slow, coded):
            out[k] = np.array(code.ids, np.int64)
        return out

    def encode_b(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts that begin with the space that this tokenizer puts there itself."""
        coded = self.b.encode([t[1:].decode("utf-8", "replace") for t in texts], num_threads=1)
        return [np.array(ids, np.int64) for ids in coded]


def tokenizers(a: str = A_PATH, ranks: str = A_RANKS, b: str = B_PATH) -> Tokenizers:
    """The tokenizers of this process, read once."""
    if (a, ranks, b) not in _open:
        _open[a, ranks, b] = Tokenizers(a, ranks, b)
    return _open[a, ranks, b]


def units(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, each behind a space, cut into units: bytes, bounds of units, first unit of each
    text, and whether a unit's tokens are the same behind and before any other such unit.

    Empty texts have no units.
    """
    size = np.diff(bounds)
    some = size > 0
    begin = (bounds[:-1] + np.arange(len(size)))[some] if some.all() else None
    if begin is None:
        shift = np.cumsum(some) - some
        begin = (bounds[:-1] + shift)[some]
    n = len(data) + len(begin)
    flat = np.full(n, 0x20, np.uint8)
    inside = np.ones(n, bool)
    inside[begin] = False
    flat[inside] = data
    firm = _GRAPHIC[flat]
    # the first byte of a letter, and the last
    lead = _LETTER[flat]
    trail = np.zeros(n, bool)
    trail[1:] = lead[:-1]
    cut = np.zeros(n, bool)
    cut[1:-1] = (flat[1:-1] == 0x20) & (firm | trail)[:-2] & (firm | lead)[2:]
    cut[begin] = True
    starts = np.flatnonzero(cut)
    at = np.append(starts, n)
    first = np.zeros(len(size) + 1, np.int64)
    first[:-1][some] = np.searchsorted(starts, begin)
    first[-1] = len(starts)
    # an empty text begins where the next one does
    first[:-1][~some] = -1
    for_next = np.minimum.accumulate(np.where(first < 0, len(starts), first)[::-1])[::-1]
    plain = (firm | lead)[np.minimum(starts + 1, n - 1)] & (firm | trail)[at[1:] - 1]
    return flat, at, for_next, plain


class Aligned:
    """Distinct units, encoded by both tokenizers and aligned."""

    def __init__(self, values: pa.LargeBinaryArray, plain: np.ndarray, own: Tokenizers) -> None:
        texts = values.to_pylist()
        a, b = (
            _encoded(texts, plain, encode, names)
            for encode, names in ((own.encode_a, own.a_bytes), (own.encode_b, own.b_bytes))
        )
        n = len(texts)
        self.good = a[2] & b[2]
        self.width = len(own.b_bytes)
        sides = []
        for (flat, bounds, _), name, names in ((a, "a", own.a_bytes), (b, "b", own.b_bytes)):
            lists = pa.LargeListArray.from_arrays(bounds, pa.array(flat))
            token, unit = pc.list_flatten(lists), pc.list_parent_indices(lists)
            length = pa.array(np.array([len(t) for t in names])).take(token)
            total = pc.cumulative_sum(length)
            # a unit's running sum begins behind that of the units before it
            before = np.concatenate([[0], total.to_numpy()])[bounds[:-1]]
            end = pc.subtract(total, pa.array(before).take(unit))
            sides.append(pa.table({"unit": unit, "end": end, name: token}))
        left, right = (s.filter(pa.array(self.good).take(s.column("unit"))) for s in sides)
        joined = left.join(right, ["unit", "end"], join_type="full outer", use_threads=False)
        joined = joined.take(pc.sort_indices(joined, [("unit", "ascending"), ("end", "ascending")]))
        joined = joined.combine_chunks()
        unit = joined.column("unit").to_numpy()
        is_end = pc.and_(pc.is_valid(joined.column("a")), pc.is_valid(joined.column("b"))).to_numpy()
        ids = [pc.fill_null_backward(joined.column(c).combine_chunks()).to_numpy() for c in "ab"]
        self.pair = ids[0] * self.width + ids[1]
        self.link = np.searchsorted(unit, np.arange(n + 1))
        self.n_links = np.diff(self.link)
        self.n_groups = np.bincount(unit[is_end], minlength=n)
        self.n_a, self.n_b = (np.bincount(s.column("unit").to_numpy(), minlength=n) for s in (left, right))
        self.groups = self._groups(left, right, unit[is_end], joined.column("end").to_numpy()[is_end], texts)

    def _groups(
        self, left: pa.Table, right: pa.Table, unit: np.ndarray, end: np.ndarray, texts: list[bytes]
    ) -> pa.Array:
        """Each unit's groups as text."""
        longest = max(map(len, texts), default=0) + 1
        ends = unit * longest + end
        sides = []
        for side in (left, right):
            token = side.column(2).combine_chunks()
            at = side.column("unit").to_numpy() * longest + side.column("end").to_numpy()
            # the last token of each group ends with it
            bounds = np.concatenate([[0], np.searchsorted(at, ends, "right")])
            names, place = np.unique(token.to_numpy(), return_inverse=True)
            named = pa.array(names).cast(pa.string()).take(pa.array(place))
            sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), named), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        bounds = np.searchsorted(unit, np.arange(len(texts) + 1))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), groups), ";")


def _encoded(
    texts: list[bytes], plain: np.ndarray, encode, names: list[bytes]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all units, bounds of each unit's ids, and whether its tokens spell the unit.

    Plain units are encoded many at a time; the ids are dealt out by the bytes they stand for.
    """
    ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    good = np.zeros(len(texts), bool)
    length = np.array([len(t) for t in names])
    single = np.flatnonzero(~plain).tolist()
    many = np.flatnonzero(plain)
    sizes = np.array([len(texts[k]) for k in many], np.int64)
    group = np.cumsum(sizes) // CHUNK
    chunks = np.split(many, np.flatnonzero(np.diff(group)) + 1) if len(many) else []
    joined = [b"".join([texts[k] for k in chunk.tolist()]) for chunk in chunks]
    for chunk, text, code in zip(chunks, joined, encode(joined)):
        ends = np.cumsum(length[code])
        stop = np.cumsum([len(texts[k]) for k in chunk.tolist()])
        at = np.searchsorted(ends, stop)
        if b"".join([names[i] for i in code.tolist()]) != text or (ends[np.minimum(at, len(ends) - 1)] != stop).any():
            single += chunk.tolist()
            continue
        for k, own in zip(chunk.tolist(), np.split(code, at[:-1] + 1)):
            ids[k] = own
        good[chunk] = True
    for k, code in zip(single, encode([texts[k] for k in single])):
        ids[k] = code
        good[k] = b"".join([names[i] for i in code.tolist()]) == texts[k]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in ids], out=bounds[1:])
    return np.concatenate([np.zeros(0, np.int64), *ids]), bounds, good


def _aligned(column: pa.Array, own: Tokenizers, size: int = BLOCK):
    """For each block of texts: first row, row behind the last, aligned units, texts' units
    one behind the other and their bounds; a text that does not spell its bytes has none."""
    for i, j, data, bounds in blocks(column, size):
        flat, at, first, plain = units(data, bounds)
        ids, values = exact_ids(gathered(flat, at[:-1], at[1:]))
        every = np.zeros(len(values), bool)
        every[ids] = plain
        found = Aligned(values, every, own)
        text = np.repeat(np.arange(j - i), np.diff(first))
        wrong = np.zeros(j - i, bool)
        wrong[text[~found.good[ids]]] = True
        keep = ~wrong[text]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=j - i))])
        yield i, j, found, ids[keep], bounds


def token_groups(text: Column | str, a: str = A_PATH, ranks: str = A_RANKS, b: str = B_PATH) -> Column:
    """A text's groups: ``a1,a2|b1;a3|b2,b3``, the ids of A and B in order.

    Empty for null and empty texts, and where the tokens of A or B do not spell the text.
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([], pa.string())]
        for _, _, found, ids, bounds in _aligned(texts, tokenizers(a, ranks, b)):
            parts.append(_joined(found, ids, bounds).cast(pa.string()))
        return pa.concat_arrays(parts)

    return run(text)


def _joined(found: Aligned, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    own = found.groups.cast(pa.large_string()).take(pa.array(ids))
    return pc.binary_join(pa.LargeListArray.from_arrays(bounds, own), pa.scalar(";", pa.large_string()))


def links(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    a: str = A_PATH,
    ranks: str = A_RANKS,
    b: str = B_PATH,
) -> DataFrame:
    """One row per row: ``row``, ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``groups_sha256``, and its links by pair of ids: ``pairs`` and ``times``.

    A pair is one number, the id of A times the size of B's vocabulary plus the id of B.
    """
    rows = numbered(docs, F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(a, ranks, b)
        for batch in batches:
            for i, j, found, ids, bounds in _aligned(batch.column(2), own):
                n = j - i
                text = np.repeat(np.arange(n), np.diff(bounds))
                counts = [
                    pa.array(np.bincount(text, x[ids], n).astype(np.int64))
                    for x in (found.n_a, found.n_b, found.n_groups, found.n_links)
                ]
                digests = [
                    hashlib.sha256(t.as_buffer()).hexdigest() if len(t.as_buffer()) else ""
                    for t in _joined(found, ids, bounds)
                ]
                pairs = _pairs_of_texts(found, ids, text, n)
                columns = [batch.column(0).slice(i, n), batch.column(1).slice(i, n), *counts, pa.array(digests, pa.string()), *pairs]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.select("row", "id", "text").mapInArrow(
        run,
        f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "pairs array<long>, times array<int>",
    )


def _pairs_of_texts(found: Aligned, ids: np.ndarray, text: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """The links of each text by pair, as lists of pairs and of their counts."""
    pair = ragged(found.pair, found.link[ids], found.n_links[ids])
    table = pa.table({"text": np.repeat(text, found.n_links[ids]), "pair": pair})
    counted = table.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")])
    owner = counted.column("text").to_numpy()
    order = np.argsort(owner, kind="stable")
    bounds = pa.array(np.searchsorted(owner[order], np.arange(n + 1)), pa.int32())
    pairs = pa.array(counted.column("pair").to_numpy()[order])
    times = pa.array(counted.column("count_all").to_numpy()[order].astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pairs), pa.ListArray.from_arrays(bounds, times)


def pair_counts(linked: DataFrame, b: str = B_PATH) -> DataFrame:
    """``pair``, ``count`` (of its links in all rows), ``best``: 1 if none of its B id is higher."""
    width = len(tokenizers(b=b).b_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"pair": batch.column(0).flatten(), "count": batch.column(1).flatten().cast(pa.int64())})
            counted = table.group_by("pair", use_threads=False).aggregate([("count", "sum")])
            yield from counted.select(["pair", "count_sum"]).rename_columns(["pair", "count"]).combine_chunks().to_batches()

    parts = linked.select("pairs", "times").mapInArrow(run, "pair long, count long")
    counts = settle(parts.groupBy("pair").agg(F.sum("count").alias("count")), "counts")
    token = (F.col("pair") % width).alias("b")
    # a row per id of B
    highest = counts.groupBy(token).agg(F.max("count").alias("highest"))
    counts = counts.select("*", token).join(highest.hint("merge"), "b")
    return counts.select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def alignments(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    a: str = A_PATH,
    ranks: str = A_RANKS,
    b: str = B_PATH,
    head: int = HEAD,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``,
    ``n_best`` (links whose pair is the most frequent, or one of these, of its B id),
    ``count_sum`` (the counts of their pairs, added up over links), ``groups_sha256``.

    Null and empty texts, and texts that either tokenizer's tokens do not spell, have no
    tokens: zeros and an empty digest. Repeated rows are texts of their own. An empty table
    gives no rows.
    """
    linked = settle(links(docs, text, id_column, a, ranks, b), "links", "zstd")
    counts = settle(pair_counts(linked, b), "pairs")
    bound = head_bound(counts, "count", head)
    # at most ``head`` rows
    frequent = counts.where(F.col("count") >= bound).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(frequent.combine_chunks())
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["row", "id", "n", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "best", "count", "pair"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.append_column("place", pa.array(np.arange(sent.value.num_rows)))
        names_of, values = known.column("pair").to_numpy(), [known.column(c).to_numpy() for c in ("best", "count")]
        order = np.argsort(names_of)
        names_of, values = names_of[order], [v[order] for v in values]
        for batch in batches:
            n = batch.num_rows
            pairs, times = batch.column("pairs"), batch.column("times")
            owner = pc.list_parent_indices(pairs).to_numpy()
            pair, many = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            place = np.searchsorted(names_of, pair)
            near = place < len(names_of)
            near[near] = names_of[place[near]] == pair[near]
            sums = []
            for v in values:
                total = np.zeros(n, np.int64)
                np.add.at(total, owner[near], v[place[near]] * many[near])
                sums.append(pa.array(total))
            rest = [batch.column(c) for c in names[3:8]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), pa.nulls(n, pa.int64()), *rest, *sums, pa.nulls(n, pa.int64())], names
            )
            far = np.flatnonzero(~near)
            m = len(far)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(owner[far])),
                    pa.nulls(m, batch.column("id").type),
                    pa.array(many[far]),
                    *[pa.nulls(m, c.type) for c in rest],
                    *[pa.nulls(m, pa.int64())] * 2,
                    pa.array(pair[far]),
                ],
                names,
            )

    parts = linked.mapInArrow(
        run,
        f"row long, id {kind}, n long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "best long, count long, pair long",
    )
    parts = settle(parts, "parts", "zstd")
    whole = with_tail(parts, counts.where(F.col("count") < bound), "pair", ["best", "count"])
    return whole.select(
        F.col("id").alias(id_column),
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.col("best").alias("n_best"),
        F.col("count").alias("count_sum"),
        "groups_sha256",
    )
