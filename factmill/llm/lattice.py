"""Language model scores from all segmentations of words into an existing vocabulary.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end for each text.
The model mixes two estimates of a token, by the share of new words in training:

* the token's own count in the training texts, and
* a lattice: a space and the word, as bytes, are cut into pieces of a given subword
  vocabulary in every possible way. A piece has a probability, a segmentation the product of
  its pieces', and the word the sum over all segmentations (``Lattice.forward``, in log space).

The vocabulary's own scores weigh the pieces at first. Where a file has ranks instead of log
probabilities, as one of merges does, the weight is the inverse of the rank. The expected
counts of the pieces in all segmentations of all distinct training words, by the forward and
the backward recursion, are then added to ``PRIOR`` times these weights, ``LEARNED`` times
over. Distinct words count once, as the lattice stands for words that are new. No piece is
made or left out, so the tokenizer stays as it is.

Each distinct word of the table passes the lattice once, wherever it stands: words are
counted by a grouped sum, and the texts meet the counts in two ways. Words so frequent that
no more than ``HEAD`` reach their count are sent to every task; the others, none of them
frequent, are joined. So no key of the join is hot, and the counts may grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.distinct import HEAD, exact_ids, gathered, head_bound, with_tail, word_spans
from factmill.llm.rows import numbered
from factmill.llm.words import LOWER, blocks, flat_texts, ragged
from factmill.session import settle

PATH = public_tokenizers.path("piece_bpe_32k.model")
PRIOR = 3_200.0
"""Counts that the vocabulary's own scores are worth."""
LEARNED = 2
"""Rounds in which the weights of the pieces are learned."""
SPACE = "▁"
WORDS = 1 << 15
"""Words whose lattices are built at once."""
_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    """The byte strings of a vocabulary's pieces as a trie, and the weight of each."""

    def __init__(self, path: str = PATH) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        weights: dict[bytes, float] = {}
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece, score = model.id_to_piece(i), model.get_score(i)
            rank = size if model.is_byte(i) else 1 - score
            key = bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode()
            weights[key] = weights.get(key, 0) + 1 / rank
        # every byte is a piece, so that every word has a segmentation
        for byte in range(256):
            weights.setdefault(bytes([byte]), 1 / size)
        self.pieces = sorted(weights)
        prior = np.array([weights[p] for p in self.pieces])
        self.prior = prior / prior.sum()
        self._build()

    def _build(self) -> None:
        """States of the trie: of one byte its value; ``keys`` are state and byte, in order."""
        states = {bytes([b]): b for b in range(256)}
        for piece in self.pieces:
            for n in range(2, len(piece) + 1):
                states.setdefault(piece[:n], len(states))
        self.piece = np.full(len(states), -1)
        for k, piece in enumerate(self.pieces):
            self.piece[states[piece]] = k
        steps = sorted((states[p[:-1]] << 8 | p[-1], s) for p, s in states.items() if len(p) > 1)
        self.keys = np.array([k for k, _ in steps], np.int64)
        self.to = np.array([s for _, s in steps], np.int64)

    def arcs(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces in ``data``: first byte, length, piece. ``ends``: end of each byte's word."""
        at, state = np.arange(len(data)), data.astype(np.int64)
        found = [(at, np.ones(len(at), np.int64), self.piece[state])]
        length = 1
        while len(at):
            length += 1
            inside = at + length <= ends[at]
            at, state = at[inside], state[inside]
            key = state << 8 | data[at + length - 1]
            k = np.searchsorted(self.keys, key)
            k[k == len(self.keys)] = 0
            alive = self.keys[k] == key
            at, state = at[alive], self.to[k[alive]]
            piece = self.piece[state]
            some = piece >= 0
            found.append((at[some], np.full(some.sum(), length), piece[some]))
        return tuple(np.concatenate(x) for x in zip(*found))


def vocabulary(path: str = PATH) -> Vocabulary:
    """The vocabulary of this process, read once."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Lattice:
    """The segmentations of some words, each with a space before it.

    A word of ``n`` bytes has the nodes 0 to ``n + 1``; an arc is a piece between two nodes.
    """

    def __init__(self, words: pa.Array, weights: np.ndarray, own: Vocabulary) -> None:
        flat, bounds = flat_texts(words)
        n = np.diff(bounds) + 1
        self.first = np.cumsum(n + 1) - n - 1
        self.last = self.first + n
        data = np.full(int(n.sum()), 0x20, np.uint8)
        begin = np.cumsum(n) - n
        inside = np.ones(len(data), bool)
        inside[begin] = False
        data[inside] = flat
        at, length, self.piece = own.arcs(data, np.repeat(begin + n, n))
        word = np.repeat(np.arange(len(n)), n)
        self.start = at + word[at]
        self.end = self.start + length
        self.word = word[at]
        self.log = np.log(weights)[self.piece]
        self.nodes = len(data) + len(n)

    def _recursion(self, source: np.ndarray, target: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Log sums over all ways to each node; ``step``: how far the target is on its way."""
        order = np.lexsort((target, step))
        source, target, log = source[order], target[order], self.log[order]
        new = np.ones(len(target), bool)
        new[1:] = target[1:] != target[:-1]
        first = np.flatnonzero(new)
        total = np.full(self.nodes, -np.inf)
        total[begin] = 0
        at = np.searchsorted(step[order], np.arange(1, int(step.max(initial=0)) + 2))
        groups = np.searchsorted(first, at)
        for i, j, g, h in zip(at[:-1], at[1:], groups[:-1], groups[1:]):
            ways = total[source[i:j]] + log[i:j]
            total[target[first[g:h]]] = np.logaddexp.reduceat(ways, first[g:h] - i)
        return total

    def forward(self) -> np.ndarray:
        return self._recursion(self.start, self.end, self.end - self.first[self.word], self.first)

    def backward(self) -> np.ndarray:
        return self._recursion(self.end, self.start, self.last[self.word] - self.start, self.last)

    def marginals(self) -> np.ndarray:
        """Log of the sum over all segmentations of each word."""
        return self.forward()[self.last]

    def expected(self, times: np.ndarray, size: int) -> np.ndarray:
        """How often each piece is expected in all segmentations, words counted ``times``."""
        ahead, behind = self.forward(), self.backward()
        share = np.exp(ahead[self.start] + self.log + behind[self.end] - ahead[self.last][self.word])
        return np.bincount(self.piece, share * times[self.word], size)


def _in_bulk(batches: Iterator[pa.RecordBatch], rows: int = WORDS) -> Iterator[pa.Table]:
    """Batches put together, so that lattices of many words are built at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= 1 << 22:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tokens(column: pa.Array):
    """For each block of texts: first row, row behind the last, words' numbers, words, bounds."""
    for i, j, data, bounds in blocks(column):
        data = LOWER[data]
        starts, ends = word_spans(data, bounds)
        ids, words = exact_ids(gathered(data, starts, ends))
        yield i, j, ids, words, np.searchsorted(starts, bounds)


def token_counts(docs: DataFrame, text: str, training: Column) -> DataFrame:
    """Every distinct token: ``word`` (null: the end), ``n`` in all rows, ``c`` in training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learned = batch.column(1).to_numpy(zero_copy_only=False)
            for i, j, ids, words, row in _tokens(batch.column(0)):
                mine = np.repeat(learned[i:j], np.diff(row))
                n = np.bincount(ids, minlength=len(words))
                c = np.bincount(ids[mine], minlength=len(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())]),
                        pa.array(np.append(n, j - i)),
                        pa.array(np.append(c, learned[i:j].sum())),
                    ],
                    ["word", "n", "c"],
                )

    rows = docs.select(text, F.coalesce(training, F.lit(False)).alias("learned"))
    parts = rows.mapInArrow(run, "word string, n long, c long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def piece_weights(
    counts: DataFrame, path: str = PATH, prior: float = PRIOR, rounds: int = LEARNED
) -> np.ndarray:
    """Probabilities of the vocabulary's pieces, learned from all words with a count ``c``.

    One row for each piece, at most, comes to the driver in a round.
    """
    own = vocabulary(path)
    weights = own.prior
    known = counts.where("word is not null and c > 0").select("word")
    for _ in range(rounds):
        sums = _expected(known, weights, path).groupBy("piece").agg(F.sum("expected"))
        weights = prior * own.prior
        for piece, expected in sums.collect():
            weights[piece] += expected
        weights = weights / weights.sum()
    return weights


def _expected(words: DataFrame, weights: np.ndarray, path: str) -> DataFrame:
    """Expected counts of pieces in the segmentations of the words, summed over each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        total = np.zeros(len(own.pieces))
        for table in _in_bulk(batches):
            lattice = Lattice(table.column(0).chunk(0), weights, own)
            total += lattice.expected(np.ones(table.num_rows), len(total))
        piece = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(total[piece])], ["piece", "expected"])

    return words.mapInArrow(run, "piece long, expected double")


def with_marginals(counts: DataFrame, weights: np.ndarray, path: str = PATH) -> DataFrame:
    """``counts`` with ``marginal``, the log10 of the sum over all segmentations; null for the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for table in _in_bulk(batches):
            words = table.column(0).chunk(0)
            logs = Lattice(words, weights, own).marginals() / np.log(10)
            logs = pc.if_else(pc.is_valid(words), pa.array(logs, pa.float64()), None)
            yield from table.append_column("marginal", logs).to_batches()

    columns = counts.select("word", "n", "c")
    return columns.mapInArrow(run, "word string, n long, c long, marginal double")


def weighted(tokens: DataFrame, n: int, distinct: int, ends: int) -> DataFrame:
    """Tokens with ``base`` and ``score``, log10 of their probabilities.

    ``base`` is ``(c + 0.5) / (n + 0.5 (distinct + 1))``. ``score`` is
    ``(c + (distinct + 1) q) / (n + distinct + 1)``: ``q`` is, for the end, its share ``e`` of
    all tokens, one more of each kind added, and for a word ``1 - e`` times its marginal.
    """
    base = F.log10((F.col("c") + 0.5) / F.lit(n + 0.5 * (distinct + 1)))
    end = (ends + 1) / (n + 2)
    words = np.log10((distinct + 1) * (1 - end))
    new = F.when(F.col("word").isNull(), F.lit(float(np.log10((distinct + 1) * end)))).otherwise(
        F.col("marginal") + float(words)
    )
    # a marginal may be too small for a number that is not a logarithm
    seen = F.log10(F.col("c") + F.pow(F.lit(10.0), new))
    score = F.when(F.col("c") > 0, seen).otherwise(new) - float(np.log10(n + distinct + 1))
    return tokens.select("word", "n", (F.col("c") > 0).cast("long").alias("known"), base.alias("base"), score.alias("score"))


def scores(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    id_column: str = "doc_id",
    path: str = PATH,
    head: int = HEAD,
) -> DataFrame:
    """One row per row of ``docs``: the id, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` and ``score``, log10 probabilities of the whole text.

    The model learns from rows where ``training`` is true. A null or empty text is its end
    alone. Repeated rows are texts of their own. An empty table gives no rows; without
    training rows no token is known and the vocabulary's own scores remain.
    """
    counts = settle(token_counts(docs, text, training), "counts")
    total, distinct, ends = counts.agg(
        F.coalesce(F.sum("c"), F.lit(0)),
        F.count_if(F.col("c") > 0),
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("c"))), F.lit(0)),
    ).first()
    weights = piece_weights(counts, path)
    tokens = weighted(with_marginals(counts, weights, path), total, distinct, ends)
    tokens = settle(tokens, "tokens")
    bound = head_bound(tokens, "n", head)
    # at most ``head`` rows, and the end
    frequent = tokens.where((F.col("n") >= bound) | F.col("word").isNull()).drop("n").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(frequent.combine_chunks())
    rows = numbered(docs, F.col(id_column).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        if not table.num_rows:
            return  # no rows, not even an end
        order = pc.sort_indices(pc.is_null(table.column("word")))
        table = table.take(order).combine_chunks()
        # the last is the end
        names = table.column("word").combine_chunks().cast(pa.large_binary())[:-1]
        values = np.stack([table.column(c).to_numpy().astype(float) for c in ("known", "base", "score")], 1)
        values, end = values[:-1], values[-1]
        for batch in batches:
            for i, j, ids, words, row in _tokens(batch.column(2)):
                place = pc.index_in(words, value_set=names).fill_null(-1).to_numpy(zero_copy_only=False)
                place = place.astype(np.int64)[ids]
                doc = np.repeat(np.arange(j - i), np.diff(row))
                near = place >= 0
                sums = [np.bincount(doc[near], values[place[near], k], j - i) + end[k] for k in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(np.diff(row) + 1),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.nulls(j - i, pa.string()),
                    ],
                    names_,
                )
                pairs, times = np.unique(doc[~near] * len(words) + ids[~near], return_counts=True)
                doc, word = np.divmod(pairs, max(1, len(words)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc + i)),
                        pa.nulls(len(doc), batch.column(1).type),
                        pa.array(times),
                        pa.nulls(len(doc), pa.int64()),
                        pa.nulls(len(doc), pa.float64()),
                        pa.nulls(len(doc), pa.float64()),
                        words.take(pa.array(word)).cast(pa.string()),
                    ],
                    names_,
                )

    names_ = ["row", "id", "n", "known", "base", "score", "word"]
    parts = rows.select("row", "id", "text").mapInArrow(
        run, f"row long, id {kind}, n long, known long, base double, score double, word string"
    )
    parts = settle(parts, "parts", "zstd")
    rest = tokens.where((F.col("n") < bound) & F.col("word").isNotNull()).drop("n")
    whole = with_tail(parts, rest, "word", ["known", "base", "score"])
    return whole.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        "score",
    )
