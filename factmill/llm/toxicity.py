"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of four hashed embeddings: the whole word and its first 4, 5 and 6 bytes,
so that inflected forms share what they learn. Filters of one, two and three words slide
over the text, each keeps its largest value, and a logistic layer adds these up. The first
component of an embedding starts from the log odds of its hash in the training texts and
is otherwise learnt like the rest. All labelled texts are trained on: dealt into parts, each
round trains every part apart from the same model, and the next goes on from the mean of
what they changed; one part is trained as it is. The outputs of each language are then moved so that its
own threshold stands at 0.5; the language is guessed from function words of the text
itself, no other column is ever looked at.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm.words import LOWER, WHITE, blocks, hashed_words
from factmill.session import batches_of, settled_folder

PREFIXES = (4, 5, 6)
BUCKETS = 1 << 16
"""Rows of each of the four embedding tables."""
SIZE, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
PART_ROWS = 4000
"""Half the labelled rows of a part; a part is cut at four times as many."""
PART_WORDS = 1 << 22
"""Words at which a part is cut, too."""
SENT_ROWS = 500_000
"""Labels up to which they are sent to all tasks; beyond it they are joined."""
BATCH = 4 << 20
"""Bytes of texts that a task is sent at once."""
ROUNDS, BATCH_ROWS, RATE = 4, 32, 0.05
CALIBRATION = 4
"""One in so many training rows is kept from training and sets the thresholds."""
# Frequent function words by which a language is told, for its threshold only.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on with as be this",
    "fr": "le la les des et du que un une dans pour qui sur est par",
    "de": "der die und das den von mit ist des zu ein nicht sich auf für",
    "es": "el los las y que del por con una para su es al lo como",
}
LANGUAGES = ("other", *FUNCTION_WORDS)
_MARKS = WHITE.copy()
_MARKS[0x21:0x7F] = True
_MARKS[0x30:0x3A] = False
_MARKS[0x41:0x5B] = False
_MARKS[0x61:0x7B] = False


def words_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with the hashes of their words and where each row's words begin.

    Words end at white space and ASCII marks; ASCII letters are lower-cased.
    """
    for i, j, data, bounds in blocks(column):
        starts, _, hashes = hashed_words(LOWER[data], bounds, _MARKS, PREFIXES)
        yield i, j, hashes, np.searchsorted(starts, bounds)


def features(hashes: np.ndarray) -> np.ndarray:
    """Rows of the embedding tables for the hashes of words."""
    low = (hashes % np.uint64(BUCKETS)).astype(np.int32)
    return low + (np.arange(hashes.shape[1]) * BUCKETS).astype(np.int32)


def _language_table() -> tuple[np.ndarray, np.ndarray]:
    hashes, codes = [], []
    for code, words in enumerate(FUNCTION_WORDS.values(), 1):
        for word in words.split():
            raw = np.frombuffer(word.encode(), np.uint8)
            hashes.append(hashed_words(raw, np.array([0, len(raw)]), _MARKS)[2][0, 0])
            codes.append(code)
    order = np.argsort(hashes)
    return np.array(hashes)[order], np.array(codes)[order]


_FUNCTION_HASHES, _FUNCTION_CODES = _language_table()


def guessed_languages(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The language with most function words in each text; none of them is ``other``."""
    at = np.minimum(np.searchsorted(_FUNCTION_HASHES, hashes), len(_FUNCTION_HASHES) - 1)
    hit = np.flatnonzero(_FUNCTION_HASHES[at] == hashes)
    n = len(bounds) - 1
    row = np.searchsorted(bounds, hit, "right") - 1
    votes = np.bincount(row * len(LANGUAGES) + _FUNCTION_CODES[at[hit]], minlength=n * len(LANGUAGES))
    return votes.reshape(n, len(LANGUAGES)).argmax(1)


@dataclass
class Model:
    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    weights: np.ndarray
    offset: float
    shift: np.ndarray
    scale: float = 1.0

    def pooled(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest value of every filter in each text, and the word where it begins.

        A text shorter than a filter, and the places behind its end, read zero vectors.
        """
        n = len(bounds) - 1
        most = max(WIDTHS) - 1
        words = np.zeros((len(ids) + most, SIZE), np.float32)
        for column in ids.T:
            words[: len(ids)] += self.embeddings[column]
        count = np.diff(bounds)
        last = np.repeat(bounds[1:], count)
        full = np.flatnonzero(count)
        values = np.zeros((n, len(WIDTHS) * FILTERS), np.float32)
        places = np.zeros((n, len(WIDTHS) * FILTERS), np.int64)
        here = np.arange(len(ids))
        for k, width in enumerate(WIDTHS):
            out = np.zeros((len(ids), FILTERS), np.float32)
            for step in range(width):
                part = words[step : step + len(ids)] @ self.filters[k][step]
                if step:
                    part[here + step >= last] = 0
                out += part
            out += self.bias[k]
            span = slice(k * FILTERS, (k + 1) * FILTERS)
            values[:, span] = self.bias[k]
            if len(full):
                values[full, span] = np.maximum.reduceat(out, bounds[full], axis=0)
                if self.tracking:
                    for row in full:
                        a, b = bounds[row], bounds[row + 1]
                        places[row, span] = a + out[a:b].argmax(0)
        return values, places

    tracking: bool = False

    def logits(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.maximum(self.pooled(ids, bounds)[0], 0) @ self.weights + self.offset

    def scores(self, logits: np.ndarray, languages: np.ndarray) -> np.ndarray:
        z = (logits.astype(float) - self.shift[languages]) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def seen_in(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """For each label and embedding row, the texts that it is seen in."""
    seen = np.zeros((2, 4 * BUCKETS))
    for ids, label in zip(rows, labels):
        seen[label, np.unique(ids)] += 1
    return seen


def log_odds(seen: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each embedding row, how much likelier it is in texts of label 1, shrunk by its error.

    ``texts`` are the texts of each label.
    """
    total = texts + 1.0
    a, b = seen[1] + 0.5, seen[0] + 0.5
    odds = np.log(a / total[1]) - np.log(b / total[0])
    error = np.sqrt(1 / a + 1 / b)
    return np.sign(odds) * np.maximum(np.abs(odds) - error, 0)


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> Model:
    """A model for texts and their labels 0 and 1; a fixed seed gives the same model."""
    rows: list[np.ndarray] = []
    languages: list[np.ndarray] = []
    for _, _, hashes, bounds in words_of(texts):
        ids = features(hashes)
        rows += [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        languages.append(guessed_languages(hashes[:, 0], bounds))
    return _trained(rows, labels, np.concatenate(languages) if languages else np.zeros(0, np.int64), seed)


def _trained(rows: list[np.ndarray], labels: np.ndarray, language: np.ndarray, seed: int) -> Model:
    draw = np.random.default_rng(seed)
    model = _untrained(draw)
    n = len(rows)
    if not n or len(np.unique(labels)) < 2:
        model.offset = 10.0 if n and labels[0] else -10.0
        return model
    kept = _kept(n, draw)
    learn = np.flatnonzero(~kept)
    odds = log_odds(seen_in([rows[i] for i in learn], labels[learn]), np.bincount(labels[learn], minlength=2))
    slow = _primed(model, odds)
    for turn in range(ROUNDS):
        _round(model, rows, labels, draw.permutation(learn), turn, slow)
    model.tracking = False
    check = np.flatnonzero(kept)
    if len(np.unique(labels[check])) < 2:
        check = np.arange(n)
    z = model.logits(*_joined([rows[i] for i in check]))
    _calibrate(model, z, labels[check], language[check])
    return model


def _untrained(draw: np.random.Generator) -> Model:
    return Model(
        draw.normal(0, 0.01, (4 * BUCKETS, SIZE)).astype(np.float32),
        [draw.normal(0, 0.1, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        draw.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32),
        0.0,
        np.zeros(len(LANGUAGES)),
    )


def _kept(n: int, draw: np.random.Generator) -> np.ndarray:
    """Which of ``n`` rows are kept from training."""
    kept = np.zeros(n, bool)
    if n >= 10 * CALIBRATION:
        kept[draw.permutation(n)[: n // CALIBRATION]] = True
    return kept


def _primed(model: Model, odds: np.ndarray) -> dict:
    """Set where training starts; the squares of gradients so far, by which steps are scaled."""
    model.embeddings[:, 0] = odds
    for k, w in enumerate(WIDTHS):
        model.filters[k][:, 0, : FILTERS // 2] = 1 / w
        model.weights[k * FILTERS : k * FILTERS + FILTERS // 2] = 0.25
    model.offset = -2.0
    model.tracking = True
    return {"w": np.full_like(model.weights, 1e-6), "e": np.full(4 * BUCKETS, 1e-6, np.float32)}


def _round(
    model: Model, rows: list[np.ndarray], labels: np.ndarray, order: np.ndarray, turn: int, slow: dict
) -> None:
    rate = RATE / (1 + turn)
    for at in range(0, len(order), BATCH_ROWS):
        some = order[at : at + BATCH_ROWS]
        _step(model, [rows[i] for i in some], labels[some], rate, slow)


def _joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return np.concatenate(rows) if len(rows) else np.zeros((0, 4), np.int32), bounds


def _step(model: Model, rows: list[np.ndarray], labels: np.ndarray, rate: float, slow: dict) -> None:
    """One step down the gradient of the logistic loss, scaled by the gradients so far."""
    ids, bounds = _joined(rows)
    values, places = model.pooled(ids, bounds)
    active = np.maximum(values, 0)
    z = active @ model.weights + model.offset
    error = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - labels) / len(rows)
    back = (error[:, None] * model.weights) * (values > 0)
    grad = active.T @ error + 1e-4 * model.weights
    slow["w"] += grad**2
    model.weights -= (rate * grad / np.sqrt(slow["w"])).astype(np.float32) * 0.2
    model.offset -= rate * float(error.sum())
    end = bounds[1:]
    for k, width in enumerate(WIDTHS):
        span = slice(k * FILTERS, (k + 1) * FILTERS)
        for step in range(width):
            at = places[:, span] + step
            inside = (at < end[:, None]) & (np.diff(bounds)[:, None] > 0)
            row, col = np.nonzero(inside & (back[:, span] != 0))
            if not len(row):
                continue
            feature = ids[at[row, col]]
            vector = model.embeddings[feature].sum(1)
            pull = back[row, k * FILTERS + col].astype(np.float32)
            change = np.zeros((FILTERS, SIZE), np.float32)
            np.add.at(change, col, pull[:, None] * vector)
            push = pull[:, None] * model.filters[k][step][:, col].T
            flat = feature.reshape(-1)
            spread = np.repeat(push, feature.shape[1], axis=0)
            np.add.at(slow["e"], flat, (spread**2).mean(1))
            np.add.at(model.embeddings, flat, -rate * 0.2 * spread / np.sqrt(slow["e"][flat] + 1e-8)[:, None])
            model.filters[k][step] -= rate * np.clip(change.T, -1, 1)
        model.bias[k] -= rate * np.clip(back[:, span].sum(0), -1, 1).astype(np.float32)


def _threshold(logits: np.ndarray, labels: np.ndarray) -> float:
    """Midway between the neighbours that the fewest errors separate; ties: the widest gap."""
    order = np.argsort(logits, kind="stable")
    z, y = logits[order], labels[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + (len(y) - y.sum()) - np.concatenate([[0], np.cumsum(1 - y)])
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(edges)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[gap[best].argmax()]
    return float((edges[k] + edges[k + 1]) / 2)


def _calibrate(model: Model, z: np.ndarray, labels: np.ndarray, language: np.ndarray) -> None:
    """Thresholds by guessed language from logits; those with few rows of a class keep the common one."""
    common = _threshold(z, labels)
    model.shift[:] = common
    for code in range(len(LANGUAGES)):
        own = language == code
        if min(labels[own].sum(), (1 - labels[own]).sum()) >= 10:
            model.shift[code] = _threshold(z[own], labels[own])
    spread = z[labels == 1].mean() - z[labels == 0].mean()
    model.scale = float(np.clip(8 / max(spread, 1e-3), 0.5, 20))


@dataclass
class Part:
    """Labelled texts that are trained in one go; ``number`` tells parts apart."""

    number: tuple[int, int]
    rows: list[np.ndarray]
    labels: np.ndarray
    language: np.ndarray

    def kept(self, seed: int) -> np.ndarray:
        return _kept(len(self.rows), np.random.default_rng([seed, *self.number]))


PARTS = "part long, number long, place long, label byte, language byte, ids binary"


def parts_of(texts: DataFrame, most: int) -> DataFrame:
    """``PARTS``, a row per text, of texts (part, text, label) that come in order of their part.

    A part of more than ``most`` texts, or of too many words, becomes several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, number, place, words = None, 0, 0, 0
        for batch in batches:
            part = batch.column(0).to_pylist()
            for i, j, hashes, bounds in words_of(batch.column(1)):
                numbers, places = [], []
                for k, count in enumerate(np.diff(bounds).tolist()):
                    if part[i + k] != last:
                        last, number, place, words = part[i + k], 0, 0, 0
                    elif place >= most or words >= PART_WORDS:
                        number, place, words = number + 1, 0, 0
                    numbers.append(number)
                    places.append(place)
                    place, words = place + 1, words + count
                ids = (hashes % np.uint64(BUCKETS)).astype("<u2")
                size = ids.itemsize * ids.shape[1]
                raw = pa.Array.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer((bounds * size).astype(np.int64)), pa.py_buffer(ids.tobytes())]
                )
                language = pa.array(guessed_languages(hashes[:, 0], bounds), pa.int8())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(numbers, pa.int64()),
                        pa.array(places, pa.int64()),
                        batch.column(2).slice(i, j - i).cast(pa.int8()),
                        language,
                        raw.cast(pa.binary()),
                    ],
                    ["part", "number", "place", "label", "language", "ids"],
                )

    return texts.select("part", "text", "label").mapInArrow(run, PARTS)


def _stored(parts: DataFrame) -> DataFrame:
    """The parts as files, one for each, so that a part is always in one task."""
    spark = parts.sparkSession
    path = f"{settled_folder(spark)}/parts-{uuid.uuid4().hex}"
    parts.write.option("compression", "zstd").partitionBy("part", "number").parquet(path)
    names = ["part", "number", "place", "label", "language", "ids"]
    return spark.read.schema(PARTS).parquet(path).select(names)


def _read_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    shift = (np.arange(1 + len(PREFIXES)) * BUCKETS).astype(np.int32)
    held: list[pa.RecordBatch] = []

    def made() -> Part:
        table = pa.Table.from_batches(held).sort_by("place")
        raw = table["ids"].combine_chunks().cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] // (2 * len(shift))
        flat = np.frombuffer(data, "<u2") if data is not None else np.zeros(0, "<u2")
        ids = np.add(flat.reshape(-1, len(shift))[at[0] : at[-1]], shift, dtype=np.int32)
        return Part(
            (table["part"][0].as_py(), table["number"][0].as_py()),
            np.split(ids, (at - at[0])[1:-1]),
            table["label"].to_numpy().astype(np.int64),
            table["language"].to_numpy().astype(np.int64),
        )

    for batch in batches:
        part, number = (batch.column(k).to_numpy() for k in (0, 1))
        cuts = np.flatnonzero((part[1:] != part[:-1]) | (number[1:] != number[:-1])) + 1
        for i, j in zip([0, *cuts], [*cuts, batch.num_rows]):
            if i == j:
                continue
            some = batch.slice(i, j - i)
            if held and any(held[0].column(k)[0].as_py() != some.column(k)[0].as_py() for k in (0, 1)):
                yield made()
                held = []
            held.append(some)
    if held:
        yield made()


def _state(model: Model, slow: dict) -> np.ndarray:
    """All that training changes, in rows: those of embeddings, then the rest."""
    rest = np.concatenate(
        [np.ravel(x) for x in (*model.filters, *model.bias, model.weights, slow["w"], model.offset)]
    )
    out = np.zeros((4 * BUCKETS + -(-len(rest) // (SIZE + 1)), SIZE + 1), np.float32)
    out[: 4 * BUCKETS, 0], out[: 4 * BUCKETS, 1:] = slow["e"], model.embeddings
    out[4 * BUCKETS :].reshape(-1)[: len(rest)] = rest
    return out


def _base(seed: int) -> np.ndarray:
    """The state before any text is seen."""
    model = _untrained(np.random.default_rng(seed))
    return _state(model, _primed(model, np.zeros(4 * BUCKETS)))


def _sent_state(state: np.ndarray, seed: int) -> bytes:
    """The rows that differ from those the seed gives: little passes through the driver for few words."""
    row = np.flatnonzero((state != _base(seed)).any(1))
    return pickle.dumps((row.astype(np.int32), state[row]))


def _rows(sent: bytes, seed: int) -> np.ndarray:
    row, own = pickle.loads(sent)
    state = _base(seed)
    state[row] = own
    return state


def _of_state(state: np.ndarray) -> tuple[Model, dict]:
    rest, at = state[4 * BUCKETS :].reshape(-1), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return rest[at - int(np.prod(shape)) : at].reshape(shape).copy()

    filters = [take(w, SIZE, FILTERS) for w in WIDTHS]
    bias = [take(FILTERS) for _ in WIDTHS]
    weights, slow = take(len(WIDTHS) * FILTERS), take(len(WIDTHS) * FILTERS)
    model = Model(
        state[: 4 * BUCKETS, 1:].copy(), filters, bias, weights, float(take(1)[0]), np.zeros(len(LANGUAGES)), tracking=True
    )
    return model, {"w": slow, "e": state[: 4 * BUCKETS, 0].copy()}


def _one(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], bytes]) -> bytes:
    """What ``make`` makes of all rows, in one task; only that, of fixed size, comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([make(batches)], pa.binary())], ["made"])

    made = df.repartition(1).mapInArrow(run, "made binary").first()
    return bytes(made.made) if made else b""


def _start(parts: DataFrame, seed: int) -> tuple[np.ndarray, bytes]:
    """Texts of each label, and the state that training starts from."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # behind the embedding rows: all texts, and those not kept from training
        seen = np.zeros((2, 4 * BUCKETS + 2), np.int64)
        for part in _read_parts(batches):
            learn = np.flatnonzero(~part.kept(seed))
            seen[:, :-2] += seen_in([part.rows[i] for i in learn], part.labels[learn]).astype(np.int64)
            seen[:, -2] += np.bincount(part.labels, minlength=2)
            seen[:, -1] += np.bincount(part.labels[learn], minlength=2)
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, seen[0][some], seen[1][some])], ["row", "no", "yes"])

    def make(batches: Iterator[pa.RecordBatch]) -> bytes:
        seen = np.zeros((2, 4 * BUCKETS + 2))
        for batch in batches:
            row = batch.column(0).to_numpy()
            for k in (0, 1):
                seen[k, row] = batch.column(1 + k).to_numpy()
        model = _untrained(np.random.default_rng(seed))
        slow = _primed(model, log_odds(seen[:, :-2], seen[:, -1]))
        return seen[:, -2].tobytes() + _sent_state(_state(model, slow), seed)

    found = parts.mapInArrow(within, "row long, no long, yes long")
    made = _one(found.groupBy("row").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")), make)
    return np.frombuffer(made[:16]), made[16:]


def _next_state(parts: DataFrame, state: bytes, turn: int, seed: int) -> bytes:
    """A round in each part, from the same state; each row becomes the mean of the parts that change it.

    Parts weigh by their texts. A task adds up its parts and sends on one row for each changed one.
    """
    spark = parts.sparkSession
    sent = spark.sparkContext.broadcast(state)
    names = [f"c{k}" for k in range(SIZE + 1)]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = _rows(sent.value, seed)
        weight, total = np.zeros(len(before)), np.zeros(before.shape)
        for part in _read_parts(batches):
            model, slow = _of_state(before)
            learn = np.flatnonzero(~part.kept(seed))
            draw = np.random.default_rng([seed, *part.number, turn + 1])
            _round(model, part.rows, part.labels, draw.permutation(learn), turn, slow)
            after = _state(model, slow)
            moved = np.flatnonzero((after != before).any(1))
            weight[moved] += len(learn)
            total[moved] += len(learn) * (after[moved].astype(float) - before[moved])
        some = np.flatnonzero(weight)
        for at in range(0, len(some), 1 << 14):
            row = some[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.array(weight[row]), *[pa.array(x) for x in total[row].T]], ["row", "weight", *names]
            )

    def make(batches: Iterator[pa.RecordBatch]) -> bytes:
        after = _rows(sent.value, seed)
        for batch in batches:
            row, weight, *total = (x.to_numpy() for x in batch.columns)
            after[row] += np.stack(total, 1) / weight[:, None]
        return _sent_state(after, seed)

    changes = parts.mapInArrow(within, "row long, weight double, " + ", ".join(f"{c} double" for c in names))
    made = _one(changes.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("weight", *names)]), make)
    sent.destroy()
    return made


def _model(sent: bytes, seed: int) -> Model:
    model = _of_state(_rows(sent, seed))[0]
    model.tracking = False
    return model


def _calibrated(parts: DataFrame, state: bytes, seed: int, everything: bool = False) -> bytes:
    """Shift and scale of the model by the texts kept from training, pickled; nothing if these are of one class."""
    sent = parts.sparkSession.sparkContext.broadcast(state)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(sent.value, seed)
        for part in _read_parts(batches):
            check = np.arange(len(part.rows)) if everything else np.flatnonzero(part.kept(seed))
            for at in range(0, len(check), 256):
                some = check[at : at + 256]
                z = model.logits(*_joined([part.rows[i] for i in some]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(z.astype(np.float32)), pa.array(part.labels[some], pa.int8()), pa.array(part.language[some], pa.int8())],
                    ["z", "label", "language"],
                )

    def make(batches: Iterator[pa.RecordBatch]) -> bytes:
        held = [[x.to_numpy() for x in batch.columns] for batch in batches]
        z, labels, language = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0),) * 3
        if len(np.unique(labels)) < 2:
            return b""
        # in whatever order they come
        order = np.lexsort((language, labels, z))
        model = _untrained(np.random.default_rng(seed))
        _calibrate(model, z[order], labels[order].astype(np.int64), language[order])
        return pickle.dumps((model.shift, model.scale))

    made = _one(parts.mapInArrow(within, "z float, label byte, language byte"), make)
    sent.destroy()
    return made


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, rows: int = PART_ROWS, seed: int = 7
) -> Model:
    """Train on all labelled texts, in parts of some ``rows`` of each class.

    ``labels`` has doc_id and ``toxic``; ``usable`` is a condition on doc_id that a row must
    meet. Labels other than 0 and 1 and null texts are not used.
    """
    with batches_of(docs.sparkSession, BATCH):
        return _fit(docs, labels, usable, rows, seed)


def _fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, seed: int) -> Model:
    wanted = labels.where(usable & F.col("toxic").isin(0, 1)).select(
        "doc_id", F.col("toxic").cast("int").alias("label")
    ).distinct()
    many = wanted.count()
    if many <= SENT_ROWS:
        wanted = F.broadcast(wanted)
    order = F.xxhash64(F.lit(seed), "doc_id")
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(max(-(-many // (2 * rows)), 1)))
    texts = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(wanted, "doc_id")
        .select(part.alias("part"), order.alias("order"), "doc_id", "text", "label")
        .repartition("part")
        .sortWithinPartitions("part", "order", "doc_id", F.xxhash64("text"), "label")
    )
    parts = _stored(parts_of(texts, 4 * rows))
    if parts.select("part", "number").distinct().count() <= 1:

        def whole(batches: Iterator[pa.RecordBatch]) -> bytes:
            part = next(_read_parts(batches), Part((0, 0), [], *[np.zeros(0, np.int64)] * 2))
            return pickle.dumps(_trained(part.rows, part.labels, part.language, seed))

        made = _one(parts, whole)
        return pickle.loads(made) if made else train(pa.array([], pa.string()), np.zeros(0, np.int64), seed)
    given, state = _start(parts, seed)
    if not given.all():
        model = _untrained(np.random.default_rng(seed))
        model.offset = 10.0 if given[1] else -10.0
        return model
    for turn in range(ROUNDS):
        state = _next_state(parts, state, turn, seed)
    model = _model(state, seed)
    model.shift, model.scale = pickle.loads(
        _calibrated(parts, state, seed) or _calibrated(parts, state, seed, everything=True)
    )
    return model


def scored_texts(model: Model, column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column))
    for i, j, hashes, bounds in words_of(column):
        z = model.logits(features(hashes), bounds)
        out[i:j] = model.scores(z, guessed_languages(hashes[:, 0], bounds))
    return out


def score(spark: SparkSession, model: Model, text: Column | str = "text") -> Column:
    """From 0 to 1, higher for likelier toxic; 0.5 and more is predicted toxic.

    A null or empty text, or one without words, gets the score of no evidence.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(scored_texts(sent.value, texts))

    return run(text)
