"""Word probabilities over all segmentations against a plain recursion over byte strings."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from factmill.llm import lattice, queries
from plain import HARD_TEXTS, words
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def plain_marginal(word, weights):
    data = b" " + word.encode()
    ways = [1.0] + [0.0] * len(data)
    for j in range(1, len(data) + 1):
        ways[j] = sum(ways[i] * weights.get(data[i:j], 0.0) for i in range(j))
    return ways[-1]


def plain_weights(known, own):
    """Expected counts by listing every segmentation of short words."""
    weights = dict(zip(own.pieces, own.prior))
    for _ in range(lattice.LEARNED):
        total = Counter()
        for word in known:
            data = b" " + word.encode()
            ways = [((), 1.0)]
            done = []
            while ways:
                pieces, p = ways.pop()
                at = sum(map(len, pieces))
                if at == len(data):
                    done.append((pieces, p))
                for j in range(at + 1, len(data) + 1):
                    if data[at:j] in weights:
                        ways.append(((*pieces, data[at:j]), p * weights[data[at:j]]))
            whole = sum(p for _, p in done)
            for pieces, p in done:
                for piece in pieces:
                    total[piece] += p / whole
        prior = lattice.PRIOR
        weights = {k: prior * v + total[k] for k, v in zip(own.pieces, own.prior)}
        size = sum(weights.values())
        weights = {k: v / size for k, v in weights.items()}
    return weights


def plain_scores(rows, learned):
    own = lattice.vocabulary()
    tokens = [(k, [*words(t), None]) for k, t in rows]
    c = Counter(w for (k, ws), use in zip(tokens, learned) if use for w in ws)
    n, v = sum(c.values()), len(c)
    weights = plain_weights([w for w in c if w is not None], own)
    end = (c[None] + 1) / (n + 2)
    out = []
    for k, ws in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        score = 0.0
        for w in ws:
            q = end if w is None else (1 - end) * plain_marginal(w, weights)
            score += math.log10((c[w] + (v + 1) * q) / (n + v + 1))
        out.append((k, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return sorted(out)


def test_recursions():
    own = lattice.vocabulary()
    weights = dict(zip(own.pieces, own.prior))
    some = ["the", "straße", "日本", "a", "x" * 30, "", "eaueux", "😀", "▁b"]
    made = lattice.Lattice(pa.array(some), own.prior, own)
    assert np.allclose(made.marginals(), [math.log(plain_marginal(w, weights)) for w in some])
    # both ways give the same sum, and every byte lies in one piece of each segmentation
    assert np.allclose(made.backward()[made.first], made.marginals())
    expected = made.expected(np.ones(len(some)), len(own.pieces))
    covered = sum(x * len(p) for x, p in zip(expected, own.pieces))
    assert math.isclose(covered, sum(len(w.encode()) + 1 for w in some))


def test_very_long_words_do_not_underflow():
    own = lattice.vocabulary()
    made = lattice.Lattice(pa.array(["ab" * 5000, "q"]), own.prior, own).marginals()
    assert np.isfinite(made).all() and made[0] < -5000


@pytest.mark.parametrize("head", [lattice.HEAD, 1])
def test_scores(spark, head):
    rows = [(1, "To be, or not TO be"), (2, "be to\tor qx"), (3, None), (4, ""), (5, "to zq to"), (5, "to zq to"), (6, "or or\n or")]
    learned = [k not in (2, 5) for k, _ in rows]
    docs = spark.createDataFrame([(k, t, "x", 0.5) for k, t in rows], "doc_id long, text string, word string, score double")
    out = lattice.scores(docs, ~F.col("doc_id").isin(2, 5), head=head)
    got = sorted(tuple(r) for r in out.collect())
    want = plain_scores(rows, learned)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want])


def test_hard_tables(spark):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(HARD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = lattice.scores(docs, F.lit(True)).collect()
    assert len(out) == len(rows) and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in out)
    assert lattice.scores(docs.limit(0), F.lit(True)).collect() == []
    # nothing to learn from
    for r in lattice.scores(docs, F.lit(None).cast("boolean")).collect():
        assert r.n_known == r.train_tokens == 0 and r.base_score == 0 and r.score < 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    c = Counter(w for k, t in rows if not held[k] for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    out = {r.doc_id: r for r in queries.op13_subword_lattice(spark, FOLDER).collect()}
    assert len(out) == len(rows)
    for k, t in rows:
        r, own = out[k], [*words(t), None]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[k], len(own), sum(c[w] > 0 for w in own))
        assert r.train_tokens == n
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    # what was not learned is less likely, a token
    mean = [np.mean([r.score / r.n_tokens for r in out.values() if r.held_out == h]) for h in (False, True)]
    assert mean[0] > mean[1]
    # and more likely than its letters in another order
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learned = ~F.col("doc_id").isin([k for k, h in held.items() if h])
    backwards = [(k, re.sub(r"\S+", lambda m: m[0][::-1], t or "")) if held[k] else (k, t) for k, t in rows]
    other = {r.doc_id: r.score for r in lattice.scores(spark.createDataFrame(backwards, docs.schema), learned).collect()}
    worse = [other[k] < out[k].score for k, t in rows if held[k] and len(words(t)) > 20]
    assert np.mean(worse) > 0.95
