"""Periodic runs against a plain search over all lags."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from factmill.llm import periodic, queries
from plain import HARD_TEXTS

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=12):
    """(start, length, period) of all runs, by start and period."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in drop]


def found(words, rounds=periodic.ROUNDS):
    runs = periodic.runs_of_words(np.array(words, np.int64), np.array([0, len(words)]), rounds)
    return [(s, e - s, q) for s, e, q in runs.tolist()]


@pytest.mark.parametrize("seed", range(8))
def test_equal_to_plain_search(seed):
    pick = random.Random(seed)
    for _ in range(60):
        n, kinds = pick.choice([0, 11, 12, 40, 150, 400]), pick.choice([1, 2, 3, 6, 40])
        words = [pick.randrange(kinds) for _ in range(n)]
        for _ in range(pick.choice([0, 1, 3]) if n > 3 else 0):
            p, a, more = pick.randrange(1, n // 2 + 1), pick.randrange(n), pick.randrange(n)
            for i in range(a + p, min(n, a + more)):
                words[i] = words[i - p]
        assert found(words, pick.choice([0, 1, 32])) == plain_runs(words)


def test_words_built_to_repeat():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    assert found(b) == plain_runs(b)
    thue = [bin(i).count("1") % 2 for i in range(256)] * 3
    assert found(thue) == plain_runs(thue)
    # the longest periods there are, and a run that ends with its text
    long = list(range(1000)) * 2
    assert found(long) == [(0, 2000, 1000)]
    assert found([7, 8, *[1, 2, 3] * 5, 1]) == [(2, 16, 3)]


def test_texts_do_not_run_into_each_other():
    ids = np.array([1] * 11 + [1] * 11, np.int64)
    assert not len(periodic.runs_of_words(ids, np.array([0, 11, 22])))
    assert len(periodic.runs_of_words(ids, np.array([0, 22]))) == 1


@pytest.mark.parametrize("rounds", [0, 2, 32])
def test_segments_hold_no_rare_word(rounds):
    # 1 2 1 3 2 4 3 ...: the last word is rare, and without it the one before
    ids = np.array([1, *[x for k in range(2, 500) for x in (k, k - 1)], *[0] * 12])
    before, after = periodic.occurrences(ids, np.zeros(len(ids), np.int64))
    starts, ends = periodic.frequent_segments(before, after, np.array([0]), np.array([len(ids)]), rounds)
    for s, e in zip(starts, ends):
        assert (np.unique(ids[s:e], return_counts=True)[1] > 1).all()
    assert [(s, e) for s, e in zip(starts, ends)] == [(len(ids) - 12, len(ids))]


def test_a_wrong_claim_of_a_hash_is_scanned_again(monkeypatch):
    monkeypatch.setattr(periodic, "mix", lambda x: np.zeros(len(x), np.uint64))
    words = [*range(40), *list(range(100, 120)) * 3, *range(200, 230)] * 2
    assert found(words) == plain_runs(words)


def test_columns(spark):
    texts = [*HARD_TEXTS, "a b c " * 9, "x\x1fy " * 30 + "z", "b " * 11, "the end " * 6]
    rows = [(k, t, "clash") for k, t in enumerate(texts)] * 2 + [(None, "q " * 20, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    out = docs.select("doc_id", "text", periodic.runs("text").alias("f"), periodic.collapse("text").alias("c")).collect()
    assert len(out) == len(rows)
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = plain_runs(words) if len(words) < 1000 else [tuple(x) for x in r.f.runs]
        assert [tuple(x) for x in r.f.runs] == runs and r.f.n_words == len(words)
        joined = " ".join(plain_kept(words, runs))
        assert r.f.collapsed_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.c == (None if r.text is None else joined)
    assert docs.limit(0).select(periodic.runs("text")).collect() == []


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    out = queries.op11_periodic_runs(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    planted = 0
    for r in out:
        words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        planted += len(runs) > 0
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        start, length, period = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), start, length, period)
        assert r.exponent_milli == (1000 * length // period if runs else None)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        kept = " ".join(plain_kept(words, runs))
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 10
