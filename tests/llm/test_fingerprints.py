"""Fingerprints and likeness by a plain sum over paragraphs, and the plan of the query."""

import hashlib
import math
import random
import re

import pytest
from factmill.llm import fingerprints, queries
from plain import HARD_TEXTS
from pyspark.sql import functions as F

MASK = (1 << 32) - 1


def plain_lanes(text, hashes):
    """``hashes``: Spark's 64-bit hash of each tuple that ``needed`` lists."""
    lanes = [0] * fingerprints.LANES
    for p in (text or "").split("\n"):
        a, b = hashes[p, 0], hashes[p, 1]
        for k in range(fingerprints.EXACT):
            lanes[k] += hashes[a, b, k] & MASK
        for run in plain_runs(p):
            for k in range(fingerprints.SIGNS):
                lanes[fingerprints.EXACT + k] += (hashes[run,] >> k & 1) * 2 - 1
    return [x & MASK for x in lanes]


def plain_runs(p):
    pattern = fingerprints.PIECE if len(p) <= fingerprints.SHORT else fingerprints.RUN
    return [m.rstrip(" ") for m in re.findall(pattern, p, re.ASCII)]


def hashed(spark, texts):
    paragraphs = sorted({p for t in texts for p in (t or "").split("\n")})
    runs = sorted({r for p in paragraphs for r in plain_runs(p)})
    out = {}
    frame = spark.createDataFrame([(p,) for p in paragraphs], "p string")
    a, b = F.xxhash64("p", F.lit(0)), F.xxhash64("p", F.lit(1))
    for r in frame.select("p", a.alias("a"), b.alias("b"), *[F.xxhash64(a, b, F.lit(k)).alias(f"h{k}") for k in range(fingerprints.EXACT)]).collect():
        out[r.p, 0], out[r.p, 1] = r.a, r.b
        for k in range(fingerprints.EXACT):
            out[r.a, r.b, k] = r[f"h{k}"]
    if runs:
        for r in spark.createDataFrame([(x,) for x in runs], "r string").select("r", F.xxhash64("r").alias("h")).collect():
            out[r.r,] = r.h
    return out


def plain_likeness(a, b):
    signed = [[x - (1 << 32) if x >> 31 else x for x in lanes[fingerprints.EXACT :]] for lanes in (a, b)]
    if a == b:
        return 1.0
    size = math.sqrt(sum(x * x for x in signed[0])) * math.sqrt(sum(x * x for x in signed[1]))
    return min(1.0, max(0.0, sum(x * y for x, y in zip(*signed)) / size)) if size else 0.0


def test_lanes_and_likeness_are_those_of_plain_sums(spark):
    texts = [*HARD_TEXTS, "a line\nanother line\na line", "another line\na line\na line"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    rows = {r.k: r.lanes for r in fingerprints.fingerprints(frame, ["k"], "text").collect()}
    hashes = hashed(spark, texts)
    for k, t in enumerate(texts):
        assert rows[k] == plain_lanes(t, hashes), t
    assert rows[len(texts) - 1] == rows[len(texts) - 2]
    pairs = spark.createDataFrame([(rows[i], rows[j]) for i in range(5, 12) for j in range(5, 12)], "a array<long>, b array<long>")
    for r in pairs.select("a", "b", fingerprints.likeness(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == pytest.approx(plain_likeness(r.a, r.b))


def texts_of_many_scripts():
    pick = random.Random(4)
    latin = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in "nrst"]
    signs = [chr(c) for c in range(0x4E00, 0x5200)]
    for k in range(120):
        n = pick.randint(60, 300)
        kind = k % 3
        if kind == 0:
            yield " ".join(pick.choices(latin, k=n))
        elif kind == 1:
            yield "".join(pick.choices(signs, k=n))
        else:
            yield "\n".join(" ".join(pick.choices(latin, k=pick.randint(1, 30))) for _ in range(n // 20 + 2))


def test_edited_texts_are_nearer_than_the_next(spark, tmp_path):
    rows = list(enumerate(texts_of_many_scripts()))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_multiset_fingerprints(spark, str(tmp_path)).collect()
    # an estimate by 64 signs
    assert sum(r.near_edited <= r.near_next for r in out) <= 1


def test_null_repeated_and_no_ids(spark, tmp_path):
    rows = [(None, "without an id"), (3, "third text here"), (1, "first text here"), (1, "first again"), (7, None), (7, None), (None, None)]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, head string, row int")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op10_multiset_fingerprints(spark, str(tmp_path)).collect()
    # the next of 1 is 3, of 3 is 7, of 7 the first row of 1; a row without id has none
    edited = {None: ["without", ""], 3: ["third te"], 1: ["first tethird t", "first first"[:6] + "third"], 7: ["", ""]}
    want = sorted(hashlib.sha256(t.encode()).hexdigest() for ts in edited.values() for t in ts)
    assert sorted(r.edited_sha256 for r in out) == want
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((k or 0, len(t or "")) for k, t in rows)
    assert all(r.near_next == 0 for r in out if r.doc_id is None)
    frame.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op10_multiset_fingerprints(spark, f"{tmp_path}/none").collect() == []


def test_texts_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(queries.fingerprints, "fingerprints", lambda df, keys, text: df.select(*keys, F.array(F.lit(1)).alias("lanes"), text))
    kept = []
    settle = queries.settle
    monkeypatch.setattr(queries, "settle", lambda df, label, *a: kept.append((label, df)) or settle(df, label, *a))
    queries.op10_multiset_fingerprints(spark, "/root/testdata/sf0.01")
    plan = next(df for label, df in kept if label == "prints")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = plan.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "ReusedExchange" in shown
    whole = [x for x in re.findall(r"FileScan parquet \[[^]]*text", shown)]
    # one for both joins, and one for rows without id, which are not shuffled
    assert len(whole) == 2


def test_narrow_lanes_are_whole_again(spark):
    lanes = [0, 1, (1 << 31) - 1, 1 << 31, MASK - 63, MASK]
    frame = spark.createDataFrame([(lanes,), ([],), (None,)], "lanes array<long>")
    narrow = frame.select(fingerprints.narrow(F.col("lanes")).alias("lanes"))
    assert narrow.schema["lanes"].dataType.simpleString() == "array<int>"
    assert [r[0] for r in narrow.select(fingerprints.wide(F.col("lanes"))).collect()] == [lanes, [], None]
