"""Every registered query over the smallest tables, against plain Python or SQL."""

import hashlib
import zlib

import __spark_entry__ as entry
import numpy as np
import pytest
from factmill.llm import bpe, queries
from plain import base_secrets
from test_corpus_operators import check_packing, separated_ids
from workload import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def run(spark, name):
    return queries.REGISTRY[name](spark, FOLDER)


def test_all_are_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.REGISTRY)
    assert numbers == list(range(1, 14))
    assert set(queries.REGISTRY) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equal_to_sql(spark, name):
    _, problem = compare.compare(
        spark, compare.database(FOLDER), FOLDER, queries.REGISTRY[name], queries.ORACLES[name]
    )
    assert not problem


def test_pages(spark):
    out = run(spark, "op1_bayesian_language").collect()
    assert len(out) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    assert np.mean([r.language == r.declared for r in out]) > 0.9


def test_ids(spark, texts):
    out = run(spark, "op3_byte_bpe").collect()
    assert len(out) == len(texts)
    for r in out:
        ids = bpe.coder().coder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_secrets(spark, texts):
    out = run(spark, "op5_secrets").collect()
    assert len(out) == len(texts)
    for r in out:
        base = base_secrets(texts[r.doc_id])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        counts = [sum(k == kind for k, _, _ in base) for kind in ("assign", "access", "hex")]
        assert [r.n_assign, r.n_access, r.n_hex] == counts
        assert [s for s in r.spans.split(",") if s.split(":")[0] in ("assign", "access", "hex")] == (
            joined.split(",") if joined else []
        )
    assert sum(r.n_assign + r.n_access + r.n_hex for r in out) > 0


def test_packed(spark, texts):
    frame = run(spark, "op6_retrieval_packing")
    assert {t for c, t in frame.dtypes if c != "doc_id"} == {"bigint"}
    sizes = check_packing(list(texts.items()), frame.collect(), 4096)
    assert 4096 * sizes.count(4096) > 0.9 * sum(sizes)


def test_sharded(spark, texts):
    out = run(spark, "op7_shuffled_shards").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    counts = [sum(r.shard == k for r in out) for k in range(24)]
    assert sum(counts) == len(out) and max(counts) - min(counts) <= 1
    for k in range(24):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(counts[k]))
    for r in out:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_toxic(spark, texts):
    out = run(spark, "op8_convolutional_toxicity").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)


def test_counted(spark, texts):
    out = run(spark, "op9_separator_scan").collect()
    assert {r.doc_id: r.n_tokens for r in out} == {k: len(separated_ids(t)) for k, t in texts.items()}


def test_fingerprinted(spark, texts):
    out = run(spark, "op10_multiset_fingerprints").collect()
    assert sorted(r.doc_id for r in out) == sorted(texts)
    order = sorted(texts)
    prints = {}
    for r in out:
        text, following = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len(prints)
    assert np.mean([r.near_edited for r in out]) > np.mean([r.near_next for r in out]) + 0.25
