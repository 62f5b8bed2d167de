"""Rows keep their numbers while the files are split anew from job to job."""

import itertools
import random

import corpus_pipeline
import pytest
from factmill.llm import components, fingerprints, jaccard, queries, rows
from factmill.session import settle
from plain import groups

SPLITS = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def folder(spark, tmp_path, monkeypatch):
    """Documents in files of unequal sizes, split in three ways by turns."""
    pick = random.Random(3)
    words = [a + b for a in "bdfgklmn" for b in ("alo", "ine", "ure", "asto")]
    texts = [" ".join(pick.choices(words, k=pick.randint(20, 60))) for _ in range(60)]
    texts += [f"{t} more" for t in texts[:30]] + texts[40:50]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    path = f"{tmp_path}/documents.parquet"
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (a, b) in enumerate([(0, 7), (7, 40), (40, 43), (43, 80), (80, 100)]):
        frame.where(f"doc_id >= {a} and doc_id < {b}").coalesce(1).write.mode("append").parquet(path)
    turns = itertools.cycle(["134217728", "9000", "3000"])

    def split_anew(*args, **kwargs):
        spark.conf.set(SPLITS, next(turns))
        return settle(*args, **kwargs)

    for module in (components, fingerprints, jaccard, queries, rows, corpus_pipeline):
        if hasattr(module, "settle"):
            monkeypatch.setattr(module, "settle", split_anew)
    yield str(tmp_path), docs
    spark.conf.unset(SPLITS)


def test_groups(spark, folder):
    path, docs = folder
    frame = spark.read.parquet(f"{path}/documents.parquet")
    want = groups([d[:2] for d in docs], 3, 90)
    for given in (frame, frame.where("doc_id >= 0")):
        out = jaccard.jaccard_groups(given, 3, 90).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == want
    kept = corpus_pipeline.drop_near_copies(spark, frame, path).collect()
    assert sorted(map(tuple, kept)) == [docs[k] for k in sorted({c for _, _, c in groups([d[:2] for d in docs], 5, 80)})]


def test_fingerprints(spark, folder):
    path, docs = folder
    out = {r.doc_id: r for r in queries.op10_multiset_fingerprints(spark, path).collect()}
    assert sorted(out) == [d[0] for d in docs]
    following = dict(zip(range(100), [*range(1, 100), 0]))
    by_text = {}
    for doc_id, text, *_ in docs:
        assert by_text.setdefault(text, out[doc_id].fingerprint) == out[doc_id].fingerprint
        assert out[doc_id].n_chars == len(text)
        if docs[following[doc_id]][1] == text:
            assert out[doc_id].near_next == 1
    import hashlib

    for doc_id, text, *_ in docs:
        half, after = len(text) // 2, docs[following[doc_id]][1]
        edited = text[: len(text) - half] + after[:half]
        assert out[doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
