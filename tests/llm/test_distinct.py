"""Words by exact number, and the bound of what is sent to all tasks."""

import numpy as np
import pyarrow as pa
from factmill.llm.distinct import exact_ids, gathered, head_bound, with_tail, word_spans
from factmill.llm.words import flat_texts
from plain import HARD_TEXTS, re


def test_words():
    texts = [*HARD_TEXTS, "a", "b c"]
    data, bounds = flat_texts(pa.array(texts))
    starts, ends = word_spans(data, bounds)
    words = gathered(data, starts, ends)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [w.decode() for w in words.to_pylist()] == [w for ws in want for w in ws]
    assert np.diff(np.searchsorted(starts, bounds)).tolist() == [len(ws) for ws in want]
    ids, distinct = exact_ids(words)
    assert distinct.take(pa.array(ids)).equals(words)
    assert len(distinct) == len({w for ws in want for w in ws})


def test_heads_are_bounded(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1] * 50 + [2] * 9 + [8, 9, 70, 0])], "k long, n long")
    for limit, bound in ((0, 128), (1, 16), (2, 16), (3, 4), (11, 4), (12, 2), (61, 2), (62, 1)):
        found = head_bound(counts, "n", limit)
        assert found == bound and counts.where(counts.n >= found).count() <= limit
    assert head_bound(counts.limit(0), "n", 5) == 1


def test_tail(spark):
    parts = spark.createDataFrame(
        [(1, None, None, 5), (2, None, None, 7), (1, "a", 2, None), (1, "b", 1, None)],
        "row long, key string, n long, sum long",
    )
    rest = spark.createDataFrame([("a", 10), ("b", 1), ("c", 4)], "key string, sum long")
    out = with_tail(parts, rest, "key", ["sum"]).select("row", "sum").collect()
    assert sorted(map(tuple, out)) == [(1, 26), (2, 7)]
