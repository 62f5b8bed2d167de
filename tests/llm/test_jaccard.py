import random

import numpy as np
import pyarrow as pa
import pytest
from factmill.llm import jaccard
from factmill.llm.components import components
from plain import HARD_TEXTS, groups, shingles


def store(spark, tmp_path, rows, extra=""):
    df = spark.createDataFrame(rows, "doc_id long, text string" + extra)
    path = str(tmp_path / "docs")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def edited(pick, words, share):
    return [pick.choice(ALPHABET) if pick.random() < share else w for w in words]


ALPHABET = [a + b + c for a in "abcdefgh" for b in "aeiou" for c in "lmnrst"]


def crowd(seed=3):
    """Copies, near copies, chains whose ends are far apart, common passages, short texts."""
    pick = random.Random(seed)
    texts = list(HARD_TEXTS)
    base = [pick.choice(ALPHABET) for _ in range(120)]
    texts += [" ".join(base)] * 4
    texts += [" ".join(edited(pick, base, share)) for share in (0.005, 0.01, 0.02, 0.03) for _ in range(25)]
    chain = list(base[:90])
    for _ in range(40):
        chain[pick.randrange(90)] = pick.choice(ALPHABET)
        texts.append(" ".join(chain))
    passage = [pick.choice(ALPHABET) for _ in range(60)]
    texts += [" ".join(passage + [pick.choice(ALPHABET) for _ in range(pick.randint(2, 60))]) for _ in range(40)]
    texts += [" ".join(pick.choices("a b c d".split(), k=pick.randint(1, 6))) for _ in range(60)]
    texts += [" ".join(pick.choices(ALPHABET, k=pick.randint(5, 200))) for _ in range(40)]
    pick.shuffle(texts)
    return texts


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80)])
def test_groups_equal_brute_force(spark, tmp_path, size, percent):
    rows = [(1000 - 3 * k, text) for k, text in enumerate(crowd())]
    docs = store(spark, tmp_path, rows)
    out = jaccard.jaccard_groups(docs, size, percent).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out)
    assert got == groups(rows, size, percent)
    assert sorted(r.component_id for r in out if r.kept and r.n_shingles) == sorted(
        {c for _, n, c in got if n}
    )
    assert all(r.kept for r in out if not r.n_shingles)


def test_search_alone_finds_all_links(spark, tmp_path, monkeypatch):
    """Without further leaders, in blocks of a few nodes, the search by R-tree has to do it."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    rows = [(k, text) for k, text in enumerate(crowd(4))]
    out = jaccard.jaccard_groups(store(spark, tmp_path, rows), 3, 90).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == groups(rows, 3, 90)


def test_repeated_rows_nulls_and_other_columns(spark, tmp_path):
    rows = [(7, "a b c d e f", "x"), (7, "a b c d e f", "y"), (7, "other words here", None), (None, "a b c d e f", "z"),
            (2, None, None), (None, None, None), (9, "A B c d e f", None)]
    docs = store(spark, tmp_path, rows, ", node string")
    out = jaccard.jaccard_groups(docs, 3, 90).collect()
    assert len(out) == len(rows)
    same = [r for r in out if r.n_shingles == 4]
    assert len(same) == 4 and {r.component_id for r in same} == {7}
    assert sum(r.kept for r in same) == 1 and sum(r.kept for r in out) == 4
    empty = jaccard.jaccard_groups(docs.where("doc_id = 100"), 3, 90)
    assert empty.count() == 0


def test_bound_never_falls_below_the_overlap():
    pick = random.Random(5)
    texts = [" ".join(pick.choices(ALPHABET[:30], k=pick.randint(3, 400))) for _ in range(60)]
    (_, _, row, h), = jaccard.text_sets(pa.array(texts), 3)
    counts = np.bincount(
        row * jaccard.GROUPS + (h % np.uint64(jaccard.GROUPS)).astype(int), minlength=60 * jaccard.GROUPS
    ).reshape(60, -1)
    sizes = np.bincount(row, minlength=60)
    sets = [shingles(t, 3) for t in texts]
    assert sizes.tolist() == [len(s) for s in sets]
    tree = jaccard.RTree(counts, sizes)
    for a in range(60):
        found = set(tree.search(counts[a], int(sizes[a]), 60).tolist())
        for b in range(60):
            common = len(sets[a] & sets[b])
            assert common <= np.minimum(counts[a], counts[b]).sum()
            if 100 * common >= 60 * len(sets[a] | sets[b]):
                assert b in found


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(300, 300), (-5, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {300: 300, -5: -5, 400: -5}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fine_points_bound_the_overlap():
    pick = np.random.default_rng(5)
    for _ in range(200):
        a = pick.integers(0, 1 << 52, pick.integers(1, 3000), dtype=np.uint64)
        b = np.concatenate([a[: pick.integers(0, len(a) + 1)], pick.integers(0, 1 << 52, pick.integers(1, 900), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        common = len(np.intersect1d(a, b))
        bound = jaccard.bounds([jaccard.fine_point(a)], [jaccard.fine_point(b)])[0]
        assert common <= bound <= min(len(a), len(b))


def test_fine_points_of_texts():
    texts = [" ".join(f"w{k}" for k in range(n)) for n in (1, 3, 200, 5000)] + ["q " * 2000, "a b " * 700]
    (_, _, row, h), = jaccard.text_sets(pa.array(texts), 3)
    for k, text in enumerate(texts):
        n = len(shingles(text, 3))
        value = jaccard.fine_point(h[row == k])
        (_, point), = jaccard._alike([value])
        assert point.sum() == n and point.size >= n
    # a group that holds more than a byte can count
    wide = b"4" + np.full(128, 300, "<u4").tobytes()
    thin = b"1" + np.full(256, 200, "u1").tobytes()
    assert jaccard.bounds([wide, thin, wide], [wide, wide, thin]).tolist() == [300 * 128] * 3


def test_points_of_one_cell_are_folded_to_the_coarsest():
    pick = np.random.default_rng(6)
    sets = [np.unique(pick.integers(0, 1 << 52, n, dtype=np.uint64)) for n in (40, 700, 90_000)]
    sizes = np.array([len(own) for own in sets])
    points = jaccard.points_of(pa.array([jaccard.fine_point(own) for own in sets], pa.binary()), sizes)
    assert points.shape == (3, 128) and points.sum(1, dtype=int).tolist() == sizes.tolist()


def test_main_component_is_asked_in_blocks(spark, monkeypatch):
    """Of a cell in several blocks no pair of different components is left out."""
    monkeypatch.setattr(jaccard, "CHUNK", 3)
    value = jaccard.fine_point(np.arange(50, dtype=np.uint64))
    nodes = [(k, 1 if k < 11 else k) for k in range(17)]
    members = spark.createDataFrame(
        [(9, node, component, 1, 17, 17 * 128) for node, component in nodes],
        "key long, node long, component long, main long, many long, bytes long",
    )
    points = spark.createDataFrame([(k, 50, value) for k, _ in nodes], "node long, n_shingles long, counts binary")
    got = {(r.a, r.b) for r in jaccard.cell_pairs(members, points, 80).collect()}
    assert got == {(a, b) for a, c in nodes for b, d in nodes if a < b and c != d}


def test_keys_that_components_share(spark, tmp_path, monkeypatch):
    """Keys are those of cells of several components, once each, whatever the blocks and batches."""
    monkeypatch.setattr(jaccard, "BLOCK_KEYS", 50)
    texts = crowd(7)
    rows = [(text, k % 5 if k % 3 else 0) for k, text in enumerate(texts)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "text string, component long").repartition(3).write.parquet(path)
    want, bands = {}, jaccard.Bands(80)
    for text, component in rows:
        for _, keys in jaccard.cells_of(pa.array([text]), 5, bands):
            for key in keys.tolist():
                want.setdefault(key, set()).add(component)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = [r.key for r in jaccard.met_keys(spark.read.parquet(path), 5, 80).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == sorted(key for key, components in want.items() if len(components) > 1)


def test_no_task_holds_a_table_of_its_keys(spark):
    """Keys, nearly all distinct, are not grouped in a hash table before or after the shuffle."""
    rows = spark.createDataFrame([("a b c d e f", 1)], "text string, component long")
    plan = jaccard.met_keys(rows, 5, 80)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" in plan


def test_fewer_words_in_all_than_a_shingle_has():
    for text in ("", "a", "a b", "a b c"):
        (_, _, row, h), = jaccard.text_sets(pa.array([text]), 5)
        assert len(h) == (1 if text else 0)


def test_linked_texts_share_a_key_in_any_order():
    pick = random.Random(9)
    texts = [" ".join(pick.choices("a b c d".split(), k=pick.randint(1, 9))) for _ in range(40)]
    for _ in range(12):
        base = pick.choices(ALPHABET, k=pick.randint(5, 150))
        texts += [" ".join(edited(pick, base, share)) for share in (0, 0.01, 0.02, 0.03, 0.04)]
        texts += [" ".join(base + pick.choices(ALPHABET, k=pick.randint(0, len(base) // 4))) for _ in range(3)]
    linked = 0
    for size, percent in ((3, 90), (5, 80), (2, 55)):
        bands = jaccard.Bands(percent, np.random.default_rng(size).integers(0, 6, jaccard.BUCKETS, np.uint8))
        keys = [set(key.tolist()) for text in texts for _, key in jaccard.cells_of(pa.array([text]), size, bands)]
        sets = [shingles(text, size) for text in texts]
        for a in range(len(texts)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    linked += 1
                    assert keys[a] & keys[b]
    assert linked > 200


def test_bands_count_the_shingles_of_all_texts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE", 1 << 20)
    texts = ["a b c d e"] * 64 + ["v w x y z", "", "one two", None]
    docs = spark.createDataFrame([(text,) for text in texts], "text string").repartition(3)
    band = jaccard.bands_of(docs, 5)
    (_, _, row, h), = jaccard.text_sets(pa.array(texts[63:67]), 5)
    assert row.tolist() == [0, 1, 3]
    assert band[jaccard.bucket_of(h)].tolist() == [1 + 6 * jaccard.STEPS, 1, 1]
    assert (band > 0).sum() == 3
    assert not jaccard.bands_of(docs.where("false"), 5).any()


def test_a_line_of_many_texts_is_no_cell(spark, tmp_path, monkeypatch):
    """Texts that share a line and no more do not meet: such cells grow with the square of the table."""
    pick, seen = random.Random(12), []
    line = " ".join(pick.choices(ALPHABET, k=30))
    rows = [(k, f"{line} " + " ".join(pick.choices(ALPHABET, k=30))) for k in range(200)]
    rows += [(1000 + k, text + " end") for k, text in rows[:5]]

    def open_cells(nodes, labels, draw):
        seen.append(nodes.count())
        return cells(nodes, labels, draw)

    cells = jaccard.open_cells
    monkeypatch.setattr(jaccard, "open_cells", open_cells)
    out = jaccard.jaccard_groups(store(spark, tmp_path, rows), 5, 80).collect()
    assert {r.doc_id: r.component_id for r in out} == {k: k % 1000 for k, _ in rows}
    assert seen == [0]
