import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from factmill.llm import language, packing, tokenfiles, topk, toxicity
from factmill.llm.wordids import PATH, word_ids
from plain import HARD_TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer


FRESH = Tokenizer.from_file(PATH)


def library_ids(text):
    """By the tokenizer as it is, which takes literals of its added tokens for one id each."""
    return FRESH.encode(text or "", add_special_tokens=False).ids


def separated_ids(text):
    """By the setting of the separator scan, which takes them for other characters."""
    return word_ids().tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packing(texts, rows, window):
    """``texts``: rows (doc_id, text) of distinct ids. All ids lie in one piece, sequences are gapless."""
    docs, sequences = {}, {}
    for r in rows:
        ids = library_ids(dict(texts)[r.doc_id]) + [packing.END_ID]
        piece = ids[r.start : r.start + r.length]
        assert r.doc_tokens == len(ids) and len(piece) == r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        docs.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts:
        at = 0
        for start, length in sorted(docs[doc_id]):
            assert start == at
            at += length
        assert at == len(library_ids(text)) + 1
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= window
    assert all(size & (size - 1) == 0 for size in sizes)
    return sizes


def test_packed_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_IDS", 900)
    monkeypatch.setattr(packing, "TASK_IDS", 2500)
    pick = random.Random(2)
    topics = [[f"{a}{b}" for b in "abcdefgh"] for a in ("ro", "ti", "ma")]
    texts = list(HARD_TEXTS)
    texts += [" ".join(pick.choices(topics[k % 3], k=pick.randint(1, 90))) for k in range(120)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, tail string").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    got = packing.pack_documents(docs, window=256).collect()
    sizes = check_packing([(k, t) for k, t, _ in rows], got, 256)
    assert 256 * sizes.count(256) > 0.85 * sum(sizes)
    assert packing.pack_documents(docs.limit(0)).count() == 0
    twice = packing.pack_documents(docs.where("doc_id = 2").unionAll(docs.where("doc_id = 2"))).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_neighbours_are_those_of_bm25():
    docs = [np.array(d) for d in ([1, 2, 3, 9], [1, 2, 7, 9], [4, 5, 6, 9], [3, 3, 3, 9], [8, 9, 9, 9])]
    idf = np.array([0, 1.0, 1.0, 1.5, 1, 1, 1, 1, 1, 0])
    index = packing.Index(docs, idf)
    mean = 4.0

    def score(a, b):
        found = 0.0
        for term in set(docs[a].tolist()):
            times = docs[b].tolist().count(term)
            norm = packing.K1 * (1 - packing.B + packing.B * len(docs[b]) / mean)
            found += idf[term] * times * (packing.K1 + 1) / (times + norm)
        return found

    used = np.zeros(5, bool)
    used[0] = True
    wanted = sorted((k for k in range(1, 5) if score(0, k)), key=lambda k: -score(0, k))
    assert index.neighbours(0, used).tolist() == wanted == [3, 1]


def brute_force_windows(docs, n_texts, window):
    """Documents (name, ids) in their order, packed by BM25 over every id; all by plain sums."""
    ids = [list(d) for _, d in docs]
    df = {t: sum(t in d[:-1] for d in ids) for d in ids for t in d[:-1]}
    idf = {t: np.log(1 + (n_texts - f + 0.5) / (f + 0.5)) for t, f in df.items()}
    mean = sum(map(len, ids)) / len(ids)
    taken, windows, room = [0] * len(ids), [[]], window

    def score(a, b):
        found = 0.0
        for t in sorted(set(ids[a]) & set(ids[b]) & set(idf)):
            times = ids[b].count(t)
            norm = packing.K1 * (1 - packing.B + packing.B * len(ids[b]) / mean)
            found += idf[t] * times * (packing.K1 + 1) / (times + norm)
        return found

    while left := [k for k in range(len(ids)) if taken[k] < len(ids[k])]:
        scores = {k: score(left[0], k) for k in left[1:]}
        for k in [left[0], *sorted(scores, key=lambda k: -scores[k])]:
            part = min(room, len(ids[k]) - taken[k])
            windows[-1].append((docs[k][0], taken[k], part))
            taken[k] += part
            room -= part
            if not room:
                windows.append([])
                room = window
                break
    return windows


def packed_and_brute_force(spark, path, texts, window):
    """Full windows that pack_documents makes of short texts, and those of brute force."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    docs = spark.read.parquet(path)
    got = {}
    for r in packing.pack_documents(docs, window=window).collect():
        got.setdefault(r.sequence_id, []).append((r.offset, r.doc_id, r.start, r.length))
    got = [[p[1:] for p in sorted(g)] for _, g in sorted(got.items())]
    got = [g for g in got if sum(p[2] for p in g) == window]
    own = packing.tokenized(docs, window=window).where("row is not null").orderBy("sketch", "row").collect()
    ids = [(r.doc_id, np.frombuffer(r.tail, "<u2").tolist()) for r in own]
    return got, brute_force_windows(ids, len(texts), window)


def test_packing_takes_the_neighbours_of_all_ids(spark, tmp_path):
    # every word stands in far more than a twentieth of the texts
    pick = random.Random(4)
    topics = [[f"{a}{b}" for b in "abcdef"] for a in "rtm"]
    texts = [" ".join(pick.choices(topics[k % 3], k=pick.randint(5, 40))) for k in range(90)]
    got, want = packed_and_brute_force(spark, str(tmp_path / "docs"), texts, 128)
    assert len(got) > 10
    assert got == want[: len(got)]


def test_packed_ids_are_those_of_the_library(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    end, begin = "<|endoftext|>", "<|startoftext|>"
    texts = [f"a {end} b", f"{end}{begin}", f"x{begin}'s{end}\u0301A", "<|ENDOFTEXT|> <|endof", "text|> 12", end, "", None]
    texts += [f"{t or ''} {end}" for t in HARD_TEXTS]
    rows = list(enumerate(texts))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    seen = {}
    for r in packing.pack_documents(spark.read.parquet(path), window=64).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [packing.END_ID]
        assert r.doc_tokens == len(ids), texts[r.doc_id]
        piece = np.array(ids[r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(piece.tobytes()), texts[r.doc_id]
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
        assert seen[r.doc_id] <= r.doc_tokens
    assert len(seen) == len(texts)


def test_powers():
    assert [packing.powers(n) for n in (0, 1, 12, 4095)] == [[], [1], [8, 4], [1 << k for k in range(11, -1, -1)]]


def test_token_counts_of_flat_files(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate([*HARD_TEXTS, "", "", None, "last one"])] + [(3, "again")]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    files = f"file://{tmp_path}/files"
    places = tokenfiles.write_token_files(spark.read.parquet(path), files)
    for block_ids in (1, 7, 1 << 20):
        got = tokenfiles.count_written(places, files, 2, block_ids).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((k, len(separated_ids(t))) for k, t in rows)
    empty = tokenfiles.write_token_files(spark.read.parquet(path).limit(0), files)
    assert tokenfiles.count_written(empty, files, 2).count() == 0


@pytest.mark.parametrize("block_ids", [1, 3, 100])
def test_files_with_an_open_end(spark, tmp_path, block_ids):
    end = tokenfiles.SEPARATOR
    streams = {"a": [1, 2, end, end, 3, end], "b": [5, 5, 5, 5], "c": [], "d": [end, 7], "e": [end]}
    for name, ids in streams.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u4").tobytes())
    files = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in streams], "file string")
    got = tokenfiles.count_tokens(files, 4, block_ids=block_ids).collect()
    found = sorted((r.file[-1], r.place, r.n_tokens) for r in got)
    assert found == [("a", 0, 2), ("a", 1, 0), ("a", 2, 1), ("b", 0, 4), ("d", 0, 0), ("d", 1, 1), ("e", 0, 0)]


def test_top_k_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 37)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 1, (4, 12))
    rows = [(k, (centres[k % 4] + draw.normal(0, 0.3, 12)).tolist()) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(20)] + [(0, rows[0][1]), (500, [])]
    rows += [(900, None), (1000, [None] * 12), (1100, [float("nan")] * 12), (1200, [float("inf")] * 12), (700, [2.0, -1.0])]
    path = str(tmp_path / "v")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).write.parquet(path)
    vectors = topk.integer_vectors(spark.read.parquet(path))
    got = topk.top_k(vectors, F.col("vec_id") % 50 == 0).collect()

    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for a, (query, u) in enumerate(kept):
        if query % 50:
            continue
        scores = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(kept) if b != a)
        want += [(query, rank, i, -s) for rank, (s, i) in enumerate(scores[:10], 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk.top_k(vectors.where("vec_id < 3"), F.col("vec_id") == 1).collect()
    assert len(few) == 3
    assert topk.top_k(vectors.limit(0), F.col("vec_id") == 1).count() == 0


SAMPLE = {
    "de": "der die und das ist nicht ein wort mit sich auf für zwischen schnell",
    "en": "the of and to in is that it was with as this quick whether",
    "es": "el los las que del por con una para su como rápido",
    "fr": "le les des et du que une dans pour qui sur est vite où",
}


def documents(spark, n=240, seed=1):
    pick = random.Random(seed)
    rows = []
    for k in range(n):
        lang = list(SAMPLE)[k % 4]
        text = " ".join(pick.choices(SAMPLE[lang].split(), k=pick.randint(8, 60)))
        rows.append((k, text, lang, f"src{k % 3}", len(text)))
    return rows


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def test_languages_of_pages(spark):
    rows = documents(spark)
    train, held = rows[:160], rows[160:]
    counts = language.trigram_counts(spark.createDataFrame(train, DOCUMENT))
    table = language.log_likelihoods(counts)
    pages = [
        (k, f"http://www.{lang}host.example.{lang}/p?x", f"<html lang='{lang}'><script>the of</script><p>{text}</p>")
        for k, text, lang, _, _ in held
    ]
    # declared wrongly, without text, without anything
    pages += [(1000, "http://x.dehost.example.de/", "<html lang=fr><p>der die und das ist nicht ein wort"),
              (1001, "http://www.frhost.example.fr/", "<html lang=fr></html>"), (1002, None, None), (1003, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r for r in language.identify_pages(df, table).collect()}
    assert len(out) == len(pages)
    hits = sum(out[k].language == lang for k, _, lang, _, _ in held)
    assert hits >= 0.95 * len(held)
    assert out[1000].language == "de" and out[1001].language == "fr"
    assert all(0 < r.confidence <= 1 + 1e-9 for r in out.values())
    assert language.identify_pages(df.limit(0), table).count() == 0


def test_unknown_languages_go(spark, tmp_path):
    rows = documents(spark)
    noise = random.Random(9)
    for k in range(6):
        rows.append((5000 + k, "".join(noise.choices("0123456789+/=%$#@&*XQZKWJ", k=400)), "xx", "src0", 400))
    rows += [(6000, None, None, None, None), (6001, "", "en", "src1", 0)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, DOCUMENT).write.parquet(path)
    kept = language.known_language(spark.read.parquet(path))
    assert kept.columns == [c.split()[0] for c in DOCUMENT.split(", ")]
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(240)) <= ids and not ids & set(range(5000, 5006))
    assert {6000, 6001} <= ids


def toxic_texts(n, seed):
    pick = random.Random(seed)
    calm = [a + b for a in "bcdfglmnprstv" for b in ("alo", "ine", "ure", "asto", "emi")]
    rude = ["vermox", "vermoxen", "vermoxig", "trashy", "clown"]
    texts, labels = [], []
    for k in range(n):
        words = pick.choices(calm, k=pick.randint(5, 80))
        if k % 4 == 0:
            for _ in range(pick.randint(1, 3)):
                words[pick.randrange(len(words))] = pick.choice(rude)
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


def test_toxicity_held_out():
    texts, labels = toxic_texts(600, 1)
    model = toxicity.train(pa.array(texts), labels)
    again, truth = toxic_texts(300, 2)
    scores = toxicity.scored_texts(model, pa.array(again))
    assert ((scores >= 0.5) == truth).mean() > 0.97
    assert (scores >= 0).all() and (scores <= 1).all()
    # a word form that was never seen shares its beginning with those that were
    assert toxicity.scored_texts(model, pa.array(["balo vermoxlich cine dure"]))[0] >= 0.5
    # the same text scores alike wherever it stands
    blocks = toxicity.scored_texts(model, pa.array([again[5], None, "", again[5], again[4]]))
    assert blocks[0] == blocks[3] and blocks[1] == blocks[2] < 0.5
    same = toxicity.train(pa.array(texts), labels)
    assert np.array_equal(same.embeddings, model.embeddings)


def test_toxicity_without_labels():
    for labels in (np.zeros(3, np.int64), np.ones(3, np.int64)):
        model = toxicity.train(pa.array(["a", "b", None]), labels)
        assert (toxicity.scored_texts(model, pa.array(["a", None])).round() == labels[0]).all()
    model = toxicity.train(pa.array([], pa.string()), np.zeros(0, np.int64))
    assert toxicity.scored_texts(model, pa.array(["a"]))[0] < 0.5


def test_fit_and_score(spark):
    texts, labels = toxic_texts(400, 3)
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)] + [(1, None, None)], "doc_id long, text string, score string")
    marks = spark.createDataFrame([(k, 1, int(l)) for k, l in enumerate(labels)] + [(7, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks, F.col("doc_id") % 5 != 0, rows=150)
    out = docs.select("doc_id", toxicity.score(spark, model).alias("s")).where("doc_id % 5 = 0").collect()
    assert np.mean([(r.s >= 0.5) == labels[r.doc_id] for r in out]) > 0.95


def rare_words(rude, n, seed):
    """Calm texts, and one text for each of ``n`` times each of the rude words."""
    texts, _ = toxic_texts(4 * n * len(rude), seed)
    calm = [t for k, t in enumerate(texts) if k % 4]
    pick, out = random.Random(seed), [(t, 0) for t in calm[: 2 * n * len(rude)]]
    for word in rude * n:
        words = pick.choice(calm).split()
        words[pick.randrange(len(words))] = word
        out.append((" ".join(words), 1))
    return out


def test_every_labelled_text_is_trained_on(spark):
    """Words that a few texts have are learnt though a part holds few of these texts."""
    rude = [a + b + "zz" for a in "hjkqwxyz" for b in ("ax", "oq", "uj", "ek", "iw")]
    given = rare_words(rude, 8, 1)
    again = rare_words(rude, 2, 2)
    docs = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(given)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, l) for k, (_, l) in enumerate(given)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True), rows=60)
    scores = toxicity.scored_texts(model, pa.array([t for t, _ in again]))
    truth = np.array([l for _, l in again]) == 1
    assert (scores[truth] >= 0.5).mean() > 0.9 and (scores[~truth] < 0.5).mean() > 0.95
    other = toxicity.fit(docs.repartition(7), marks, F.lit(True), rows=60)
    assert np.allclose(other.embeddings, model.embeddings, atol=1e-5) and np.allclose(other.shift, model.shift, atol=1e-3)


def test_parts_hold_every_text_once(spark, monkeypatch):
    texts, labels = toxic_texts(90, 4)
    monkeypatch.setattr(toxicity, "PART_WORDS", 300)
    rows = [(k // 40, t, int(l)) for k, (t, l) in enumerate(zip(texts, labels))] + [(5, "", 1)]
    given = spark.createDataFrame(rows, "part long, text string, label int").coalesce(1).sortWithinPartitions("part")
    stored = toxicity._stored(toxicity.parts_of(given, 11))
    parts = list(toxicity._read_parts(stored.toArrow().to_batches()))
    assert len({p.number for p in parts}) == len(parts) > 9 and max(len(p.rows) for p in parts) <= 11
    got = sorted((p.number[0], row.tobytes(), int(l)) for p in parts for row, l in zip(p.rows, p.labels))
    want = []
    for part, text, label in rows:
        (_, _, hashes, _), = toxicity.words_of(pa.array([text]))
        want.append((part, toxicity.features(hashes).tobytes(), label))
    assert got == sorted(want)


def test_one_part_is_trained_as_it_is(spark):
    texts, labels = toxic_texts(100, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame([(k, int(l)) for k, l in enumerate(labels)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, F.lit(True))
    order = [r.doc_id for r in docs.orderBy(F.xxhash64(F.lit(7), "doc_id")).collect()]
    want = toxicity.train(pa.array([texts[k] for k in order]), labels[order])
    assert np.array_equal(model.embeddings, want.embeddings) and np.array_equal(model.shift, want.shift)


def test_parts_without_one_of_the_labels(spark):
    docs = spark.createDataFrame([(k, f"word{k} and more") for k in range(30)], "doc_id long, text string")
    for label in (0, 1):
        marks = docs.select("doc_id", F.lit(label).alias("toxic"))
        model = toxicity.fit(docs, marks, F.lit(True), rows=3)
        assert (toxicity.scored_texts(model, pa.array(["a word", None])).round() == label).all()
    model = toxicity.fit(docs, marks, F.lit(False), rows=3)
    assert toxicity.scored_texts(model, pa.array(["a word"]))[0] < 0.5


def test_language_keeps_columns_of_any_name(spark, tmp_path):
    """Names with a dot, and such as the operator uses itself, come through unchanged."""
    rows = [(k, "the house is in the old town", "en", "a.example", k, f"h{k}") for k in range(3)]
    path = str(tmp_path / "named")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` long, host string").write.parquet(path)
    kept = language.known_language(spark.read.parquet(path))
    assert kept.columns == ["doc_id", "text", "lang", "source", "a.b", "host"]
    assert sorted(tuple(r) for r in kept.collect()) == rows
