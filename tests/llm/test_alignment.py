"""Aligned tokens against the libraries' own encodings, document by document."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from factmill.llm import alignment, queries
from plain import HARD_TEXTS
from tokenizers import Tokenizer

FOLDER = "/root/testdata/sf0.001"
MORE = [
    " lead",
    "trail ",
    "  two  spaces ",
    "a▁b ok",
    "x <|endoftext|> y <s> z </s>",
    "été déjà – “quoted” 中文 字 a b c",
    "\x1c\x1d a\x85b ᠎ c​ d",
    "i̇ ɐ ⱥ 𝒳 a",
    "԰ b \U0001fadf c",
    "\x00 a",
    "same words same words same words",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, b


def byte_of_character():
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(text, libraries):
    """Links and groups of a text, or None."""
    a, b = libraries
    if not text:
        return None
    of = byte_of_character()
    first = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    second = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        second.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(t for _, t in side) != whole for side in (first, second)):
        return None
    ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (first, second)]
    links, groups, i, j = [], [([], [])], 0, 0
    while i < len(first):
        links.append((first[i][0], second[j][0]))
        step_a, step_b = ends[0][i] <= ends[1][j], ends[1][j] <= ends[0][i]
        if step_a:
            groups[-1][0].append(first[i][0])
        if step_b:
            groups[-1][1].append(second[j][0])
        if step_a and step_b:
            groups.append(([], []))
        i, j = i + step_a, j + step_b
    return links, groups[:-1]


def as_text(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def plain_table(rows, libraries):
    done = [(k, plain_alignment(t, libraries)) for k, t in rows]
    count = Counter(link for _, d in done if d for link in d[0])
    highest = Counter()
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for k, d in done:
        if d is None:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        links, groups = d
        best = sum(count[x] == highest[x[1]] for x in links)
        sizes = [sum(len(g[s]) for g in groups) for s in (0, 1)]
        digest = hashlib.sha256(as_text(groups).encode()).hexdigest()
        out.append((k, *sizes, len(groups), len(links), best, sum(count[x] for x in links), digest))
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("head", [alignment.HEAD, 3])
def test_hard_texts(spark, libraries, head):
    rows = [(k, t) for k, t in enumerate([*HARD_TEXTS, *MORE])] + [(None, "a null id"), (7, "again"), (7, "again")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, pair string, row int")
    out = alignment.alignments(docs, head=head).collect()
    assert in_order(out) == in_order(plain_table(rows, libraries))


def test_groups(spark, libraries):
    docs = spark.createDataFrame([(t,) for t in [*HARD_TEXTS, *MORE]], "text string")
    for r in docs.select("text", alignment.token_groups("text").alias("groups")).collect():
        own = plain_alignment(r.text, libraries)
        assert r.groups == (as_text(own[1]) if own else "")


def test_blocks_and_chunks_change_nothing(spark, libraries, monkeypatch):
    texts = [*HARD_TEXTS, *MORE]
    whole = [plain_alignment(t, libraries) for t in texts]
    import pyarrow as pa

    for chunk, block in ((1, 1), (16, 100), (4096, 1 << 22)):
        monkeypatch.setattr(alignment, "CHUNK", chunk)
        for i, j, found, ids, bounds in alignment._aligned(pa.array(texts), alignment.tokenizers(), block):
            joined = alignment._joined(found, ids, bounds).to_pylist()
            assert joined == [as_text(w[1]) if w else "" for w in whole[i:j]]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignments(docs).collect() == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert in_order(alignment.alignments(only).collect()) == [(1, *[0] * 6, ""), (2, *[0] * 6, "")]


def test_query(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    out = queries.op12_arrow_alignment(spark, FOLDER).collect()
    assert in_order(out) == in_order(plain_table(rows, libraries))
