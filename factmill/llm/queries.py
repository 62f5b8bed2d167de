"""The operators over the given tables, as queries; the rows are those of the operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import (
    alignment,
    bpe,
    fingerprints,
    jaccard,
    language,
    lattice,
    packing,
    periodic,
    secrets,
    shards,
    tokenfiles,
    topk,
    toxicity,
)
from factmill.llm.rows import numbered
from factmill.session import settle, settled_folder

# The ASCII letters that the contract lower-cases.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op2_count_vector_rtree": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'),
    lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    END) AS s
  FROM words),
kinds AS (
  SELECT s, min(doc_id) AS k, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
shingles AS (SELECT k, n, unnest(s) AS g FROM kinds),
shared AS (
  SELECT a.k AS a, b.k AS b, a.n AS m, b.n AS n, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.k < b.k
    AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n
  GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 90 * (m + n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (
  SELECT k, k FROM kinds
  UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
component AS (SELECT a AS k, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles,
  coalesce(c.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN kinds t ON t.s = d.s LEFT JOIN component c ON c.k = t.k""",
    "op4_maxscore_topk": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r,
    list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, c.r AS cr,
    CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS rank FROM scored)
WHERE rank <= 10""",
    # the checksum of an id: bytes and eight shifts for each, by the reversed polynomial
    "op11_periodic_runs": r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
      string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, v: CASE WHEN v >= 0 THEN xor(s, v) ELSE xor(s >> 1, 3988292384 * (s & 1)) END),
      4294967295) AS h
  FROM documents),
places AS (
  SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM texts),
words AS (
  SELECT r, i, w[1 + CASE WHEN h % 10 = 0 AND i >= a
    THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END] AS word
  FROM (SELECT *, unnest(range(n)) AS i FROM places)),
same AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND x.i < y.i),
stretches AS (
  SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM (
    SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same)
  GROUP BY r, q, island),
runs AS (
  SELECT r, s, e - s AS m, min(q) AS q FROM stretches
  WHERE e - s >= greatest(12, 2 * q) GROUP BY r, s, e),
found AS (
  SELECT r, count(*) AS n_runs, min({'m': -m, 's': s, 'q': q}) AS best,
    string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY r),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words
  ANTI JOIN (SELECT DISTINCT r, unnest(range(s + q, s + m)) AS i FROM runs) USING (r, i)
  GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.m AS length, best.q AS period,
  1000 * -best.m // best.q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM texts LEFT JOIN found USING (r) LEFT JOIN kept USING (r)""",
}
BATCH_ROWS = "1000"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # rows hold whole texts: few of them at a time in a Python worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and the bytes that they decode to, as counts and digests."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", bpe.digests("text").alias("coded")).select("doc_id", "coded.*")


def op4_maxscore_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best inner products of every hundredth vector with all others."""
    vectors = topk.integer_vectors(table(spark, folder, "embeddings"))
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every text: counts of the base kinds, their digest, and all spans."""
    found = table(spark, folder, "documents").select("doc_id", secrets.find_secrets("text").alias("spans"))
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in secrets.BASE],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
    )


def op7_shuffled_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards of equal counts, in random order."""
    docs = table(spark, folder, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 8
    text = F.coalesce("text", F.lit(""))
    return shards.shuffled_shards(docs.select("doc_id", "text"), 24, size).select(
        "doc_id",
        size.cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Rows of one doc_id have the same next document; where that id has several rows, the
    first one counts. A row without doc_id has no next one: its edited text is its first
    part, and ``near_next`` is 0.
    """
    docs = numbered(
        table(spark, folder, "documents"), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )
    # one small row per document
    sizes = settle(docs.select("row", "doc_id", F.char_length("text").alias("n")), "sizes")
    ids = sizes.groupBy("doc_id").agg(F.min("row").alias("first"), F.max("n").alias("n"))
    order = fingerprints.neighbours(ids, "doc_id")
    order = settle(order, "order")
    # what a document gives to the one before it: as much of its beginning as that needs
    before = order.select(F.col("doc_id").alias("_previous"), (F.col("n") / 2).cast("int").alias("room"))
    giving = order.join(before, "_previous").select("doc_id", "first", "_previous", "room")
    # the same rows as below, so that one shuffle of the texts serves both joins
    known = docs.where(F.col("doc_id").isNotNull())
    heads = (
        known.join(giving, "doc_id")
        # equality would become a key of the join and call for a shuffle of its own; a bare
        # comparison would ask the scan for rows that have a number, and so for other rows
        .where(F.coalesce(F.col("row") <= F.col("first"), F.lit(False)))
        .select(F.col("_previous").alias("doc_id"), F.substring("text", F.lit(1), F.col("room")).alias("head"))
    )
    n = F.char_length("text")
    half = (n / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half),
        F.coalesce(F.substring("head", F.lit(1), half), F.lit("")),
    )
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("head", F.lit(""))
    both = known.join(heads, "doc_id", "left").unionByName(nameless)
    both = both.select("row", "doc_id", "text", edited.alias("edited"))
    texts = F.array(
        F.struct(F.lit(0).alias("kind"), "text", n.alias("n"), F.lit("").alias("sha")),
        F.struct(
            F.lit(1).alias("kind"),
            F.col("edited").alias("text"),
            F.char_length("edited").alias("n"),
            F.sha2(F.col("edited").cast("binary"), 256).alias("sha"),
        ),
    )
    stacked = both.select("row", "doc_id", F.explode(texts).alias("x")).select("row", "doc_id", "x.*")
    prints = fingerprints.fingerprints(stacked, ["row", "doc_id", "kind", "n", "sha"], "text")
    prints = settle(prints.withColumn("lanes", fingerprints.narrow(F.col("lanes"))), "prints", "zstd")
    whole = prints.where("kind = 0")
    changed = prints.where("kind = 1").select("row", F.col("sha").alias("edited_sha256"), F.col("lanes").alias("edited"))
    # small rows name the first row of the next document; then all meet by row
    firsts = order.select(F.col("doc_id").alias("_next"), F.col("first").alias("_first"))
    nexts = sizes.select("row", "doc_id").join(order.select("doc_id", "_next"), "doc_id")
    nexts = nexts.join(firsts, "_next").select("row", "_first")
    following = nexts.join(whole.select(F.col("row").alias("_first"), F.col("lanes").alias("following")), "_first")
    same, other = fingerprints.likeness, F.col("following")
    found = whole.join(changed, "row").join(following.select("row", "following"), "row", "left")
    # narrow until all have met
    found = found.withColumns({c: fingerprints.wide(F.col(c)) for c in ("lanes", "edited", "following")})
    return found.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        fingerprints.as_text(F.col("lanes")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited")).alias("edited_fingerprint"),
        same(F.col("lanes"), F.col("edited")).alias("near_edited"),
        F.when(other.isNull(), 0.0).otherwise(same(F.col("lanes"), other)).alias("near_next"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: every fifth by the checksum of its id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op1_bayesian_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page, from its text, markup, address and host."""
    counts = language.trigram_counts(table(spark, folder, "documents"))
    pages = table(spark, folder, "pages")
    return language.identify_pages(pages, language.log_likelihoods(counts))


def op2_count_vector_rtree(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles link at 0.9."""
    docs = table(spark, folder, "documents")
    return jaccard.jaccard_groups(docs, size=3, percent=90).drop("row", "kept")


def op6_retrieval_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 4,096 ids, filled with lexical neighbours."""
    return packing.pack_documents(table(spark, folder, "documents"))


def op8_convolutional_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document; every fifth by checksum is held out."""
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), ~held_out())
    scored = docs.select("doc_id", toxicity.score(spark, model).alias("score"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op9_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, counted in flat files of the ids of all documents."""
    files = f"{settled_folder(spark)}/tokens-{uuid.uuid4().hex}"
    places = tokenfiles.write_token_files(table(spark, folder, "documents"), files)
    counted = tokenfiles.count_written(places, files, width=2)
    return counted.select("doc_id", "n_tokens", "part", "place")


def loops(n: int, h: int) -> np.ndarray | None:
    """For every tenth checksum, places that from some word on go round a part of the text."""
    g = h // 10
    if h % 10:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words that repeat with a period, in every text; a tenth of them is made to repeat.

    A row without doc_id has no checksum and keeps its text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = table(spark, folder, "documents").select("doc_id", periodic.runs("text", loops, h).alias("f"))
    found = found.select("doc_id", "f.runs", "f.collapsed_sha256")
    # the smallest is the longest, then the first, then that of the smaller period
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(order)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        (-best["length"]).alias("length"),
        best["period"].alias("period"),
        F.floor(-1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n")))), 256).alias("runs_sha256"),
        "collapsed_sha256",
    )


def op12_arrow_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers in every text, their links and how frequent these are."""
    return alignment.alignments(table(spark, folder, "documents"))


def op13_subword_lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probabilities of every text; every fifth by the checksum of its id is held out.

    A row without doc_id has no checksum and is not held out.
    """
    docs = table(spark, folder, "documents")
    mod = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    held = F.coalesce(mod == 1, F.lit(False))
    return lattice.scores(docs, ~held).select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bayesian_language,
        op2_count_vector_rtree,
        op3_byte_bpe,
        op4_maxscore_topk,
        op5_secrets,
        op6_retrieval_packing,
        op7_shuffled_shards,
        op8_convolutional_toxicity,
        op9_separator_scan,
        op10_multiset_fingerprints,
        op11_periodic_runs,
        op12_arrow_alignment,
        op13_subword_lattice,
    )
}
