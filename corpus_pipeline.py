"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of
``docs``. An empty table stays empty; null and empty texts pass every filter and end as
their end id alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import jaccard, language, packing, secrets, toxicity
from factmill.llm.queries import held_out, table
from factmill.llm.rows import numbered
from factmill.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier, trained on the given labels, takes for toxic."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, ~held_out())
    return docs.where(toxicity.score(spark, model) < 0.5)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are no text in any of the known languages; keep those without text."""
    return language.known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest doc_id of each group that five-word shingles link at 0.8."""
    rows = numbered(docs, whole(docs))
    texts = rows.select("row", "document.doc_id", "document.text")
    groups = jaccard.numbered_groups(texts, size=5, percent=80)
    kept = settle(groups.where("kept").select("row"), "kept")
    return rows.join(kept, "row", "left_semi").select("document.*")


def whole(docs: DataFrame) -> Column:
    """A row as one column, so that no name can clash with its columns."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("document")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind of a secret in its place; ``n_chars``, if there, follows where a text changes."""
    fresh = docs.select(whole(docs), secrets.redact("text").alias("text"))
    changed = ~F.col("text").eqNullSafe(F.col("document.text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed, size).otherwise(F.col("document.n_chars"))
    return fresh.select(*[new.get(c, F.col(f"document.`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4,096 ids filled with lexical neighbours, a row per piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

# models, merges and sequences are not expressible in SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
