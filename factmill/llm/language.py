"""Language identification by Bayesian fusion of evidence.

The posterior of a language multiplies

* the likelihood of the text: hashed byte trigrams, counted per language over all texts
  with a declared one,
* the likelihood of the language that the markup declares, given the true one: how often
  each is declared is counted with the texts' own posteriors as weights,
* the prior of the page's host: expected counts of languages by grouped aggregation,
  smoothed down the levels all, address suffix, domain, host. A page's own share is taken
  out of its host's counts before they judge it.

Beside the known languages there is ``und``, under which all trigrams are equally likely: it
takes what is no text in any of them.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.llm.words import LOWER, blocks
from factmill.session import settle

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "und"
BUCKETS = 1 << 13
EVIDENCE = 40.0
"""Trigrams that the evidence of a text counts for at most; neighbours are not independent."""
SMOOTHING = 5.0
"""Pages that the prior of the level above is worth."""
_MARKUP = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def trigrams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes within each text, and where each text's begin."""
    low = LOWER[data].astype(np.uint32)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:] if len(low) > 2 else low[:0]
    code = ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)
    within = np.ones(len(code), bool)
    inner = bounds[1:-1]
    for back in (1, 2):
        at = inner - back
        within[at[(at >= 0) & (at < len(code))]] = False
    places = np.flatnonzero(within)
    return code[within], np.searchsorted(places, bounds)


def trigram_counts(docs: DataFrame, languages: Sequence[str] = LANGUAGES) -> np.ndarray:
    """Counts by language and trigram over all texts whose column ``lang`` names a language.

    Counted in the tasks and summed by key; languages * BUCKETS numbers reach the driver.
    """
    names = list(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names) + 1) * BUCKETS, np.int64)
        for batch in batches:
            spoken = np.array([names.index(x) if x in names else len(names) for x in batch.column(1).to_pylist()])
            for i, j, data, bounds in blocks(batch.column(0)):
                code, at = trigrams(data, bounds)
                own = np.repeat(spoken[i:j], np.diff(at))
                total += np.bincount(own * BUCKETS + code, minlength=len(total))
        total = total[: len(names) * BUCKETS]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    rows = (
        docs.select("text", "lang")
        .mapInArrow(run, "key long, n long")
        .groupBy("key")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    out = np.zeros(len(names) * BUCKETS)
    for key, n in rows:
        out[key] = n
    return out.reshape(len(names), BUCKETS)


def log_likelihoods(counts: np.ndarray) -> np.ndarray:
    """By trigram: log probabilities for each language, and for ``und`` in the last column."""
    smooth = counts + 0.5
    known = np.log(smooth / smooth.sum(1, keepdims=True))
    return np.vstack([known, np.full(BUCKETS, -math.log(BUCKETS))]).T.astype(np.float32)


def text_evidence(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Log likelihoods of texts: their mean over trigrams, times at most ``EVIDENCE``."""
    out = np.zeros((len(column), table.shape[1]))
    for i, j, data, bounds in blocks(column):
        code, at = trigrams(data, bounds)
        many = np.diff(at)
        full = np.flatnonzero(many)
        if not len(full):
            continue
        for k in range(table.shape[1]):
            sums = np.add.reduceat(table[code, k].astype(float), at[full])
            out[i + full, k] = sums / many[full] * np.minimum(many[full], EVIDENCE)
    return out


def likelihoods(table: np.ndarray, text: Column | str) -> Column:
    """The log likelihoods of a text, an array; a text without trigrams has all equal."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        values = text_evidence(texts, table)
        at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * table.shape[1])
        return pa.ListArray.from_arrays(at, pa.array(values.ravel()))

    return run(text)


def page_likelihoods(table: np.ndarray, page: Column | str) -> Column:
    """The log likelihoods of a page's visible text."""

    @F.arrow_udf("array<double>")
    def run(pages: pa.Array) -> pa.Array:
        texts = [html.unescape(_MARKUP.sub(" ", p)) if p else "" for p in pages.to_pylist()]
        values = text_evidence(pa.array(texts, pa.large_string()), table)
        at = pa.array(np.arange(len(values) + 1, dtype=np.int32) * table.shape[1])
        return pa.ListArray.from_arrays(at, pa.array(values.ravel()))

    return run(page)


def declared_language(page: Column | str) -> Column:
    """The language that the markup declares, lower-cased; empty if it declares none."""
    found = F.regexp_extract(page, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)
    return F.lower(F.coalesce(found, F.lit("")))


def address(url: Column | str) -> tuple[Column, Column, Column]:
    """Host, domain (its last two labels) and suffix (its last one); empty without a host."""
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def _normal(logs: Column) -> Column:
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raised, lambda x: x / total)


def _sums(column: str, k: int) -> list[Column]:
    return [F.sum(F.col(column)[i]).alias(f"_s{i}") for i in range(k)]


def _array(k: int) -> Column:
    return F.array(*[f"_s{i}" for i in range(k)])


def posteriors(evidence: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """Add ``language``, ``confidence`` and ``text_language`` to a settled table of evidence.

    It has ``_log`` (log likelihoods of the text), ``declared``, ``host``, ``domain`` and
    ``suffix``; nulls in these count as empty. Hot hosts and declarations meet as sums, and
    joins with them read tables on both sides, so that a hot one can be split.
    """
    names = [*languages, OTHER]
    k = len(names)
    keys = {c: F.coalesce(F.col(c), F.lit("")) for c in ("declared", "host", "domain", "suffix")}
    known = evidence.withColumns(keys).withColumn("_own", _normal(F.col("_log")))
    skim = known.select("declared", "host", "domain", "suffix", "_own")
    hosts = skim.groupBy("suffix", "domain", "host").agg(F.count("*").alias("_n"), *_sums("_own", k))
    hosts = settle(hosts.select("suffix", "domain", "host", "_n", _array(k).alias("_c")), "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("_n").alias("_n"), *_sums("_c", k))
    domains = settle(domains.select("suffix", "domain", "_n", _array(k).alias("_c")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("_n").alias("_n"), *_sums("_c", k))
    suffixes = settle(suffixes.select("suffix", "_n", _array(k).alias("_c")), "suffixes")
    whole = suffixes.agg(F.sum("_n").alias("_n"), *_sums("_c", k)).first()
    n = whole["_n"] or 0
    prior = F.array(*[F.lit(((whole[f"_s{i}"] or 0) + 1) / (n + k)) for i in range(k)])

    def smoothed(counts: Column, many: Column, above: Column) -> Column:
        return F.zip_with(counts, above, lambda c, p: (F.greatest(c, F.lit(0.0)) + SMOOTHING * p) / (many + SMOOTHING))

    by_suffix = suffixes.select("suffix", smoothed(F.col("_c"), F.col("_n"), prior).alias("_p"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", smoothed(F.col("_c"), F.col("_n"), F.col("_p")).alias("_p"))
    by_host = settle(
        hosts.join(by_domain, ["suffix", "domain"]).select("suffix", "domain", "host", "_n", "_c", "_p"), "by_host"
    )
    said = skim.groupBy("declared").agg(*_sums("_own", k))
    said = settle(said.select("declared", _array(k).alias("_d")), "declared")
    sizes = said.agg(F.count("*").alias("_m"), *_sums("_d", k)).first()
    kinds = sizes["_m"] or 1
    totals = F.array(*[F.lit(float(sizes[f"_s{i}"] or 0)) for i in range(k)])
    spoken = said.select(
        "declared",
        F.zip_with("_d", totals, lambda d, t: F.log((d + 1.0 / kinds) / (t + 1.0))).alias("_said"),
    )
    joined = known.join(by_host, ["suffix", "domain", "host"]).join(spoken, "declared")
    rest = F.zip_with("_c", "_own", lambda c, o: c - o)
    place = F.zip_with(smoothed(rest, F.col("_n") - 1, F.col("_p")), F.col("_said"), lambda p, s: F.log(p) + s)
    fused = _normal(F.zip_with("_log", place, lambda a, b: a + b))
    chosen = F.array(*map(F.lit, names))

    def best(values: Column) -> Column:
        return F.element_at(chosen, F.array_position(values, F.array_max(values)).cast("int"))

    return joined.withColumn("_post", fused).select(
        *evidence.columns,
        best(F.col("_post")).alias("language"),
        F.array_max("_post").alias("confidence"),
        best(F.col("_own")).alias("text_language"),
    )


def identify_pages(pages: DataFrame, table: np.ndarray, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """One row per page (``page_id``, ``url``, ``html``): language, confidence and evidence.

    A page without html or text is judged by its host and declaration, one without address
    by the rest; with neither, by the prior of all pages. Repeated rows are pages of their
    own; ties go to the first language by name, ``und`` last. An empty table has no rows.
    """
    host, domain, suffix = address("url")
    evidence = pages.select(
        "page_id",
        host.alias("host"),
        domain.alias("domain"),
        suffix.alias("suffix"),
        declared_language("html").alias("declared"),
        page_likelihoods(table, "html").alias("_log"),
    )
    return posteriors(settle(evidence, "evidence"), languages).drop("_log")


def known_language(docs: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is one of ``languages``.

    The declared language is ``lang``, the host ``source``; there is no address, hence
    no suffix. Rows found to be ``und`` go; rows without a trigram, null texts
    included, say nothing and stay.
    """
    table = log_likelihoods(trigram_counts(docs, languages))
    evidence = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"),
        F.lower("lang").alias("declared"),
        F.col("source").alias("host"),
        F.col("source").alias("domain"),
        F.lit("").alias("suffix"),
        likelihoods(table, "text").alias("_log"),
    )
    judged = posteriors(settle(evidence, "evidence"), languages)
    blank = F.array_min("_log") == 0
    return judged.where((F.col("language") != OTHER) | blank).select("_row.*")
