"""Order-independent fingerprints: sums of wide vectors hashed from paragraphs.

Spark functions only. A text is a multiset of paragraphs (its lines). Each paragraph is
hashed to a vector of ``LANES`` numbers, and a text's fingerprint is the sum of its
paragraphs' vectors, lane by lane, modulo 2 ** 32. So

* the order of paragraphs does not matter, and texts of equal paragraphs are equal in it,
* a paragraph is put in or taken out by adding or subtracting its vector.

The first ``EXACT`` lanes are pseudo-random numbers drawn from the whole paragraph: any
other multiset gives other sums, but for a chance of 2 ** -64 a pair. The remaining
``SIGNS`` lanes add up signs hashed from the runs of the paragraph: their cosine estimates
what share of runs two texts have in common. A run is four short words, or as many pieces of
four characters where a word is longer, counted from the beginning of the paragraph, whatever its
script and punctuation. Paragraphs of up to ``SHORT`` characters are cut into pieces of three,
as they have too few words to be alike in some.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, SIGNS = 16, 64
LANES = EXACT + SIGNS
MODULUS = 1 << 32
PARAGRAPH, RUN = "\n", r"(?:\S{1,4}\s*){1,4}"
SHORT, PIECE = 48, r"(?s).{1,3}"


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MODULUS - 1))


def fingerprints(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """One row per value of ``keys``: the keys and ``lanes``, an array of ``LANES`` longs.

    Rows that share their keys are one text in parts: their paragraphs add up. A null or
    empty text is one empty paragraph. Every text counts whole; the paragraphs of one text
    meet only as partial sums, however many they are.
    """
    paragraphs = F.split(F.coalesce(F.col(text), F.lit("")), PARAGRAPH, -1)
    parts = F.transform(
        paragraphs,
        lambda p: F.struct(
            F.xxhash64(p, F.lit(0)).alias("a"),
            F.xxhash64(p, F.lit(1)).alias("b"),
            F.transform(
                F.when(F.char_length(p) <= SHORT, F.regexp_extract_all(p, F.lit(PIECE), F.lit(0))).otherwise(
                    F.regexp_extract_all(p, F.lit(RUN), F.lit(0))
                ),
                lambda c: F.xxhash64(F.rtrim(c)),
            ).alias("c"),
        ),
    )
    rows = (
        df.select(*keys, F.explode(parts).alias("_p"))
        .select(*keys, "_p.a", "_p.b", F.posexplode_outer("_p.c").alias("_i", "_h"))
    )
    first = F.coalesce("_i", F.lit(0)) == 0
    exact = [
        F.sum(F.when(first, _low(F.xxhash64("a", "b", F.lit(k))))) for k in range(EXACT)
    ]
    signs = [
        F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(1)) * 2 - 1) for k in range(SIGNS)
    ]
    summed = rows.groupBy(*keys).agg(
        *[_low(F.coalesce(lane, F.lit(0))).alias(f"_{k}") for k, lane in enumerate([*exact, *signs])]
    )
    return summed.select(*keys, F.array(*[f"_{k}" for k in range(LANES)]).alias("lanes"))


def narrow(lanes: Column) -> Column:
    """The lanes as integers of 32 bits, which take half the room; ``wide`` undoes it."""
    return F.transform(
        lanes, lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("int")
    )


def wide(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: _low(x.cast("long")))


def added(a: Column, b: Column) -> Column:
    """The fingerprint of the paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: _low(x + y))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` once the paragraphs of ``b`` are taken out."""
    return F.zip_with(a, b, lambda x, y: _low(x - y))


def as_text(lanes: Column) -> Column:
    """Eight hexadecimal digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """From 0 to 1: the cosine of the sign lanes, 1 for equal fingerprints."""

    def signed(lanes: Column) -> Column:
        return F.transform(
            F.slice(lanes, EXACT + 1, SIGNS),
            lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x).cast("double"),
        )

    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(signed(x), signed(y), lambda u, v: u * v)
        return F.aggregate(products, F.lit(0.0), lambda s, t: s + t)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.when(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / size)))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(cosine, F.lit(0.0)))


def neighbours(ids: DataFrame, name: str) -> DataFrame:
    """Each distinct id in ``name`` with ``_next`` and ``_previous``, round the end.

    Ids are ordered by range, and neighbours within a range come from a window; the ends
    of the ranges, one row each, meet in a second one. Null ids are left out.
    """
    from pyspark.sql import Window

    from factmill.session import settle

    ranged = settle(
        ids.where(F.col(name).isNotNull())
        .repartitionByRange(name)
        .withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    inside = Window.partitionBy("_range").orderBy(name)
    ends = Window.orderBy("_range")
    edges = ranged.groupBy("_range").agg(F.min(name).alias("_low"), F.max(name).alias("_high"))
    whole = ranged.agg(F.min(name).alias("_least"), F.max(name).alias("_most"))
    edges = settle(
        edges.select(
            F.col("_range"),
            F.lead("_low").over(ends).alias("_after"),
            F.lag("_high").over(ends).alias("_before"),
        ),
        "edges",
    )
    least, most = whole.first() or (None, None)
    return (
        ranged.withColumns(
            {"_next": F.lead(name).over(inside), "_previous": F.lag(name).over(inside)}
        )
        .join(edges, "_range")
        .withColumns(
            {
                "_next": F.coalesce("_next", "_after", F.lit(least)),
                "_previous": F.coalesce("_previous", "_before", F.lit(most)),
            }
        )
        .drop("_range", "_after", "_before")
    )
