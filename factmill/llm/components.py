"""Connected components of a table of links, by passing on the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factmill.session import settle


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for all nodes of links ``a``, ``b``.

    Each round takes the smallest label among a node and its neighbours, and then the label
    of that label, so that long chains shorten by half. Tables are settled between rounds;
    a node of very many links meets them as partial minima, and in joins its rows may be
    split because both sides are read from tables. Links to itself are allowed.
    """
    both = links.select("a", "b").union(links.select("b", "a")).distinct()
    both = settle(both, "links")
    labels = settle(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
            "node", F.least("node", "m").alias("component")
        ),
        "labels",
    )
    before = None
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before = total
        known = labels.select(F.col("node").alias("b"), "component")
        around = both.join(known, "b").groupBy("a").agg(F.min("component").alias("m"))
        around = around.select(F.col("a").alias("node"), "m")
        nearer = settle(
            labels.join(around, "node").select("node", F.least("component", "m").alias("component")),
            "nearer",
        )
        jump = nearer.select(F.col("node").alias("component"), F.col("component").alias("_next"))
        labels = settle(
            nearer.join(jump, "component").select("node", F.col("_next").alias("component")), "labels"
        )
