"""Loading to, and reading from, a relational table over JDBC."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from factmill import fixed_values as fixed
from factmill.operators.quality import missing_columns
from factmill.spec import DEFAULT_SPEC, FactSpec

log = logging.getLogger(__name__)

# what to do with an existing table, and Spark's word for it
MODES = {"replace": "overwrite", "append": "append", "fail": "errorifexists"}


def write_options(
    url: str, table: str, batch: int = fixed.LOAD_BATCH, connections: int = 8, **more: str
) -> dict[str, str]:
    """Writer options. ``connections`` bounds how many tasks insert at a time."""
    options = {
        "url": url,
        "dbtable": table,
        "batchsize": str(batch),
        "numPartitions": str(connections),
    }
    if url.startswith("jdbc:postgresql:"):
        # this driver sends a batch as multi-row inserts only when told so
        options["reWriteBatchedInserts"] = "true"
    return options | more


def load_table(
    df: DataFrame,
    url: str | None,
    table: str,
    mode: str = "replace",
    batch: int = fixed.LOAD_BATCH,
    connections: int = 8,
    spec: FactSpec = DEFAULT_SPEC,
    **more: str,
) -> bool:
    """Load a complete processed table. False, and nothing done, without a URL."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {sorted(MODES)}, not {mode!r}")
    if not url:
        log.warning("no database URL given, load skipped")
        return False
    absent = missing_columns(df, spec.processed_columns)
    if absent:
        raise ValueError(f"missing columns: {absent}")
    options = write_options(url, table, batch, connections, **more)
    df.write.format("jdbc").options(**options).mode(MODES[mode]).save()
    return True


def read_options(
    url: str,
    table: str,
    column: str | None = None,
    low: int | None = None,
    high: int | None = None,
    parts: int = 8,
    fetch: int = fixed.LOAD_BATCH,
    **more: str,
) -> dict[str, str]:
    """Reader options. With a number column and its bounds the table is read in
    disjoint ranges, so no row is missed or read twice; rows outside the bounds
    fall into the first and last range."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch), **more}
    if column is not None:
        if low is None or high is None:
            raise ValueError("a partition column needs both bounds")
        options |= {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(parts),
        }
    return options


def read_table(spark: SparkSession, url: str, table: str, **how) -> DataFrame:
    """The whole table; arguments as for ``read_options``."""
    return spark.read.format("jdbc").options(**read_options(url, table, **how)).load()
