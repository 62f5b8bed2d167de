"""Flat token files without an index, and the sizes of the documents in them.

A flat file is a run of little-endian ids in which every document ends with a separator id.
To find the documents, files are cut into blocks of a fixed number of ids. Each block is
searched for separators with one vector comparison and tells where its first and last one
is, how many there are, and the lengths between them. A prefix scan over the blocks of a
file (running sum of separators, running maximum of the last place) then stitches the
documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factmill.llm.wordids import PATH, word_ids
from factmill.session import settle

SEPARATOR = 49407
BLOCK_IDS = 1 << 20
"""Ids of a block: what a task holds at a time."""


def file_system(uri: str):
    """The file system of a path that Spark uses, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def write_token_files(
    docs: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text: str = "text",
    path: str = PATH,
    separator: int = SEPARATOR,
) -> DataFrame:
    """Write one flat file per task and return what is in them: id, ``part``, ``place``.

    ``part`` is the number in a file's name (``part_file``), ``place`` numbers its documents
    from 0. A null or empty text has no ids and is a separator alone. Each attempt at a task
    writes a file of its own; the returned table, which is settled, has the numbers of the
    attempts that count.
    """
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("part", T.LongType()),
            T.StructField("place", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        part, place = uuid.uuid4().int >> 65, 0
        with system.open_output_stream(f"{root}/{part}.bin") as out:
            for batch in batches:
                for i, j, ids, bounds in coder.column(batch.column(1)):
                    flat = np.full(len(ids) + j - i, separator, coder.type)
                    keep = np.ones(len(flat), bool)
                    keep[bounds[1:] + np.arange(j - i)] = False
                    flat[keep] = ids
                    out.write(flat.astype(flat.dtype.newbyteorder("<")).tobytes())
                n = batch.num_rows
                places = pa.array(np.arange(place, place + n))
                place += n
                parts = pa.array(np.full(n, part))
                yield pa.RecordBatch.from_arrays([batch.column(0), parts, places], schema.names)

    return settle(docs.select(id_column, text).mapInArrow(run, schema), "places")


def part_file(folder: str, part: Column | str = "part") -> Column:
    """The path of a part's file."""
    return F.concat(F.lit(f"{folder}/"), F.col(part).cast("string"), F.lit(".bin"))


def count_written(places: DataFrame, folder: str, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``places`` with ``n_tokens``, counted in the files that were written."""
    files = places.select("part").distinct().select(part_file(folder).alias("file"))
    counted = count_tokens(files, width, block_ids=block_ids).select(
        F.regexp_extract("file", r"([0-9]+)\.bin$", 1).cast("long").alias("part"), "place", "n_tokens"
    )
    # a row per document on either side: neither may be broadcast, however small its file
    return places.hint("merge").join(counted, ["part", "place"])


def file_blocks(files: DataFrame, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks of the files in column ``file``: ``file`` and ``block``, dealt out evenly."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.column(0).to_pylist():
                system, path = file_system(file)
                found.append(-(-system.get_file_info(path).size // (width * block_ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.int64())], ["file", "blocks"]
            )

    counted = files.select("file").distinct().mapInArrow(sizes, "file string, blocks long")
    return (
        counted.where("blocks > 0")
        .select("file", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        .repartition("file", "block")
    )


def scan_blocks(
    blocks: DataFrame, width: int, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """One row per block: ids, separators, place of the first and last one, lengths between."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block in zip(*(c.to_pylist() for c in batch.columns)):
                system, path = file_system(file)
                with system.open_input_file(path) as source:
                    raw = source.read_at(block_ids * width, block * block_ids * width)
                ids = np.frombuffer(raw, kind)
                at = np.flatnonzero(ids == separator)
                some = len(at) > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file]),
                        pa.array([block], pa.int64()),
                        pa.array([len(ids)], pa.int64()),
                        pa.array([len(at)], pa.int64()),
                        pa.array([block * block_ids + int(at[0]) if some else None], pa.int64()),
                        pa.array([block * block_ids + int(at[-1]) if some else None], pa.int64()),
                        pa.array([np.diff(at) - 1], pa.list_(pa.int64())),
                    ],
                    ["file", "block", "ids", "ends", "first", "last", "between"],
                )

    return blocks.select("file", "block").mapInArrow(
        run,
        "file string, block long, ids long, ends long, first long, last long, between array<long>",
    )


def stitched(scanned: DataFrame, block_ids: int = BLOCK_IDS) -> DataFrame:
    """One row per document: ``file``, ``place`` in it, ``n_tokens`` without the separator.

    Ids behind the last separator of a file are one more document. The scan goes over one
    row per block of a file.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy("file").orderBy("block")
    seen = scanned.select(
        "*",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("_place"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("_begin"),
        F.lead("block").over(later).isNull().alias("_final"),
    )
    crossing = F.when(F.col("ends") > 0, F.array(F.col("first") - F.col("_begin") - 1))
    tail = F.col("block") * block_ids + F.col("ids") - F.coalesce("last", "_begin") - 1
    lengths = F.concat(
        F.coalesce(crossing, F.array().cast("array<long>")),
        F.col("between"),
        F.when(F.col("_final") & (tail > 0), F.array(tail)).otherwise(
            F.array().cast("array<long>")
        ),
    )
    return seen.select("file", "_place", F.posexplode(lengths).alias("_i", "n_tokens")).select(
        "file", (F.col("_place") + F.col("_i")).alias("place"), "n_tokens"
    )


def count_tokens(
    files: DataFrame, width: int, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS
) -> DataFrame:
    """Tokens of every document in the flat files named in column ``file``.

    An empty file has no documents; two separators side by side enclose an empty one.
    """
    blocks = file_blocks(files, width, block_ids)
    return stitched(scan_blocks(blocks, width, separator, block_ids), block_ids)
