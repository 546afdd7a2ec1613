"""What the corpus operators share: tables, batches of bounded size, places for files."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteoqc.operators.staging import new_folder, stage_root, staged

__all__ = ["new_folder", "stage_root", "staged", "table", "keyed", "fresh", "slices", "texts", "file_system"]

#: bytes of text that a task works on at a time, however large the Arrow batches are
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(row, doc_id, text) with a key of its own for every row; ``whole`` adds ``doc``, the row as it came.

    The key is ``doc_id`` where that is unique and set, which one count of ids tells. Else the rows
    are numbered in (doc_id, text) order and written once, so that every reader sees the same numbers.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    own = docs.select(*cols, *([F.struct(*[f"`{c}`" for c in docs.columns]).alias("doc")] if whole else []))
    ids = own.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.count_if(F.col("doc_id").isNull()).alias("unset")).first()
    if (ids["most"] or 0) <= 1 and not ids["unset"]:
        return own.select(F.col("doc_id").alias("row"), "*")
    ordered = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return staged(ordered.select(F.monotonically_increasing_id().alias("row"), "*"))


def fresh(name: str, taken: list[str]) -> str:
    """A column name that ``taken`` does not have, whatever its case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, size in enumerate(_sizes(col)):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a worker outlives its tasks


def _sizes(col: pa.Array) -> list[int]:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_pylist()


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def file_system(uri: str):
    """(file system, path in it) of a folder named by URI or plain path."""
    from pyarrow import fs

    if urlparse(uri).scheme:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
