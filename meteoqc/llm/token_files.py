"""Token files: flat unsigned ids of all documents in ``doc_id`` order, with 64-bit offsets.

Every task of a range-partitioned, sorted table writes one shard of flat files:

=================  =========================================================================
``<shard>.ids``    ids one after the other, unsigned 16 or 32 bit (as the vocabulary needs), little-endian
``<shard>.off``    signed 64-bit offsets into the shard's ids: first id of every document, then the end
``<shard>.doc``    signed 64-bit ``doc_id`` of every document (0 where it is null)
``<shard>.nul``    signed 64-bit numbers of the documents whose ``doc_id`` is null
=================  =========================================================================

A small manifest (one row for each shard) holds the shards of the attempts that Spark accepted, so
a repeated or lost task leaves at most an unnamed file. Bases of shards are prefix sums over it.

Null text is empty text and yields the end id alone; rows with equal ``doc_id`` are kept, ordered
by text; null ``doc_id`` comes first; an empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meteoqc.llm.common import file_system, new_folder, slices, staged, texts
from meteoqc.llm.pieces import encoder

MANIFEST = "shard int, name string, width int, n_docs long, n_ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
READ_DOCS = 4096


def _writer(folder: str, tokenizer: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        shard = TaskContext.get().partitionId()
        fs, root = file_system(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        fs.create_dir(root, recursive=True)
        n_docs = n_ids = 0
        with (fs.open_output_stream(f"{root}/{name}.ids") as ids, fs.open_output_stream(f"{root}/{name}.off") as off,
              fs.open_output_stream(f"{root}/{name}.doc") as doc, fs.open_output_stream(f"{root}/{name}.nul") as nul):
            off.write(np.zeros(1, "<i8").tobytes())
            for part in slices(batches, "text"):
                coded = [x + end for x in enc.encode(texts(part))]
                ends = n_ids + np.cumsum([len(x) // enc.dtype.itemsize for x in coded])
                keys = part.column(part.schema.get_field_index("doc_id"))
                ids.write(b"".join(coded))
                off.write(ends.astype("<i8").tobytes())
                doc.write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nul.write((n_docs + np.flatnonzero(keys.is_null().to_numpy(zero_copy_only=False))).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + len(coded), int(ends[-1])
        if n_docs:
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "name": [name], "width": pa.array([enc.dtype.itemsize], pa.int32()),
                "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards below ``folder``; returns the written manifest."""
    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return staged(ordered.mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST))


def open_flat(folder: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where the folder is mounted, else read."""
    fs, root = file_system(folder)
    path = f"{root}/{name}"
    if fs.type_name == "local":
        size = fs.get_file_info(path).size
        return np.memmap(path, dtype, "r") if size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def read(batches):
        for row in (r for b in batches for r in b.to_pylist()):
            ids = open_flat(folder, f"{row['name']}.ids", f"<u{row['width']}")
            off = open_flat(folder, f"{row['name']}.off", "<i8")
            doc = open_flat(folder, f"{row['name']}.doc", "<i8")
            unset = np.zeros(len(doc), bool)
            unset[open_flat(folder, f"{row['name']}.nul", "<i8")] = True
            for a in range(0, len(doc), READ_DOCS):
                b = min(a + READ_DOCS, len(doc))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc[a:b], pa.int64(), mask=unset[a:b]), pa.array(row["base"] + off[a:b]), pa.array(np.diff(off[a:b + 1])),
                    pa.array([zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(off[a:b], off[a + 1:b + 1])], pa.int64()),
                    pa.array(np.full(b - a, row["shard"], "<i4"))], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    return read


def with_bases(manifest: DataFrame) -> DataFrame:
    """Adds ``base``, the ids of all shards before; one row for each task that wrote."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document of the files, in tasks of one shard each."""
    return with_bases(manifest).repartition(max(1, manifest.count())).mapInArrow(_reader(folder), ROWS)


def op1_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from meteoqc.llm.common import table

    folder = new_folder(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest, folder)
