"""Provider payload files as a data source of their own, for batch and streaming reads.

    spark.dataSource.register(PayloadFiles)
    spark.read.format("payload_files").load(folder)
    spark.readStream.format("payload_files").load(folder)

A file is a partition, a line of it a payload. The offset of a stream is the name of the last file it
has read, so senders name their files in order; a stream that starts again goes on behind it.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def file_system(uri: str):
    """(file system, path in it) of a folder named by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def payload_files(folder: str) -> list[str]:
    """Names of the files below ``folder`` in order, without those that begin with a dot or underscore."""
    from pyarrow import fs

    system, path = file_system(folder)
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and not f.base_name.startswith((".", "_")))


class PayloadFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


def read_file(folder: str, path: str) -> Iterator[tuple[str, int, str]]:
    import io

    system, _ = file_system(folder)
    with system.open_input_stream(path) as stream:
        for n, line in enumerate(io.TextIOWrapper(stream, encoding="utf-8")):
            if line.strip():
                yield path, n, line.rstrip("\n")


class PayloadReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [PayloadFile(p) for p in payload_files(self.folder)]

    def read(self, partition: PayloadFile) -> Iterator[tuple[str, int, str]]:
        return read_file(self.folder, partition.path)


class PayloadStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"last": ""}

    def latestOffset(self) -> dict:
        return {"last": (payload_files(self.folder) or [""])[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [PayloadFile(p) for p in payload_files(self.folder) if start["last"] < p <= end["last"]]

    def read(self, partition: PayloadFile) -> Iterator[tuple[str, int, str]]:
        return read_file(self.folder, partition.path)

    def commit(self, end: dict) -> None:
        pass


class PayloadFiles(DataSource):
    """Source ``payload_files``: payload_file, line and payload."""

    @classmethod
    def name(cls) -> str:
        return "payload_files"

    def schema(self) -> str:
        return "payload_file string, line int, payload string"

    def reader(self, schema) -> PayloadReader:
        return PayloadReader(self.options["path"])

    def streamReader(self, schema) -> PayloadStream:
        return PayloadStream(self.options["path"])
