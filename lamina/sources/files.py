"""A sink of small binary files: rows (name, data) become files in one folder.

Consecutive rows of one name in a partition are one file's parts, in order. A file is written beside
its place and moved there when it is whole, so a task that is run again, or lost, leaves no half
file. Any store that Arrow's file systems open will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyarrow import fs as stores
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


class FileSink(DataSource):
    """``df.write.format("lamina_files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "lamina_files"

    def schema(self) -> str:
        return "name string, data binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, root = stores.FileSystem.from_uri(self.path)
        store.create_dir(f"{root}/_parts")
        name = out = part = None

        def close() -> None:
            if out is not None:
                out.close()
                folder = f"{root}/{name}".rpartition("/")[0]
                store.create_dir(folder)
                store.move(part, f"{root}/{name}")

        for row in iterator:
            if row["name"] != name:
                close()
                name, part = row["name"], f"{root}/_parts/{uuid.uuid4().hex}"
                out = store.open_output_stream(part)
            out.write(bytes(row["data"]))
        close()
        return WriterCommitMessage()


def write_files(rows: DataFrame, path: str) -> None:
    """Writes rows (name, data) as files in the folder ``path``."""
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", "data").write.format("lamina_files").mode("append").save(path)
