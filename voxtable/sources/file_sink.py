"""A sink that writes one file for each row, under the row's own name.

    rows.write.format("one_file_each").option("path", folder).mode("append").save()

Rows are (name string, content string or binary); text is UTF-8. A task writes into a folder of its own under _temporary; when all have
ended, the driver moves what the committed tasks wrote to its place, and the rest is removed. So a task that is tried again leaves
one file for each name, and a job that fails leaves none. Names may have folders; a file that is there is replaced.
"""

from __future__ import annotations

import posixpath
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that the driver moves at a time.
MOVERS = 32
UNDER_WAY = "_temporary"


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task's files."""

    folder: str
    count: int


class OneFileEach(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file_each"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("one_file_each writes rows of name and content")
        return OneFileEachWriter(self.options["path"].rstrip("/"), overwrite)


class OneFileEachWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def under_way(self) -> str:
        return f"{UNDER_WAY}/{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        store, top = fs.FileSystem.from_uri(self.path)
        folder, count, made = f"{self.under_way()}/{uuid.uuid4().hex}", 0, set()
        for row in iterator:
            name = posixpath.normpath(row["name"] or "")
            if name in (".", "..") or name.startswith(("/", "../")):
                raise ValueError(f"no name of a file: {row['name']!r}")
            at = f"{top}/{folder}/{name}"
            if (own := posixpath.dirname(at)) not in made:
                store.create_dir(own)
                made.add(own)
            content = row["content"]
            with store.open_output_stream(at) as out:
                out.write(b"" if content is None else content.encode() if isinstance(content, str) else bytes(content))
            count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.path)
        store.create_dir(top)
        if self.overwrite:
            for found in store.get_file_info(fs.FileSelector(top)):
                if found.base_name != UNDER_WAY:
                    (store.delete_dir if found.type == fs.FileType.Directory else store.delete_file)(found.path)

        def move(pair: tuple[str, str]) -> None:
            store.move(*pair)

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in messages:
                if message is None or not message.count:
                    continue
                own = f"{top}/{message.folder}"
                pairs = [(f.path, f.path.replace(own, top, 1)) for f in store.get_file_info(fs.FileSelector(own, recursive=True)) if f.type == fs.FileType.File]
                for folder in {posixpath.dirname(to) for _, to in pairs}:
                    store.create_dir(folder)
                list(pool.map(move, pairs))
        self.tidy(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self.tidy(*fs.FileSystem.from_uri(self.path))

    def tidy(self, store: fs.FileSystem, top: str) -> None:
        """Removes this run's folder, and the one above when no other run is under way."""
        for folder in (f"{top}/{self.under_way()}", f"{top}/{UNDER_WAY}"):
            if store.get_file_info(folder).type == fs.FileType.Directory and (folder.endswith(self.run) or not store.get_file_info(fs.FileSelector(folder))):
                store.delete_dir(folder)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OneFileEach)


# executors get what is defined here by value, so they need not have the repository on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
