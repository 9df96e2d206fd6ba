"""A data source that writes texts as files of given names, one for each row.

Spark's own writers name their files themselves, but a report has to lie under its own name. Tasks write each file beside
its place and move it there, so a file is whole or absent and a task that is run again writes the same once more. The
folder's list of names is written when all tasks have ended; a failed write takes away the files of the tasks that had.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tables import bound_batches

#: The file that says that a write has ended, and how many files it made.
DONE = "_written"


@dataclass
class Written(WriterCommitMessage):
    """How many files a task made, and the file beside them that has their names: a driver may not hold all."""

    n: int
    names: str


class Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = fs.FileSystem.from_uri(self.folder)
        names, made = [], set()
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or any(p in ("", ".", "..") for p in name.split("/")):
                raise ValueError(f"no file can be named {name!r}")
            above = f"{root}/{name}".rsplit("/", 1)[0]
            if above not in made:
                system.create_dir(above)
                made.add(above)
            draft = f"{above}/_{hashlib.md5(name.encode()).hexdigest()}"
            with system.open_output_stream(draft) as out:
                out.write((row["content"] or "").encode())
            system.move(draft, f"{root}/{name}")
            names.append(name)
        listing = f"{root}/_names-{uuid.uuid4().hex}"
        system.create_dir(root)
        with system.open_output_stream(listing) as out:
            out.write("".join(json.dumps(n) + "\n" for n in names).encode())
        return Written(len(names), listing)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{DONE}") as out:
            out.write(str(sum(m.n for m in messages if m)).encode())
        for m in messages:
            if m:
                system.delete_file(m.names)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            if m and system.get_file_info(m.names).type == fs.FileType.File:
                with system.open_input_stream(m.names) as f:
                    names = [json.loads(line) for line in f.read().decode().splitlines()]
                for name in names:
                    if system.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                        system.delete_file(f"{root}/{name}")
                system.delete_file(m.names)


class NamedFiles(DataSource):
    """Option path: a folder that driver and executors share, in a file system that pyarrow knows."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Writer(self.options["path"], overwrite)


def write_named(rows: DataFrame, folder: str) -> None:
    """Write rows (name, a path below folder; content). A name that stands twice is an error: which text it would get
    is open. Rows are dealt out to tasks anew, as a table of few row groups would have few tasks make all files."""
    twice = rows.groupBy("name").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"names that stand twice: {sorted(r['name'] for r in twice)}")
    rows.sparkSession.dataSource.register(NamedFiles)
    bound_batches(rows.sparkSession)
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    rows.select("name", "content").repartition(tasks, "name").write.format("named_files").option("path", folder).mode("append").save()
