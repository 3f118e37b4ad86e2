"""A sink for files in formats of other tools: rows in order become the bytes of named files, committed as a whole.

Every task writes the bytes of its rows to parts of its own, in a hidden folder beside the files. When all tasks are done the
driver puts the parts of the attempts that succeeded together, in order of the tasks, copying bytes and no rows, and only then
the files have their names; a task that is killed or run again leaves nothing. Tasks that still write when the driver is done or
gives up see by a mark in that folder that it is closed. Folders may lie in any of pyarrow's file systems.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .bam import file_system

#: Bytes that are copied at a time.
COPY = 1 << 20


@dataclass
class Written(WriterCommitMessage):
    """(file, part) of a task, in order, and the task's number."""

    task: int
    parts: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.heads = options["path"], json.loads(options.get("heads", "{}"))
        self.hidden = f"_parts-{uuid.uuid4().hex}"

    def _place(self, name: str) -> tuple[fs.FileSystem, str]:
        system, inner = file_system(self.folder)
        return system, f"{inner.rstrip('/')}/{name}"

    def begin(self) -> None:
        """The folder of the parts, open. Tasks don't make it, so that none makes it again after its end."""
        system, mark = self._place(f"{self.hidden}/open")
        system.create_dir(mark.rsplit("/", 1)[0])
        system.open_output_stream(mark).close()

    def _is_open(self) -> bool:
        system, mark = self._place(f"{self.hidden}/open")
        return system.get_file_info(mark).type == fs.FileType.File

    def write(self, iterator) -> Written:
        """Rows (file, data): consecutive rows of a file are one part."""
        context = TaskContext.get()
        parts, now, out = [], None, None
        try:
            for batch in iterator:
                for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if file != now:
                        if out is not None:
                            out.close()
                        name = f"{self.hidden}/{context.partitionId():06d}-{context.taskAttemptId()}-{len(parts)}"
                        system, inner = self._place(name)
                        if not self._is_open():
                            raise OSError(f"{self.hidden} is closed")
                        now, out = file, system.open_output_stream(inner)
                        parts.append((file, name))
                    out.write(data)
        finally:
            if out is not None:
                out.close()
            if not self._is_open():  # since the last part was opened, which may have made the folder again
                self._clear()
        return Written(context.partitionId(), parts)

    def commit(self, messages: list[Written | None]) -> None:
        files: dict[str, list[str]] = {f: [] for f in self.heads}
        for message in sorted((m for m in messages if m is not None), key=lambda m: m.task):
            for file, part in message.parts:
                files.setdefault(file, []).append(part)
        system, folder = self._place("")
        system.create_dir(folder)
        for file, parts in files.items():
            whole = self._place(f"{self.hidden}/{file}")[1]
            system.create_dir(whole.rsplit("/", 1)[0])
            with system.open_output_stream(whole) as out:
                out.write(self.heads.get(file, "").encode())
                for part in parts:
                    with system.open_input_stream(self._place(part)[1]) as data:
                        while piece := data.read(COPY):
                            out.write(piece)
            target = self._place(file)[1]
            if system.get_file_info(target).type == fs.FileType.File:
                system.delete_file(target)
            system.move(whole, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, hidden = self._place(self.hidden)
        for tries in range(10):
            if system.get_file_info(hidden).type != fs.FileType.Directory:
                break
            try:
                if self._is_open():
                    system.delete_file(f"{hidden}/open")
                system.delete_dir(hidden)
            except OSError:  # a part came or went meanwhile
                if tries == 9:
                    raise
                time.sleep(0.1)


class FilesSource(DataSource):
    """df.write.format('ordered_files'): option path, the folder; heads, what files begin with (JSON), which are made in any case."""

    @classmethod
    def name(cls) -> str:
        return "ordered_files"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        out = FilesWriter(self.options)
        out.begin()
        return out


def write_files(rows: DataFrame, folder: str, heads: dict[str, str] | None = None) -> None:
    """rows (file string, data binary) whose partitions are in order, as files in a folder; a file that is there is replaced."""
    rows.sparkSession.dataSource.register(FilesSource)
    out = rows.select(F.col("file").cast("string"), F.col("data").cast("binary"))
    out.write.format("ordered_files").mode("append").option("path", folder).option("heads", json.dumps(heads or {})).save()


def put(path: str, text: str) -> None:
    """A small text as a file in any of pyarrow's file systems."""
    system, inner = file_system(path)
    if "/" in inner.strip("/"):
        system.create_dir(inner.rsplit("/", 1)[0])
    with system.open_output_stream(inner) as out:
        out.write(text.encode())
