"""A stream of the files of a folder tree that hides no name but those that start with a dot.

The Python data source "media_folder" lists the tree itself at each trigger and writes what is new, or has another size or time than
before, to a numbered entry of a log; the offset of the stream is the number of the last entry. Entries are
written once and never changed, so a batch that runs again sees the same files. The log belongs beside the stream's
checkpoint. What the driver holds is the names of the tree, as any listing file stream does; files are read by tasks.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lumaspark.sources.media import _file_system

FILES_PER_TASK = 1_000
_SCHEMA = "name string, size long, last_modified timestamp"


@dataclass
class _Files(InputPartition):
    files: list[tuple[str, int, int]]


class FolderReader(DataSourceStreamReader):
    def __init__(self, path: str, log: str, content: bool):
        self.path, self.log, self.content, self.known, self.last = path.rstrip("/"), log.rstrip("/"), content, {}, 0

    def _entry(self, number: int) -> list[tuple[str, int, int]]:
        fs, top = _file_system(self.log)
        with fs.open_input_stream(f"{top}/{number}.json", compression=None) as f:
            return [tuple(x) for x in json.loads(f.read())]

    def _catch_up(self) -> None:
        """Takes over the entries that an earlier run logged."""
        from pyarrow.fs import FileSelector

        fs, top = _file_system(self.log)
        found = fs.get_file_info(FileSelector(top, allow_not_found=True))
        last = max((int(f.base_name.removesuffix(".json")) for f in found if f.base_name.removesuffix(".json").isdigit()), default=0)
        for number in range(self.last + 1, last + 1):
            self.known.update((name, (size, time)) for name, size, time in self._entry(number))
        self.last = max(self.last, last)

    def initialOffset(self) -> dict:
        return {"entry": 0}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector, FileType

        self._catch_up()
        fs, top = _file_system(self.path)
        fresh = []
        for f in fs.get_file_info(FileSelector(top, recursive=True, allow_not_found=True)):
            name = f.path[len(top):].lstrip("/")
            if f.type == FileType.File and not any(part.startswith(".") for part in name.split("/")):
                now = (f.size or 0, (f.mtime_ns or 0) // 1000)
                if self.known.get(name) != now:
                    fresh.append((name, *now))
        if fresh:
            logs, place = _file_system(self.log)
            logs.create_dir(place, recursive=True)
            part = f"{place}/.{uuid.uuid4().hex}"
            with logs.open_output_stream(part, compression=None) as out:
                out.write(json.dumps(sorted(fresh)).encode())
            logs.move(part, f"{place}/{self.last + 1}.json")
            self._catch_up()
        return {"entry": self.last}

    def partitions(self, start: dict, end: dict) -> list[_Files]:
        files = [f for number in range(start["entry"] + 1, end["entry"] + 1) for f in self._entry(number)]
        return [_Files(files[i:i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files):
        fs, top = _file_system(self.path)
        step = 1 if self.content else FILES_PER_TASK  # the bytes of one file at a time
        for i in range(0, len(partition.files), step):
            some = partition.files[i:i + step]
            columns = [pa.array([f[0] for f in some]), pa.array([f[1] for f in some], pa.int64()), pa.array([f[2] for f in some], pa.timestamp("us", tz="UTC"))]
            if self.content:
                try:
                    with fs.open_input_stream(f"{top}/{some[0][0]}", compression=None) as f:
                        data = f.read()
                except FileNotFoundError:
                    data = None
                columns.append(pa.array([data], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["name", "size", "last_modified", "content"][: len(columns)])


class FolderSource(DataSource):
    """format("media_folder") with the options path, log and content ("true" adds the files' bytes)."""

    @classmethod
    def name(cls):
        return "media_folder"

    def schema(self):
        return _SCHEMA + (", content binary" if self._content() else "")

    def _content(self) -> bool:
        return self.options.get("content", "false") == "true"

    def streamReader(self, schema):
        return FolderReader(self.options["path"], self.options["log"], self._content())
