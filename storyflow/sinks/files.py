"""A Spark data source that writes rows as files, each whole or not at all.

Rows are (name, data, changed). A task writes a file beside its place, under the
run's own hidden folder, and then moves it there, so a failed task or a lost
executor leaves no partial file. A commit writes the run's counts and drops the
folder; an abort drops the folder. Whole files of a failed run stay, and the next
run passes over them if they are newer than what they hold. A store must let files
be renamed; any that pyarrow reaches works (local and shared folders, HDFS, S3).
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "whole_files"


@dataclass
class Written(WriterCommitMessage):
    files: int = 0
    bytes: int = 0
    kept: int = 0


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def outdated(modified: datetime.datetime, changed: datetime.datetime | None) -> bool:
    """Whether a file of that time is older than what it should hold; a date without a time counts by days."""
    if changed is None:
        return True
    if changed.time() == datetime.time():
        return modified.date() <= changed.date()
    return modified <= changed


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, force: bool):
        self.path, self.force, self.run = path.rstrip("/"), force, uuid.uuid4().hex

    def _hidden(self, root: str) -> str:
        return f"{root}/_writing-{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyarrow import fs

        store, root = _store(self.path)
        done, own = Written(), f"{self._hidden(root)}/{uuid.uuid4().hex}"
        for batch in iterator:
            for name, data, changed in zip(*(batch.column(c).to_pylist() for c in ("name", "data", "changed"))):
                if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                    raise ValueError(f"not a file name below the folder: {name!r}")
                target = f"{root}/{name}"
                found = store.get_file_info(target)
                if changed is not None and changed.tzinfo is not None:
                    changed = changed.astimezone(datetime.timezone.utc).replace(tzinfo=None)
                if found.type != fs.FileType.NotFound and not self.force and not outdated(found.mtime.astimezone(datetime.timezone.utc).replace(tzinfo=None), changed):
                    done.kept += 1
                    continue
                store.create_dir(own, recursive=True)
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{own}/file") as out:
                    out.write(data or b"")
                store.move(f"{own}/file", target)
                done.files += 1
                done.bytes += len(data or b"")
        return done

    def _drop(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(self._hidden(root)).type != fs.FileType.NotFound:
            store.delete_dir(self._hidden(root))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        total = {k: sum(getattr(m, k) for m in messages if m) for k in ("files", "bytes", "kept")}
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/_written.json") as out:
            out.write(json.dumps(total).encode())
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.name for f in schema.fields] != ["name", "data", "changed"]:
            raise ValueError("rows must be (name, data, changed)")
        return FileWriter(self.options["path"], self.options.get("force", "false").lower() == "true")


def save(files: DataFrame, path: str, force: bool = False) -> dict:
    """Write (name string, data binary, changed timestamp or null) below a folder; returns how many files and bytes, and how many were kept.

    A file that is newer than ``changed`` is kept unless ``force``. Names are
    unique; of equal ones any may be what stays.
    """
    spark = files.sparkSession
    spark.dataSource.register(WholeFiles)
    rows = files.selectExpr("cast(name as string) as name", "cast(data as binary) as data", "cast(changed as timestamp) as changed")
    rows.write.format(NAME).option("path", path).option("force", str(force)).mode("append").save()
    store, root = _store(path.rstrip("/"))
    with store.open_input_stream(f"{root}/_written.json") as told:
        return json.loads(told.read())
