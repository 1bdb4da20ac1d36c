"""A sink that writes one file for each record, under the record's name.

A task writes its records into a folder of its own under `_staged`, and only when it has written them all moves them to their names; so a task that
fails leaves nothing, every file under a name is whole, and a task that runs twice writes the same files. The driver gets a count from each task, no names,
and clears what the job staged when it commits or aborts; what a killed task stages after that stays under `_staged`, which Spark's readers pass over. In the mode `append` names that exist stay as they are, so that a run that is
repeated adds only what is lacking; `overwrite` replaces them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "record_files"
#: Files whose texts a reading task holds at once.
FILES = 64
STAGED = "_staged"


def _store(path: str) -> tuple:
    """The file system of a path, local or a URI of a store that Arrow reaches, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


@dataclass
class Written(WriterCommitMessage):
    files: int
    skipped: int


class RecordFilesWriter(DataSourceWriter):
    def __init__(self, path: str, run: str, overwrite: bool):
        self.path, self.run, self.overwrite = path.rstrip("/"), run, overwrite

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        store, root = _store(self.path)
        own = f"{root}/{STAGED}/{self.run}/{uuid.uuid4().hex}"
        store.create_dir(own)
        names, skipped = [], 0
        try:
            for name, value in iterator:
                if not self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    skipped += 1
                    continue
                with store.open_output_stream(f"{own}/{name}") as out:
                    out.write(value.encode())
                names.append(name)
            for name in names:
                if self.overwrite and store.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                    store.delete_file(f"{root}/{name}")  # not every store moves over a file
                store.move(f"{own}/{name}", f"{root}/{name}")
        finally:
            store.delete_dir(own)
        return Written(len(names), skipped)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow import fs

        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{STAGED}/{self.run}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGED}/{self.run}")
        if store.get_file_info(f"{root}/{STAGED}").type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(f"{root}/{STAGED}")):
            store.delete_dir(f"{root}/{STAGED}")


class RecordFiles(DataSource):
    """Rows of (name, value): a file's name in the folder `path`, and its text."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, value string"

    def writer(self, schema: StructType, overwrite: bool) -> RecordFilesWriter:
        return RecordFilesWriter(self.options["path"], uuid.uuid4().hex, overwrite)


def write(named: DataFrame, path: str, mode: str = "append") -> None:
    """named(name, value) -> a file each. Rows with one name make one file, of the greatest value; rows without a name none; a null value an
    empty file. Names are file names, without a slash."""
    session: SparkSession = named.sparkSession
    session.dataSource.register(RecordFiles)
    sound = named.where((F.col("name") != "") & ~F.col("name").contains("/"))
    once = sound.groupBy("name").agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    once.write.format(FORMAT).mode(mode).option("path", path).save()


def read(names: DataFrame, path: str) -> DataFrame:
    """names(name) -> (name, value) of the named files that are there, each opened by a task: the driver lists no folder and gets no names."""

    def texts(batches: Iterator) -> Iterator:
        import pyarrow as pa

        store, root = _store(path.rstrip("/"))
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                found = []
                for name in batch.column(0).slice(at, FILES).to_pylist():
                    try:
                        with store.open_input_file(f"{root}/{name}") as file:
                            found.append((name, file.read()))
                    except FileNotFoundError:
                        continue
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary()).cast(pa.string())], names=["name", "value"])

    return names.select("name").where("name is not null").distinct().mapInArrow(texts, "name string, value string")
