"""Arrow stream files, read by record batch.

A stream is a row of messages: the schema, dictionaries, record batches. Each begins with the size of its header, and the header tells the size of its body, so the
messages' places are found by reading headers only; files are walked through by the tasks of a first job. Each record batch, or some small ones
together, is then a partition of the scan: a task reads the schema, the dictionaries before it and its own batches, whatever the file's size."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .record_files import _store

FORMAT = "arrow_batches"
#: Fixed values of the stream format: what begins a message, and the kinds of messages.
CONTINUES = 0xFFFFFFFF
SCHEMA, DICTIONARY, BATCH = 1, 2, 3
#: Bytes of record batches that make a partition, more only for a single batch.
PARTITION = 64 << 20


@dataclass(frozen=True)
class Message:
    kind: int
    start: int
    end: int
    rows: int


def _field(table: bytes, at: int, number: int) -> int | None:
    """Where a field of a flat table is that begins at `at`; null if it isn't there."""
    layout = at - struct.unpack_from("<i", table, at)[0]
    size = struct.unpack_from("<H", table, layout)[0]
    offset = struct.unpack_from("<H", table, layout + 4 + 2 * number)[0] if 4 + 2 * number < size else 0
    return at + offset if offset else None


def _message(header: bytes, start: int, body: int) -> Message:
    root = struct.unpack_from("<I", header)[0]
    kind_at, table_at, size_at = (_field(header, root, k) for k in (1, 2, 3))
    kind = header[kind_at] if kind_at else 0
    size = struct.unpack_from("<q", header, size_at)[0] if size_at else 0
    rows = 0
    if kind == BATCH:
        table = table_at + struct.unpack_from("<I", header, table_at)[0]
        rows_at = _field(header, table, 0)
        rows = struct.unpack_from("<q", header, rows_at)[0] if rows_at else 0
    return Message(kind, start, body + size, rows)


def messages(path: str) -> Iterator[Message]:
    """The messages of a stream, from their headers; a torn end is left out."""
    store, place = _store(path)
    with store.open_input_file(place) as file:
        at, whole = 0, file.size()
        while at + 8 <= whole:
            mark, length = struct.unpack("<Ii", file.read_at(8, at))
            begin = at + 8
            if mark != CONTINUES:  # streams of old writers have no mark
                length, begin = struct.unpack("<i", struct.pack("<I", mark))[0], at + 4
            if length <= 0 or begin + length > whole:
                return
            found = _message(file.read_at(length, begin), at, begin + length)
            if found.end > whole:
                return
            yield found
            at = found.end


@dataclass
class Lot(InputPartition):
    """Batches of a file, the first row's number, and the spans of the schema and of the dictionaries they need."""

    file: str
    row: int
    spans: list[tuple[int, int]]


def lots(path: str, size: int = PARTITION) -> list[Lot]:
    """The partitions of a file. A dictionary counts for the batches that follow it."""
    out: list[Lot] = []
    before: list[tuple[int, int]] = []
    row, held, open_ = 0, 0, False
    for m in messages(path):
        if m.kind != BATCH:
            before, open_ = [*before, (m.start, m.end)], False
            continue
        if not open_ or held + m.end - m.start > size:
            out.append(Lot(path, row, list(before)))
            held, open_ = 0, True
        out[-1].spans.append((m.start, m.end))
        held += m.end - m.start
        row += m.rows
    return out


class BatchReader(DataSourceReader):
    def __init__(self, schema: T.StructType, planned: list[Lot], suffix: str):
        self.names, self.planned, self.suffix = schema.names[3:], planned, suffix

    def partitions(self) -> list[Lot]:
        return self.planned

    def read(self, lot: Lot) -> Iterator[pa.RecordBatch]:
        store, place = _store(lot.file)
        with store.open_input_file(place) as file:
            data = b"".join(file.read_at(b - a, a) for a, b in lot.spans)
        row, name = lot.row, lot.file.rsplit("/", 1)[-1].removesuffix(self.suffix)
        for batch in pa.ipc.open_stream(pa.BufferReader(data + struct.pack("<Ii", CONTINUES, 0))):
            n = batch.num_rows
            own = [c.dictionary_decode() if pa.types.is_dictionary(c.type) else c for c in (batch.column(batch.schema.get_field_index(x)) for x in self.names)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array([lot.file] * n, pa.string()), pa.array(range(row, row + n), pa.int64()), *own], names=["subset", "path", "row", *self.names])
            row += n


class ArrowBatches(DataSource):
    """Given by its options: files, their lots as planned, and the schema of the columns that are wanted."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return self.options["wanted"]

    def reader(self, schema: T.StructType) -> BatchReader:
        import json

        return BatchReader(schema, [Lot(f, r, [tuple(s) for s in spans]) for f, r, spans in json.loads(self.options["lots"])], self.options["suffix"])


def read(spark: SparkSession, files: list[str], schema: str, suffix: str = "-train.arrow", size: int = PARTITION) -> DataFrame:
    """(subset, path, row, *schema) of Arrow stream files; subset is a file's name without the suffix, row a row's place in it from 0.

    What reaches the driver is a row for each partition. Files that are no streams, or hold no rows, give nothing."""
    import json

    wanted = f"subset string, path string, row long, {schema}"
    if not files:
        return spark.createDataFrame([], wanted)

    @F.udf(T.ArrayType(T.StringType()), useArrow=True)
    def plan(path: str) -> list[str]:
        return [json.dumps([x.file, x.row, x.spans]) for x in lots(path, size)]

    named = spark.createDataFrame([(f,) for f in files], "path string").repartition(min(len(files), 1000))
    planned = [json.loads(r.lot) for r in named.select(F.explode(plan("path")).alias("lot")).collect()]
    if not planned:
        return spark.createDataFrame([], wanted)
    spark.dataSource.register(ArrowBatches)
    return spark.read.format(FORMAT).options(wanted=wanted, lots=json.dumps(planned), suffix=suffix).load()


def write_streams(batches: Iterator[pa.RecordBatch], path: str, by: str, names: list[str], suffix: str, size: int) -> int:
    """Rows sorted by `by` to a stream for each of its values, a record batch for each `size` rows; how many."""
    import uuid

    store, root = _store(path)
    store.create_dir(root)
    now, staged, sink, writer, files = None, "", None, None, 0

    def close() -> None:
        writer.close()
        sink.close()
        store.move(staged, f"{root}/{now}{suffix}")

    for batch in batches:
        values = batch.column(batch.schema.get_field_index(by)).to_pylist()
        edges = [0, *(k for k in range(1, len(values)) if values[k] != values[k - 1]), len(values)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            if writer is None or values[a] != now:
                if writer is not None:
                    close()
                now, files, staged = values[a], files + 1, f"{root}/.{uuid.uuid4().hex}"
                sink = store.open_output_stream(staged)
                writer = pa.ipc.new_stream(sink, batch.select(names).schema)
            own = batch.select(names).slice(a, b - a)
            for k in range(0, own.num_rows, size):
                writer.write_batch(own.slice(k, size))
    if writer is not None:
        close()
    return files
