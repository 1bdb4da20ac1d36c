"""First-wins by state: each key's first row goes on, whatever batch it comes in, and what is remembered is a key and a mark.

The state is keyed and checkpointed by Spark, so a batch costs its own rows, not a join with all that was written, and a batch that is replayed after a failure gives
the same rows once. With an expiry, keys that haven't come for so long are forgotten, so that state is bounded where repeats are near in time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstSeen(StatefulProcessor):
    """Emits a key's least row by `order` of the first batch that has the key, and nothing for it afterwards."""

    def __init__(self, order: Sequence[str], columns: Sequence[str], expiry_ms: int | None):
        self.order, self.columns, self.expiry_ms = list(order), list(columns), expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("seen", T.BooleanType())]), self.expiry_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = self.seen.exists()
        first = None
        for part in rows:
            if not known and len(part):
                least = part.sort_values(self.order, kind="stable").head(1)
                first = least if first is None else pd.concat([first, least]).sort_values(self.order, kind="stable").head(1)
        if first is not None or self.expiry_ms is not None:
            self.seen.update((True,))  # with an expiry, a key that comes again is remembered anew
        if first is not None:
            yield first[self.columns]

    def close(self) -> None:
        pass


def first_rows(stream: DataFrame, keys: Sequence[str], order: Sequence[str], expiry_ms: int | None = None) -> DataFrame:
    """The rows of a stream whose key hasn't come before; of one batch's rows of a key the least by order. Null keys are one key.

    The session must use the RocksDB state store; `ingest` sees to that."""
    mode = "ProcessingTime" if expiry_ms is not None else "None"
    processor = FirstSeen(order, stream.columns, expiry_ms)
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=stream.schema, outputMode="Append", timeMode=mode)


def ingest(spark: SparkSession, path: str, schema: T.StructType | str, out: str, checkpoint: str, keys: Sequence[str], order: Sequence[str], expiry_ms: int | None = None, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Appends to the Parquet folder `out` the first row of each key of the JSON files that are new since the checkpoint, then stops."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = transform(spark.readStream.schema(schema).json(path))
    fresh = first_rows(rows, keys, order, expiry_ms)
    return fresh.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
