"""JSON files of any size and shape, read in splits.

Files are read by Spark's text source with the closing brace as the line separator, so every store that Spark reads will do and a file is split
as Spark splits it, also where it is one line. What a split's text means depends on whether it begins inside a string and how deep. Inside or
not are two cases, and for each a split has an effect: where it ends and by how much the depth changes. Effects of neighbours compose, so one pass
gives each split's effect, a fold over a file's splits gives the state that each begins in, and a second pass cuts the elements out.
Elements that begin in one split and end in another are put together from their parts: two parts a split at most are shuffled."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: States of splits are broadcast if there are no more of them than this; beyond, the splits are dealt anew.
BROADCAST_ROWS = 1_000_000
#: What a file holds: an array of elements, objects one after another (one, as a rule), an object a line.
ARRAY, OBJECTS, LINES = "array", "objects", "lines"

STRING = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)
REST_OF_STRING = re.compile(rb'(?:[^"\\]|\\.)*"', re.S)
BRACKET = re.compile(rb"[\[\]{}]")

EFFECTS = "file string, block long, size long, bytes long, first string, whole_line boolean, ends array<boolean>, deltas array<long>, last_ends array<boolean>, last_deltas array<long>"
STATES = "file string, block long, inside boolean, depth long, shape string, sound boolean, open_end boolean, last boolean"


def blanked(text: bytes, inside: bool) -> tuple[bytes, bool]:
    """The text with its strings overwritten, and whether it ends inside a string. `inside`: whether it begins in one."""
    head = b""
    if inside:
        end = REST_OF_STRING.match(text)
        if not end:
            return b" " * len(text), True
        head, text = b" " * end.end(), text[end.end() :]
    text = STRING.sub(lambda m: b" " * len(m[0]), text)
    quote = text.find(b'"')
    return (head + text, False) if quote < 0 else (head + text[:quote] + b" " * (len(text) - quote), True)


def effect(text: bytes, inside: bool) -> tuple[bool, int]:
    """Whether the text ends inside a string, and how the depth changes."""
    plain, inside = blanked(text, inside)
    return inside, plain.count(b"{") + plain.count(b"[") - plain.count(b"}") - plain.count(b"]")


def chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, size, row, value): stretches up to closing braces, in order within a split."""
    raw = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.monotonically_increasing_id().alias("row"), F.col("value").cast("binary").alias("value"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


class _Effect:
    """Of a split: from outside and from inside a string, the state before the last stretch and after it, with and without its brace."""

    def __init__(self, file: str, block: int, size: int):
        self.key, self.bytes, self.first, self.line, self.whole_line = (file, block, size), 0, "", b"" if block == 0 else None, None
        self.now, self.last = [(False, 0), (True, 0)], b""
        self.fresh = True

    def add(self, value: bytes) -> None:
        if not self.fresh:
            self.now = [self._after(s, self.last + b"}") for s in self.now]
        self.fresh, self.last = False, value
        self.bytes += len(value) + 1
        if not self.first and (seen := value.strip()):
            self.first = chr(seen[0])
        if self.line is not None:
            before, newline, _ = value.partition(b"\n")
            self.line += before + (b"" if newline else b"}")
            if newline and self.line.strip():
                self.close_line()

    def close_line(self) -> None:
        try:
            self.whole_line = isinstance(json.loads(self.line), dict)
        except ValueError:
            self.whole_line = False
        self.line = None

    @staticmethod
    def _after(state: tuple[bool, int], text: bytes) -> tuple[bool, int]:
        inside, delta = effect(text, state[0])
        return inside, state[1] + delta

    def row(self) -> dict:
        if self.line is not None and self.line.strip():
            self.line = self.line[:-1] if self.bytes == self.key[2] + 1 else self.line
            self.close_line()
        braced, bare = ([self._after(s, self.last + end) for s in self.now] for end in (b"}", b""))
        return dict(zip(("file", "block", "size"), self.key)) | {"bytes": self.bytes, "first": self.first, "whole_line": self.whole_line, "ends": [x[0] for x in braced], "deltas": [x[1] for x in braced], "last_ends": [x[0] for x in bare], "last_deltas": [x[1] for x in bare]}


def effects(found: DataFrame) -> DataFrame:
    """A row for each split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("size", pa.int64()), ("bytes", pa.int64()), ("first", pa.string()), ("whole_line", pa.bool_()), ("ends", pa.list_(pa.bool_())), ("deltas", pa.list_(pa.int64())), ("last_ends", pa.list_(pa.bool_())), ("last_deltas", pa.list_(pa.int64()))])
        for file, block, size, _, value in _rows(batches):
            if now is None or now.key[:2] != (file, block):
                if now is not None:
                    yield pa.RecordBatch.from_pylist([now.row()], schema)
                now = _Effect(file, block, size)
            now.add(value)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    return found.mapInArrow(run, EFFECTS)


def states(found: DataFrame) -> DataFrame:
    """effects -> (file, block, inside, depth, shape, sound, open_end, last): the state each split begins in, what its file holds, and whether that closes.

    A file's splits are folded in one group: a row for each 128 MB or so, not the text. Where a file ends without a closing brace its last stretch is bare,
    which shows in the sum of the stretches' bytes."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        first = next((x for x in group["first"] if x), "")
        shape = ARRAY if first == "[" else LINES if first == "{" and group["whole_line"].iloc[0] else OBJECTS
        bare = int(group["bytes"].sum()) == int(group["size"].iloc[0]) + 1
        inside, depth, out = False, 0, []
        for k, r in enumerate(group.itertuples()):
            out.append((r.file, r.block, inside, depth))
            plain = bare and k == len(group) - 1
            ends, deltas = (r.last_ends, r.last_deltas) if plain else (r.ends, r.deltas)
            inside, depth = bool(ends[int(inside)]), depth + int(deltas[int(inside)])
        sound = not inside and depth == 0
        rows = [(*x, shape, sound, bare, k == len(out) - 1) for k, x in enumerate(out)]
        return pd.DataFrame(rows, columns=["file", "block", "inside", "depth", "shape", "sound", "open_end", "last"])

    return found.groupBy("file").applyInPandas(fold, STATES)


class _Cutter:
    """Cuts the elements of one split: whole ones, the rest of one that began before (`head`), the beginning of one that goes on (`tail`)."""

    def __init__(self, inside: bool, depth: int, base: int):
        self.inside, self.depth, self.base = inside, depth, base
        self.held: list[bytes] | None = [] if depth > base else None
        self.head, self.k = depth > base, 0

    def add(self, text: bytes) -> Iterator[tuple[int, str, bytes]]:
        plain, self.inside = blanked(text, self.inside)
        begin = 0
        for m in BRACKET.finditer(plain):
            if m[0] in b"[{":
                if self.depth == self.base and (self.base or m[0] == b"{"):
                    begin, self.held = m.start(), []
                self.depth += 1
            else:
                self.depth -= 1
                if self.depth == self.base and self.held is not None:
                    yield self.k, "head" if self.head else "whole", b"".join([*self.held, text[begin : m.end()]])
                    self.k, self.held, self.head = self.k + 1, None, False
        if self.held is not None:
            self.held.append(text[begin:])

    def close(self) -> Iterator[tuple[int, str, bytes]]:
        if self.held is not None:
            yield self.k, "head" if self.head else "tail", b"".join(self.held)  # a head that doesn't end goes through the whole split


def elements(spark: SparkSession, path: str | list[str], found: DataFrame | None = None) -> DataFrame:
    """(file, block, k, value): the elements of arrays and the objects of other files, in the order of (block, k) in their file.

    Files that don't close, as torn ones, are left out. An element's text must fit in a task, nothing else must. Elements are cut by brackets and
    strings: whether one is sound JSON shows when it is parsed. found: `states` of the same files, if they are known."""
    known = states(effects(chunks(spark, path))) if found is None else found
    known = known.where("sound")
    few = known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = chunks(spark, path)
    rows = rows.join(F.broadcast(known), ["file", "block"]) if few else rows.join(known, ["file", "block"]).repartition("file", "block").sortWithinPartitions("file", "block", "row")
    rows = rows.select("file", "block", "inside", "depth", F.when(F.col("shape") == ARRAY, 1).otherwise(0).alias("base"), (F.col("open_end") & F.col("last")).alias("open_end"), "value")
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("k", pa.int64()), ("part", pa.string()), ("value", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, last, held = None, None, None, []

        def put(parts: Iterator[tuple[int, str, bytes]]) -> None:
            held.extend((*key, *p) for p in parts)

        def close(bare: bool) -> None:
            put(cutter.add(last + (b"" if bare else b"}")))
            put(cutter.close())

        for file, block, inside, depth, base, open_end, value in _rows(batches):
            if key != (file, block):
                if key is not None:
                    close(bare)
                key, cutter, last = (file, block), _Cutter(inside, depth, base), None
            if last is not None:
                put(cutter.add(last + b"}"))
            last, bare = value, open_end
            if len(held) >= 1024 or held and len(held[-1][-1]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held.clear()
        if key is not None:
            close(bare)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    cuts = rows.mapInArrow(cut, "file string, block long, k long, part string, value binary")
    begun = F.sum(F.when(F.col("part") == "tail", 1).otherwise(0)).over(Window.partitionBy("file").orderBy("block", "k"))
    parts = cuts.where("part <> 'whole'").withColumn("begun", begun)  # two a split at most
    joined = parts.groupBy("file", "begun").agg(F.sort_array(F.collect_list(F.struct("block", "k", "value"))).alias("parts"))
    joined = joined.select("file", F.get("parts", 0)["block"].alias("block"), F.get("parts", 0)["k"].alias("k"), F.aggregate(F.transform("parts", lambda p: p["value"]), F.lit(b""), lambda a, v: F.concat(a, v)).alias("value"))
    both = cuts.where("part = 'whole'").select("file", "block", "k", "value").unionByName(joined)
    return both.withColumn("value", F.col("value").cast("string"))


def records(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """(file, record): the objects of files of any shape, told by content, whatever the file's name.

    An array or object file is left out whole if it doesn't close or one of its elements isn't JSON; elements that aren't objects are passed over. Of
    files with an object a line, which begin with a line that is one, lines that aren't JSON are passed over. Empty files give nothing."""
    known = states(effects(chunks(spark, path)))
    shapes = known.where("block = 0").select("file", "shape").distinct().collect()  # names of files, as Spark's own listing has them
    by_line, whole = [r.file for r in shapes if r["shape"] == LINES], [r.file for r in shapes if r["shape"] != LINES]
    out = spark.createDataFrame([], "file string, value string")
    if whole:
        pieces = elements(spark, whole)
        sound = F.try_parse_json("value").isNotNull()
        bad = pieces.where(~sound).select("file").distinct()
        out = pieces.select("file", "value").join(bad, "file", "left_anti")
    if by_line:
        out = out.unionByName(spark.read.text(by_line).select(F.col("_metadata.file_path").alias("file"), "value").where(F.try_parse_json("value").isNotNull()))
    return out.where(F.ltrim("value").startswith("{")).select("file", F.from_json("value", schema).alias("record"))
