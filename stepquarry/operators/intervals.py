"""Trees as intervals: in the order of their tags, read part by part, a node's descendants follow it directly.

So one scan in that order with a stack of the nodes that are still open gives every node's interval, and what is added up over its subtree, in place of
a search through all nodes for each. A record's nodes are arrays of one row; the scan is an Arrow UDF, which takes a batch's records as two flat columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for the dot between a tag's parts in the order of tags: less than any other character, so that a subtree has no gap.
LEAST = "\x01"


def preorder(tags: Iterable[str | None]) -> list[tuple[str, list[int]]]:
    """Tags in order as keys, with the places of the nodes that have them. Null tags are left out."""
    places: dict[str, list[int]] = {}
    for i, tag in enumerate(tags):
        if tag is not None:
            places.setdefault(tag.replace(".", LEAST), []).append(i)
    return sorted(places.items())


def scan(tags: Iterable[str | None], own: Callable[[list[int]], Any], add: Callable[[Any, Any], Any], down: Callable[[Any, list[int]], Any] = lambda above, places: None) -> Iterator[tuple[list[int], Any, Any]]:
    """(places, total, carried) for each tag, as its subtree ends. total: what `own` gives for a tag's nodes, added up over the subtree;
    carried: what `down` makes of what came from above (null at a root) and the tag's nodes."""
    stack: list[list] = []

    def close() -> tuple[list[int], Any, Any]:
        _, places, total, carried = stack.pop()
        if stack:
            stack[-1][2] = add(stack[-1][2], total)
        return places, total, carried

    for key, places in preorder(tags):
        while stack and not key.startswith(stack[-1][0] + LEAST):
            yield close()
        stack.append([key, places, own(places), down(stack[-1][3] if stack else None, places)])
    while stack:
        yield close()


def _nothing(*_: Any) -> None:
    return None


def _most(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def _over(tags: pa.Array, facts: pa.Array, kind: pa.DataType, of: Callable[[list, list | None], list]) -> pa.Array:
    """What `of` gives for each record's tags and what is known beside them (null where nothing is); null for a null record."""
    names, beside = tags.values.to_pylist(), facts.values.to_pylist()
    at, other = tags.offsets.to_pylist(), facts.offsets.to_pylist()
    sound, given = tags.is_valid().to_pylist(), facts.is_valid().to_pylist()
    return pa.array([of(names[at[k] : at[k + 1]], beside[other[k] : other[k + 1]] if given[k] else None) if sound[k] else None for k in range(len(tags))], pa.list_(kind))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _best(tags: pa.Array, values: pa.Array) -> pa.Array:
    def of(tags: list, values: list) -> list:
        out = [None] * len(tags)
        own = lambda places: max((values[i] for i in places if values[i] is not None), default=None)
        for places, total, _ in scan(tags, own, _most):
            for i in places:
                out[i] = total
        return out

    return _over(tags, values, pa.float64(), of)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("visits", T.LongType()), T.StructField("total", T.DoubleType())])))
def _sums(tags: pa.Array, values: pa.Array) -> pa.Array:
    def own(values: list, places: list[int]) -> tuple[int, float]:
        known = [values[i] for i in places if values[i] is not None]
        return len(known), float(sum(known))

    def of(tags: list, values: list) -> list:
        out = [None] * len(tags)
        for places, total, _ in scan(tags, lambda places: own(values, places), lambda a, b: (a[0] + b[0], a[1] + b[1])):
            for i in places:
                out[i] = {"visits": total[0], "total": total[1]}
        return out

    return _over(tags, values, pa.struct([("visits", pa.int64()), ("total", pa.float64())]), of)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _ways(tags: pa.Array, wanted: pa.Array) -> pa.Array:
    def of(tags: list, wanted: list | None) -> list:
        out = [None] * len(tags)
        for places, _, link in scan(tags, _nothing, _nothing, lambda above, places: (above, places)):
            if wanted is None or any(wanted[i] for i in places):
                way = []
                while link:
                    way += reversed(link[1])
                    link = link[0]
                way.reverse()
                for i in places:
                    if wanted is None or wanted[i]:
                        out[i] = way
        return out

    return _over(tags, wanted, pa.list_(pa.int32()), of)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("shown", T.IntegerType()), T.StructField("leaf", T.BooleanType()), T.StructField("parent", T.IntegerType())])))
def _standing(tags: pa.Array, shown: pa.Array) -> pa.Array:
    def of(tags: list, shown: list) -> list:
        out = [None] * len(tags)
        place = {tag: i for i, tag in reversed([*enumerate(tags)]) if tag is not None}
        parents = {tag.rpartition(".")[0] for tag in place if "." in tag}
        for places, _, count in scan(tags, _nothing, _nothing, lambda above, places: (above or 0) + sum(bool(shown[i]) for i in places)):
            for i in places:
                up = tags[i].rpartition(".")[0] if "." in tags[i] else None
                out[i] = {"shown": count, "leaf": tags[i] not in parents, "parent": place.get(up)}
        return out

    return _over(tags, shown, pa.struct([("shown", pa.int32()), ("leaf", pa.bool_()), ("parent", pa.int32())]), of)


def _field(react: Column, name: str) -> Column:
    return F.transform(react, lambda n: n[name])


def best_values(react: Column, value: Callable[[Column], Column]) -> Column:
    """For each node the largest known `value` at or below it; null where none is known."""
    return best_of(react, F.transform(react, value))


def best_of(react: Column, values: Column) -> Column:
    """As best_values, of an array of the nodes' values."""
    return _best(_field(react, "tag"), values.cast("array<double>"))


def totals(react: Column, value: Callable[[Column], Column]) -> Column:
    """For each node (visits, total): how many known values there are at or below it, and their sum."""
    return _sums(_field(react, "tag"), F.transform(react, lambda n: value(n).cast("double")))


def ways(react: Column, wanted: Callable[[Column], Column] | None = None) -> Column:
    """For each node (that is wanted; null for others) the places of the nodes from the root to it; prefixes without a node are passed over."""
    return _ways(_field(react, "tag"), F.transform(react, lambda n: F.coalesce(wanted(n), F.lit(False))) if wanted else F.lit(None).cast("array<boolean>"))


def standing(react: Column) -> Column:
    """For each node (shown, leaf, parent): how many nodes on the way to it have text, whether it has no children, and its parent's place."""
    return _standing(_field(react, "tag"), F.transform(react, lambda n: F.coalesce(n["text"], F.lit("")) != ""))


def parents(react: Column) -> Column:
    """For each node its parent's place, null where the parent isn't there."""
    return F.transform(_standing(_field(react, "tag"), F.transform(react, lambda n: F.lit(True))), lambda x: x["parent"])
