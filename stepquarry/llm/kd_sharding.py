"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension until leaves hold the target bytes.

Law `bytes`: sizes of shards are near equal. Only narrow rows take part (id, size, checksum, coordinates). The tree's open boxes are a small
table, as many rows as shards at most; each level is a few passes in which rows are joined with their box (broadcast while the boxes are
few) and histograms of a fixed number of bins for each box are summed and scanned, all of it as DataFrames: the driver sees counts only, and
plans don't grow with the tree. A value that many rows share doesn't stop a split: ties go on by a hash of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, small, store

#: Bins in each step of the search for a median.
BIN_BITS = 10
COORDINATE_BITS = 31
KEY_BITS = 2 * COORDINATE_BITS
#: A plane may miss its weighted median by this share of a shard's target bytes.
TOLERANCE = 0.002


def _hex(c: Column | str) -> Column:
    return F.hex(F.encode(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), "UTF-8"))


def category_coordinate(c: Column, skip: int = 0) -> Column:
    """Four bytes of a string, after the first `skip`, as a number, in the strings' order; null comes first."""
    code = F.conv(F.rpad(F.substring(_hex(c), 2 * skip + 1, 8), 8, "0"), 16, 10).cast("long")
    return F.coalesce(F.shiftright(code, 1) + 1, F.lit(0)).cast("long")


def common_prefixes(docs: DataFrame, categories: list[str]) -> list[int]:
    """How many bytes all values of each column begin with alike: what its least and its greatest value share."""
    if not categories:
        return []
    ends = docs.agg(*[f(_hex(c)).alias(f"{n}{k}") for k, c in enumerate(categories) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    shared = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return [shared(ends[f"lo{k}"] or "", ends[f"hi{k}"] or "") // 2 for k in range(len(categories))]


def number_coordinate(c: Column) -> Column:
    """A number squeezed into the coordinate's range by its logarithm, in order; null comes first."""
    top = (1 << COORDINATE_BITS) - 1
    x = c.cast("double")
    scaled = F.when(x.isNull() | F.isnan(x), 0.0).otherwise(1 + F.log1p(F.greatest(x, F.lit(0.0))) * ((top - 1) / 45.0))
    return F.least(scaled, F.lit(float(top))).cast("long")


def tree_shards(rows: DataFrame, dims: list[str], weight: str, tie: str, *, shards: int | None = None, target_bytes: int | None = None) -> tuple[DataFrame, int]:
    """(rows with their shard, how many shards there are). rows: stored; dims and tie: longs of COORDINATE_BITS bits.

    Boxes are split until they hold target_bytes; a number of shards stands for that share of all bytes. A box is named by its first shard."""
    stats = rows.agg(F.sum(weight).alias("w"), *[f(d).alias(f"{d}_{n}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = stats["w"] or 0
    n = shards or max(1, -(-total // max(1, target_bytes or 1)))
    whole = [max(1, (stats[f"{d}_hi"] or 0) - (stats[f"{d}_lo"] or 0)) for d in dims]
    placed = rows.withColumn("first", F.lit(0).cast("long"))
    boxes = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("first"), F.lit(n).cast("long").alias("count"), F.lit(total).cast("long").alias("bytes"))
    most, at = n, None
    while most > 1 and total:
        open_ = _widest(placed, boxes.where("count > 1"), dims, whole)
        planes = _planes(placed, open_, dims, weight, tie, total / n)
        side = F.when(_key(dims, tie) < F.col("plane"), F.col("first")).otherwise(F.col("first") + F.floor(F.col("count") / 2))
        moved = placed.join(small(planes.select("first", "dim", "plane", "count")), "first", "left").withColumn("_to", F.coalesce(F.when(F.col("plane").isNotNull(), side), F.col("first")))
        later = store(moved.select(*[c for c in placed.columns if c != "first"], F.col("_to").alias("first")), "boxes")
        if at is not None:
            forget(at)
        placed = at = later
        half = F.floor(F.col("count") / 2)
        kids = F.array(F.struct("first", half.alias("count"), F.col("left").alias("bytes")), F.struct((F.col("first") + half).alias("first"), (F.col("count") - half).alias("count"), (F.col("bytes") - F.col("left")).alias("bytes")))
        boxes = store(planes.select(F.inline(kids)).where("bytes > 0"), "tree")
        most = boxes.agg(F.max("count")).first()[0] or 0
    return placed.withColumn("shard", F.col("first").cast("int")).drop("first"), n


def _key(dims: list[str], tie: str) -> Column:
    """Coordinate of the box's dimension, then tie-break: unique but for a few rows, and in the coordinate's order."""
    return F.shiftleft(F.get(F.array(*dims), F.col("dim")), COORDINATE_BITS) + F.col(tie)


def _widest(rows: DataFrame, boxes: DataFrame, dims: list[str], whole: list[int]) -> DataFrame:
    """Open boxes with their widest dimension, widths being shares of the whole table's, and the bits that its keys have in common."""
    spans = rows.join(small(boxes), "first").groupBy("first", "count", "bytes").agg(*[f(d).alias(f"{n}{k}") for k, d in enumerate(dims) for n, f in (("lo", F.min), ("hi", F.max))])
    width = lambda k: ((F.col(f"hi{k}") - F.col(f"lo{k}")) / whole[k]).alias("width")
    best = F.array_max(F.array(*[F.struct(width(k), F.lit(-k).alias("k"), F.col(f"lo{k}").alias("lo"), F.col(f"hi{k}").alias("hi")) for k in range(len(dims))]))
    x = spans.withColumn("best", best).select("first", "count", "bytes", (-F.col("best.k")).alias("dim"), F.shiftleft("best.lo", COORDINATE_BITS).alias("low"), (F.shiftleft(F.col("best.hi") + 1, COORDINATE_BITS) - 1).alias("high"))
    x = x.withColumn("bits", KEY_BITS - F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))))
    return store(x.select("first", "count", "bytes", "dim", "bits", F.expr(f"shiftright(low, {KEY_BITS} - bits)").alias("prefix"), F.lit(0).cast("long").alias("below")), "open")


def _planes(rows: DataFrame, boxes: DataFrame, dims: list[str], weight: str, tie: str, target: float) -> DataFrame:
    """boxes with plane (the key at which the right side begins) and left (bytes on the other): their medians, narrowed down by BIN_BITS bits
    of the key in a pass, all boxes in the same pass."""
    done = None
    while True:
        near = rows.join(small(boxes), "first").withColumn("k", _key(dims, tie)).where(F.expr(f"shiftright(k, {KEY_BITS} - bits) = prefix"))
        step = F.expr(f"shiftright(k, greatest({KEY_BITS} - bits - {BIN_BITS}, 0))")
        bins = near.groupBy(*boxes.columns, step.alias("bin")).agg(F.sum(weight).alias("w"))  # 2**BIN_BITS rows a box at most
        upto = F.col("below") + F.sum("w").over(Window.partitionBy("first").orderBy("bin"))
        want = F.col("bytes") * F.floor(F.col("count") / 2) / F.col("count")
        hit = bins.withColumn("upto", upto).where(F.col("upto") >= want).groupBy(*boxes.columns).agg(F.min(F.struct("bin", "upto", "w")).alias("h"))
        found = hit.select("first", "count", "bytes", "dim", F.least(F.lit(KEY_BITS), F.col("bits") + BIN_BITS).alias("bits"), F.col("h.bin").alias("prefix"), (F.col("h.upto") - F.col("h.w")).alias("below"), F.col("h.w").alias("w"))
        found = store(found, "medians")
        closed = (F.col("w") <= max(1, TOLERANCE * target)) | (F.col("bits") == KEY_BITS)
        after = (want - F.col("below") > F.col("below") + F.col("w") - want).cast("int")  # the plane goes to the nearer side of the bin
        made = found.where(closed).withColumn("after", after).withColumn("edge", F.col("prefix") + F.col("after"))
        made = made.select("first", "count", "bytes", "dim", F.expr(f"shiftleft(edge, {KEY_BITS} - bits)").alias("plane"), (F.col("below") + F.col("w") * F.col("after")).alias("left"))
        done = made if done is None else done.unionByName(made)
        boxes = found.where(~closed).drop("w")
        if boxes.isEmpty():
            return store(done, "planes")


def with_slots(rows: DataFrame, shard: str, row: str) -> DataFrame:
    """rows with slot, gapless from 0 in each shard. row: monotonically_increasing_id() from before rows were stored.

    Rows are numbered within a part of a shard (what one task once wrote), parts by a running sum of their counts: no shard is one task."""
    parted = rows.withColumn("part", F.shiftright(row, 33))
    counts = parted.groupBy(shard, "part").agg(F.count("*").alias("n"))
    before = counts.select(shard, "part", F.expr(f"sum(n) over (partition by {shard} order by part) - n").alias("before"))
    inner = parted.withColumn("inner", F.expr(f"row_number() over (partition by {shard}, part order by {row}) - 1"))
    return inner.join(before, [shard, "part"]).withColumn("slot", (F.col("before") + F.col("inner")).cast("long")).drop("part", "inner", "before")


def shard_documents(docs: DataFrame, shards: int | None = 16, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, ...] = ("lang", "source"), numbers: tuple[str, ...] = ("n_chars",)) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the row's coordinates.

    size: UTF-8 bytes plus 1; null text: 1 and checksum 0. Metadata that is null, or a column that docs doesn't have, counts as the
    lowest coordinate; a category's coordinate is the four bytes after what all its values begin with, so longer values may share one.
    Repeated rows are spread like any other rows. Empty input: no rows. Equal texts aren't kept together, as a group of copies may be
    larger than a shard. grown_shard is null: law `bytes` moves rows when the number of shards changes."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    named = [c for c in categories if c in docs.columns]
    skips = dict(zip(named, common_prefixes(docs, named), strict=True))
    coordinates = {f"at_{k}": category_coordinate(F.col(c), skips[c]) for k, c in enumerate(categories) if c in docs.columns}
    coordinates |= {f"at_{len(categories) + k}": number_coordinate(F.col(c)) for k, c in enumerate(numbers) if c in docs.columns}
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[c.alias(n) for n, c in coordinates.items()], F.monotonically_increasing_id().alias("row"))
    if not coordinates:
        narrow = narrow.withColumn("at_0", F.lit(0).cast("long"))
    narrow = narrow.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 64 - COORDINATE_BITS))
    rows = store(narrow, "shards")
    placed, _ = tree_shards(rows, list(coordinates) or ["at_0"], "size", "tie", shards=shards, target_bytes=target_bytes)
    placed = with_slots(placed, "shard", "row")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), *coordinates)
