"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints and their trie self-join first, verified on the texts; then, exactly, what fingerprints miss, by a
prefix filter, counts of common shingles, and the sets themselves.

Fingerprints within PRINT_BITS find most copies, and link them before others are looked for; at the similarity asked for some 10 of 64 bits differ, where a trie selects
next to nothing. All shingles have one order, the common ones last; what is common is counted over all texts. Two sets with similarity t share a shingle among the first n - ceil(t n) + 1 of each,
whatever the order, so pairs are looked for there only (Chaudhuri et al. 2006); what they share there bounds what they can share at all.
Before a pair is written, two bounds that lose none are held against it (`_Cell.partners`): what comes before the first shingle that a text of another cluster begins with
is its own (Xiao et al. 2008), and the bits in which two parity sketches differ are shingles that only one of the sets has (Sandes et al. 2020).
Every pair that is left is verified on its texts. Where more than HOT texts of like sizes begin with a shingle, each is first held
against the most usual one of them, and then only texts that are still apart are paired, in cells of bounded size. Texts that are still apart are first linked to the closest by sketch. Of the pairs that remain each cluster's likeliest are verified
first, then the likeliest between two clusters, and the others only if these fail, so a large cluster of near copies isn't squared.
Equal word sequences are one text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash_dedup
from .common import BROADCAST_ROWS, HEAVY, ascii_lower, forget, give_back, join_evenly, mix64, over_batches, small, small_batches, store, texts_of, unique_name
from .components import connected_components

SEED = 42
SHINGLE_WORDS = 5
#: Fingerprints of a first link differ in so many bits at most.
PRINT_BITS = 3
#: The similarity from which texts are near copies, in fifths, so that sizes are compared as integers.
FIFTHS = 4
HOT = 16
#: So many times each cluster's likeliest pair is verified, and then so many pairs between two clusters, before the others.
NEAREST, LIKELIEST = 2, 3
#: A text is held against a centre if it shares this part of what it must: groups with other centres don't count.
PART = 3
#: So many shingles, the commonest, are put last. It decides on time, not on results.
COMMON = 1 << 20
#: Rows of a shingle that one task may have whatever the input, and the step of the histogram that finds the common ones.
CELL, STEP = 10_000, 1.1
#: Bits of a shingle's hash; above them is how often the sample has it.
BITS = 56
#: Pairs made at once, texts taken at once, distinct words whose hashes are remembered, and shingles counted at once.
CHUNK, SLICE, WORDS, LOT = 1 << 15, 512, 1 << 17, 1 << 22
#: Bits of a set's sketch: some 40 shingles that only one of two sets has show as 38 bits or more, almost always.
SKETCH_BITS = 1024
FACTORS = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh64_intdigest(word, SEED)
        if len(self) < WORDS:
            self[word] = made
        return made


def shingle_set(text: bytes, hashes: dict) -> np.ndarray:
    """Sorted distinct 56-bit hashes of the text's shingles of words; fewer words than a shingle: the whole sequence; none: none."""
    found = ascii_lower(text).split()
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    size = min(len(w), SHINGLE_WORDS)
    if not size:
        return w
    made = sum(w[k : len(w) - size + 1 + k] * FACTORS[k] for k in range(size))
    return np.unique(mix64(made) >> np.uint64(64 - BITS))


def prefix_length(n: np.ndarray | int) -> np.ndarray | int:
    return n - (FIFTHS * n + 4) // 5 + 1


def least_common(n: np.ndarray | int) -> np.ndarray | int:
    """How many shingles two sets must share that have n together: similarity t is a share of t / (1 + t)."""
    return -(-FIFTHS * n // (5 + FIFTHS))


def ordered(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the order of all shingles: by how often the sample has them, 127 at most, then by hash."""
    known, counts = common
    if len(known) and len(shingles):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        shingles = shingles | (np.where(known[at] == shingles, counts[at], 0).astype(np.uint64) << np.uint64(BITS))
    return np.sort(shingles)


def sketch(shingles: np.ndarray) -> bytes:
    """A bit for each value of the shingles' last bits: whether an odd number of the set has it. Two sketches differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingles % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts, so that only one part's texts and sets are Python's own at a time."""
    return (batch.slice(at, SLICE) for at in range(0, batch.num_rows, SLICE))


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts have, sorted, and how many; COMMON at most. Of all texts; a lot of LOT shingles leaves out what only one of its texts has."""

    def of_lot(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate(held)
        held.clear()
        h.sort()
        same = h[1:] == h[:-1]
        ends = np.flatnonzero(np.diff(same, prepend=False, append=False))  # where runs of equal ones begin and end, in turn
        begins, counts = ends[::2], ends[1::2] - ends[::2] + 1
        for at in range(0, len(begins), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array(h[begins[at : at + CHUNK]].astype(np.int64)), pa.array(counts[at : at + CHUNK])], names=["h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _Hashes(), [], 0
        for part in (x for batch in batches for x in _slices(batch)):
            sets = [shingle_set(x, hashes) for x in texts_of(part)]
            held += sets
            size += sum(map(len, sets))
            if size >= LOT:
                yield from of_lot(held)
                size = 0
        if held:
            yield from of_lot(held)
        give_back()

    with small_batches(texts.sparkSession):
        counted = store(texts.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2"), "common")
    rows = counted.where(F.col("n") > _cut(counted)).toPandas().sort_values("h")
    forget(counted)
    return rows["h"].to_numpy(np.int64).astype(np.uint64), np.minimum(rows["n"].to_numpy(np.int64), 127).astype(np.uint64)


def _cut(counted: DataFrame) -> int:
    """The least number above which counted(h, n) has COMMON rows at most, from a histogram over powers of STEP."""
    power = F.floor(F.log(float(STEP), "n"))
    left = COMMON
    for p, rows in sorted(((r.power, r["count"]) for r in counted.groupBy(power.alias("power")).count().collect()), reverse=True):
        left -= rows
        if left < 0:
            return int(counted.where(power == p).agg(F.max("n")).first()[0])
    return 0


def postings(texts: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(h, key, n, rare, at, sketch) of the shingles in each text's prefix; n is the size of its set, rare how many of it HOT texts at most have, at the
    shingle's place in the set's order. The sketch comes with the first shingle only."""
    shared = texts.sparkSession.sparkContext.broadcast(common)
    hashes = _Hashes()

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x, hashes) for x in texts_of(batch)]
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        takes = np.where(n > 0, prefix_length(n), 0)
        keys = batch.column(batch.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
        sets = [ordered(s, shared.value) for s in sets]
        rare = np.array([np.searchsorted(s, np.uint64((HOT + 1) << BITS)) for s in sets], np.int32)
        h = np.concatenate([s[:k] for s, k in zip(sets, takes, strict=True)])
        at = np.arange(len(h)) - np.repeat(np.cumsum(takes) - takes, takes)
        columns = [h.view(np.int64), np.repeat(keys, takes), np.repeat(n, takes).astype(np.int32), np.repeat(rare, takes), at.astype(np.int32)]
        sketches = np.full(len(h), None, object)
        sketches[at == 0] = [sketch(s) for s in sets if len(s)]
        arrays = [*map(pa.array, columns), pa.array(sketches, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["h", "key", "n", "rare", "at", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from (each(part) for batch in batches for part in _slices(batch))
        give_back()

    return texts.mapInArrow(run, "h long, key long, n int, rare int, at int, sketch binary")


def met(posted: DataFrame) -> DataFrame:
    """The rows of posted, stored, whose shingle other texts begin with too, without sketches; stored."""
    shared = store(posted.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1"), "shared")
    out = store(join_evenly(posted.drop("sketch"), shared, ["h"], "texts").drop("texts"), "met")
    forget(shared)
    return out


def between_roots(posted: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """posted, stored -> (h, key, n, root, reach, sketch), stored, of the shingles that texts of several roots begin with.

    The least shingle that two near sets share is one of these, so what comes before a set's first one it shares with no near set of another root; reach is
    what is left. A set of which too little is left even for the smallest near set is dropped. Only shingles that more than HOT texts begin with have the sketch."""
    rooted = store(posted.join(small(roots.select(F.col("node").alias("key"), "root")), "key", "left").withColumn("root", F.coalesce("root", "key")).select("h", "key", "n", "at", "root"), "rooted")
    several = store(rooted.groupBy("h").agg(F.count("*").alias("texts"), F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("h", "texts"), "several")
    reach = F.col("n") - F.min("at").over(Window.partitionBy("key"))
    kept = join_evenly(rooted, several, ["h"], "texts").withColumn("reach", reach).where(F.expr(f"{5 + FIFTHS} * reach >= {FIFTHS} * (n + ({FIFTHS} * n + 4) div 5)"))
    out = store(kept.join(sketches, "key").select("h", "key", "n", "root", "reach", F.when(F.col("texts") > HOT, F.col("sketch")).alias("sketch")), "between")
    forget(rooted, several)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns after the first, for each run of equal values of the first with two rows at least."""
    at, parts = None, []
    for batch in batches:
        first, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        edges = np.flatnonzero(first[1:] != first[:-1]) + 1
        for lo, hi in zip([0, *edges], [*edges, len(first)], strict=True):
            if hi == lo:
                continue
            if parts and first[lo] != at:
                if len(parts) > 1 or len(parts[0][0]) > 1:
                    yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            at = first[lo]
            parts.append([c[lo:hi] for c in rest])
    if parts and (len(parts) > 1 or len(parts[0][0]) > 1):
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _batches(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Pairs' columns in batches of some CHUNK rows."""
    held, size = [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names=names)
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= CHUNK:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


def print_pairs(texts: DataFrame) -> DataFrame:
    """texts(key, text), stored -> (a, b), stored: each text and the first one with its fingerprint, and the first texts of fingerprints that the trie self-join
    links. No more pairs than texts and links; whether they are similar is left to `verified`."""
    with small_batches(texts.sparkSession):
        prints = store(simhash_dedup.with_fingerprints(texts.select("key", "text"), "text", "fp", SHINGLE_WORDS).select("key", "fp"), "prints")
    first = store(prints.groupBy("fp").agg(F.min("key").alias("first"), F.count("*").alias("texts")), "first-prints")
    equal = join_evenly(prints, first.where("texts > 1"), ["fp"], "texts").where("key <> first").select(F.col("first").alias("a"), F.col("key").alias("b"))
    sides = [first.select(F.col("fp").alias(f"fp_{x}"), F.col("first").alias(x)) for x in "ab"]
    near = simhash_dedup.links(first.select("fp"), PRINT_BITS).toDF("fp_a", "fp_b").join(sides[0], "fp_a").join(sides[1], "fp_b")
    out = store(equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct(), "print-pairs")
    forget(prints, first)
    return out


PAIR = ["a", "b", "na", "nb"]


def star_pairs(posted: DataFrame) -> DataFrame:
    """posted, stored -> pairs of a centre and another text, for each shingle and class of sizes with more than HOT texts that begin with it; of a
    text's centres the one that it shares most with. All others are left to all_pairs. Sizes of a class differ by a quarter at most.

    The centre is the text with the fewest rare shingles: of edited copies the one with the fewest edits, which most others are near to.
    Centres come from an aggregate that combines before its shuffle, and go to the rows by broadcast or by an evenly dealt join."""
    classed = posted.withColumn("class", F.floor(F.log(5 / FIFTHS, "n")))
    hot = store(classed.groupBy("h", "class").agg(F.count("*").alias("texts")).where(F.col("texts") > HOT), "hot")
    few = hot.count() <= BROADCAST_ROWS
    meet = lambda rows, table: rows.join(F.broadcast(table), ["h", "class"]) if few else join_evenly(rows, table, ["h", "class"], "texts")
    members = store(meet(classed, hot), "members")
    centre = F.min(F.struct("rare", "key", "n")).alias("centre")
    centres = store(members.groupBy("h", "class").agg(F.first("texts").alias("texts"), centre).select("h", "class", "texts", F.col("centre.key").alias("a"), F.col("centre.n").alias("na")), "centres")
    met = meet(members.drop("texts"), centres)
    found = _likely(met.where("a <> key").select("a", F.col("key").alias("b"), "na", F.col("n").alias("nb")), PAIR, PART)
    first = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "na", "a"))
    out = store(found.withColumn("place", first).where(F.col("place") == 1).select("a", "b", "na", "nb"), "stars")
    forget(hot, members, centres)
    return out


def celled(posted: DataFrame) -> DataFrame:
    """posted(h, key, n, root and more) with the columns cell and block, so that no cell of a shingle has more than some one in HEAVY of all rows.

    A shingle with few rows is one cell. One with more is left out if all its texts have one root, as then it has no pairs; else its texts are dealt to blocks, and
    each two blocks meet in a cell: a text goes to each cell of its block."""
    most = max(posted.count() // HEAVY, CELL)
    bucket = F.col("h").bitwiseAND(0xFFFF)
    full = posted.groupBy(bucket.alias("bucket")).count().where(F.col("count") > most).select("bucket")  # only these hold such shingles
    heavy = posted.withColumn("bucket", bucket).join(F.broadcast(full), "bucket", "left_semi").groupBy("h").agg(F.count("*").alias("texts"), F.min("root").alias("one"), F.max("root").alias("other")).where(F.col("texts") > most)
    heavy = store(heavy.select("h", F.when(F.col("one") == F.col("other"), 0).otherwise(F.ceil(F.col("texts") / most)).cast("int").alias("blocks")), "heavy")
    light = posted.join(F.broadcast(heavy.select("h")), "h", "left_anti").withColumns({"cell": F.lit(0), "block": F.lit(0)})  # HEAVY rows at most
    dealt = posted.join(F.broadcast(heavy.where("blocks > 0")), "h").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return light.unionByName(dealt.withColumn("other", others).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).drop("other", "blocks"))


class _Cell:
    """Texts that begin with one shingle, by sizes, without those that can't be near even to the smallest."""

    def __init__(self, key: np.ndarray, n: np.ndarray, root: np.ndarray, block: np.ndarray, reach: np.ndarray, sketches: np.ndarray):
        order = np.argsort(n, kind="stable")
        while len(order) and not (can := (5 + FIFTHS) * reach[order].astype(np.int64) >= FIFTHS * (n[order].astype(np.int64) + n[order[0]])).all():
            order = order[can]
        self.key, self.root, self.block, self.sizes = key[order], root[order], block[order], n[order]
        self.n, self.reach = self.sizes.astype(np.int64), reach[order].astype(np.int64)
        self.several = len(order) > 1 and (self.root != self.root[0]).any()
        if self.several:
            self.one_block = (self.block == self.block[0]).all()
            self.words = None if sketches[0] is None else np.frombuffer(b"".join(sketches[order]), np.uint64).reshape(len(order), -1)
            self.begins, self.ends = np.searchsorted(self.n, -(-FIFTHS * self.n // 5)), np.searchsorted(self.n, 5 * self.n // FIFTHS, "right")

    def partners(self, i: int, first: int) -> tuple[np.ndarray, np.ndarray]:
        """The texts of other roots from `first` on that can be near to text i by sizes, reach and sketch, and in how many bits the sketches differ."""
        at = slice(first, self.ends[i])
        j = np.flatnonzero((self.root[at] != self.root[i]) & (self.one_block | (self.block[at] != self.block[i]))) + first
        j = j[(5 + FIFTHS) * np.minimum(self.reach[i], self.reach[j]) >= FIFTHS * (self.n[i] + self.n[j])]
        if self.words is None:
            return j, np.zeros(len(j), np.int64)
        differ = np.bitwise_count(self.words[j] ^ self.words[i]).sum(1, dtype=np.int64)
        near = (5 + FIFTHS) * differ <= (5 - FIFTHS) * (self.n[i] + self.n[j])
        return j[near], differ[near]

    def pairs(self, i: int, j: np.ndarray) -> list[np.ndarray]:
        one, turn = np.full(len(j), i), self.root[j] < self.root[i]
        x, y = np.where(turn, j, one), np.where(turn, one, j)
        return [c[z] for c in (self.key, self.sizes, self.root) for z in (x, y)]


def _cells(posted: DataFrame) -> DataFrame:
    place = F.xxhash64("h", "cell")
    return celled(posted).select(place.alias("place"), "key", "n", "root", "block", "reach", "sketch").repartition("place").sortWithinPartitions("place")


def all_pairs(posted: DataFrame) -> DataFrame:
    """posted(h, key, n, root, reach, sketch) -> (a, b, na, nb, ra, rb, shared) of texts of different roots, the smaller root first, that can be similar by
    their sizes, by reach and sketch, and by what their prefixes share. Pairs are held against the first of these where they meet, so texts that have a common
    shingle, but aren't near, are no rows, however many they are."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for cell in (_Cell(*x) for x in _groups(batches)):
            for i in range(len(cell.n) - 1) if cell.several else ():
                if len(j := cell.partners(i, i + 1)[0]):
                    yield cell.pairs(i, j)

    names = [*PAIR, "ra", "rb"]
    found = _cells(posted).mapInArrow(lambda x: _batches(pairs(x), names), "a long, b long, na int, nb int, ra long, rb long")
    return _likely(found, names)


def closest(posted: DataFrame) -> DataFrame:
    """posted as for all_pairs, with sketches -> (a, b, na, nb, ra, rb), each once: for each text the LIKELIEST closest ones by sketch of those that are closest
    in a cell. No more rows than posted has in cells, so a large group of near copies isn't squared before its roots are merged."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for cell in (_Cell(*x) for x in _groups(batches)):
            for i in range(len(cell.n)) if cell.several else ():
                j, differ = cell.partners(i, cell.begins[i])
                if len(j):
                    best = np.argmin(differ)
                    yield *cell.pairs(i, j[best : best + 1]), cell.key[i : i + 1], differ[best : best + 1]

    names = [*PAIR, "ra", "rb"]
    found = _cells(posted).mapInArrow(lambda x: _batches(pairs(x), [*names, "key", "differ"]), "a long, b long, na int, nb int, ra long, rb long, key long, differ long").distinct()
    place = F.row_number().over(Window.partitionBy("key").orderBy("differ", "a", "b"))
    return found.withColumn("place", place).where(F.col("place") <= LIKELIEST).select(*names).distinct()


def _likely(found: DataFrame, names: list[str], part: int = 1) -> DataFrame:
    """names and shared of pairs with a row for each shingle their prefixes share, where that is enough: beyond one of the two prefixes nothing is known.

    If found has some of these shingles only, what is seen may be the given part of what is needed."""
    counted = found.groupBy(*names).agg(F.count("*").alias("shared"))
    beyond = F.expr(f"greatest(({FIFTHS} * na + 4) div 5, ({FIFTHS} * nb + 4) div 5) - 1")
    return counted.where(part * F.col("shared") + beyond >= F.expr(f"({FIFTHS} * (na + nb) + {4 + FIFTHS}) div {5 + FIFTHS}"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of the pairs whose texts' sets have the similarity. pairs are stored."""
    sides = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("key"))
    both = texts.join(small(sides, 2 * pairs.count()), "key").select("a", "b", "text").repartition("a", "b").sortWithinPartitions("a", "b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, one = _Hashes(), None, np.empty(0, np.uint64)
        for batch in batches:
            for part in _slices(batch):
                keep = []
                for a, b, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part), strict=True):
                    two = shingle_set(text, hashes)
                    common = len(np.intersect1d(one, two, assume_unique=True)) if at == (a, b) else -1
                    keep.append(common >= least_common(len(one) + len(two)))
                    at, one = (a, b), two
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    return both.mapInArrow(each, "a long, b long")


def links(texts: DataFrame) -> DataFrame:
    """texts(key long, distinct; text), stored -> edges (a, b) that connect exactly what pairs of near copies connect, stored."""
    spark, near = texts.sparkSession, print_pairs(texts)
    with small_batches(spark):
        found = [store(verified(near, texts), "print-links")]
    forget(near)
    common = common_shingles(texts)
    with small_batches(spark):
        every = store(postings(texts, common), "postings")
    sketches, posted = store(every.where("at = 0").select("key", "sketch"), "sketches"), met(every)
    forget(every)
    stars = star_pairs(posted)
    with small_batches(spark):
        found.append(store(verified(stars, texts), "star-links"))
    roots = connected_components(found[0].union(found[1]))
    forget(stars)
    rooted = between_roots(posted, roots, sketches)
    forget(posted, roots, sketches)
    rooted, merged = _merge_hot(rooted, texts)
    found += merged
    pairs = store(all_pairs(rooted), "pairs")
    forget(rooted)
    for take in (*[_nearest] * NEAREST, _likeliest):
        tried = store(take(pairs), "tried")
        found.append(_between(tried, texts))
        merged = connected_components(found[-1])
        before, pairs = pairs, store(_apart(pairs, tried, merged), "apart")
        forget(before, tried, merged)
    found.append(_between(pairs, texts))
    out = store(functools.reduce(DataFrame.union, found), "links")
    forget(pairs, *found)
    return out


def _merge_hot(rooted: DataFrame, texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """rooted, stored, with the roots that are left after each text of a shingle with many was held against the closest of other roots, and the links found so.

    It is repeated while at least half of the closest roots are linked, so their number falls fast; what is missed is left to all_pairs."""
    hot, found = store(rooted.where(F.col("sketch").isNotNull()), "hot"), []
    while True:
        tried = store(closest(hot), "tried")
        held = tried.select("ra", "rb").distinct().count()
        if held:
            found.append(_between(tried, texts))
        forget(tried)
        linked = found[-1].count() if held else 0
        if not linked or 2 * linked < held:
            break
        merged = connected_components(found[-1])
        before, hot = hot, store(_rerooted(hot, merged), "hot")
        forget(before, merged)
    forget(hot)
    if found:
        merged = connected_components(functools.reduce(DataFrame.union, found))
        before, rooted = rooted, store(_rerooted(rooted, merged), "between")
        forget(before, merged)
    return rooted, found


def _rerooted(posted: DataFrame, merged: DataFrame) -> DataFrame:
    now = small(merged.select(F.col("node").alias("root"), F.col("root").alias("now")))
    return posted.join(now, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")


def _nearest(pairs: DataFrame) -> DataFrame:
    """Of each cluster the pair that shares most."""
    best = F.max(F.struct("shared", *[c for c in pairs.columns if c != "shared"])).alias("best")
    return pairs.groupBy("ra").agg(best).union(pairs.groupBy("rb").agg(best)).select("best.*").distinct().select(*pairs.columns)


def _likeliest(pairs: DataFrame) -> DataFrame:
    """Of two clusters the LIKELIEST pairs that share most."""
    place = F.row_number().over(Window.partitionBy("ra", "rb").orderBy(F.desc("shared"), "a", "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= LIKELIEST).drop("place")


def _apart(pairs: DataFrame, tried: DataFrame, merged: DataFrame) -> DataFrame:
    """The pairs of clusters that merged(node, root) leaves apart, without those tried, with their new roots."""
    left = pairs.join(small(tried.select("a", "b")), ["a", "b"], "left_anti")
    for side in ("ra", "rb"):
        left = left.join(small(merged.select(F.col("node").alias(side), F.col("root").alias(f"{side}_now"))), side, "left").withColumn(f"{side}_now", F.coalesce(f"{side}_now", side))
    now = {"ra": F.least("ra_now", "rb_now"), "rb": F.greatest("ra_now", "rb_now")}
    return left.where("ra_now <> rb_now").withColumns(now).select(*pairs.columns)


def _between(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) of roots that some verified pair of their texts links, each once; stored, as pairs are."""
    with small_batches(texts.sparkSession):
        good = store(verified(pairs, texts), "verified")
    out = store(pairs.join(small(good), ["a", "b"], "left_semi").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "met")
    forget(good)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each group of near copies: the row with the smallest id stays (null ids last; ties: any one).

    A group is what is reachable over pairs with the similarity. Null and blank texts are one text. All columns stay as they are."""
    key, row = unique_name(docs, "key"), unique_name(docs, "row")

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([xxhash.xxh64_intdigest(b" ".join(ascii_lower(x).split()), SEED) for x in texts_of(batch, text_col)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, key])

    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())])
    with small_batches(docs.sparkSession):
        stored = store(over_batches(docs, add, schema).withColumn(row, F.monotonically_increasing_id()), "docs")
    narrow = stored.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(id_col).alias("id"))
    best = narrow.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    best = store(best.select("key", "best.*"), "best")
    texts = stored.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(text_col).alias("text"))
    copies = store(narrow.join(best, "row", "left_anti").select("row"), "copies")
    texts = texts.join(small(copies, copies.count()), "row", "left_anti").select("key", "text")
    linked = links(texts)
    components = connected_components(linked)
    roots = components.select(F.col("node").alias("key"), "root")
    keep = best.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min(F.struct("no_id", "id", "row")).alias("best"))
    gone = store(narrow.join(keep.select(F.col("best.row").alias("row")), "row", "left_anti").select(F.col("row").alias(row)), "gone")
    forget(best, copies, linked, components)
    return stored.join(small(gone, gone.count()), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
