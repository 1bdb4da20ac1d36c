"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window of an item's size can only reach the similarity t if it holds at least the share t of the item's n shingles, so it holds one of
any n - ceil(t n) + 1 of them: documents are looked up by the items' rarest ones, so many of each (a lossless filter that keeps common
shingles out of the join). Of the documents and items found so, windows are made at the alignments of the shared shingles, and at every
shared shingle from which a window holds enough of them, in whatever order. Windows and items are fingerprinted; with radius r, r + 1 disjoint blocks of bits are indexed, and fingerprints within the radius agree on a block
at least. Pairs within the radius are verified by multiset Jaccard over shingles. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, store, unique_name

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: At similarity 0.8 some 10 of 64 bits differ, by more than 20 in one of ten thousand pairs.
RADIUS = 20


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: str, size: int) -> Column:
    """Hashes of a words column's shingles, one per start. words: a column's name, so that it isn't computed again per shingle."""
    w = F.col(words)
    made = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    return F.when(F.size(w) >= size, made).otherwise(F.array().cast("array<bigint>"))


def simhash_of(hashes: Column) -> Column:
    """A bit is 1 if set in over half of the hashes."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: 2 * F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) > F.size(hashes))
    return F.conv(F.array_join(F.transform(F.reverse(bits), lambda x: x.cast("int").cast("string")), ""), 2, -10).cast("long")


def blocks_of(fp: Column, radius: int) -> Column:
    """(number, bits) of each of radius + 1 disjoint blocks."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return F.array(*[F.struct(F.lit(k).alias("number"), F.shiftrightunsigned(F.shiftleft(fp, 64 - hi), 64 - hi + lo).alias("bits")) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))])


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def index_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Stored (item_id, item_hash, n_words, size, hashes, fp) for items that have words, repeated ones once; shorter items than a shingle are one shingle."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0").dropDuplicates(["item_id", "words"])
    rows = rows.withColumn("n_words", F.size("words")).withColumn("size", F.least("n_words", F.lit(SHINGLE_WORDS)))
    hashes = F.coalesce(*[F.when(F.col("size") == k, shingles_of("words", k)) for k in range(1, SHINGLE_WORDS + 1)])
    return store(rows.select("item_id", F.xxhash64("words").alias("item_hash"), "n_words", "size", hashes.alias("hashes")).withColumn("fp", simhash_of(F.col("hashes"))), "items")


def rarest(grams: DataFrame, threshold: float) -> DataFrame:
    """(item_id, size, h): of each item as many of its shingles, those that fewest items have, as a similar window can't do without."""
    often = grams.groupBy("size", "h").agg(F.count("*").alias("often"))
    ranked = grams.join(often, ["size", "h"]).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "item_hash").orderBy("often", "h", "at")))
    return ranked.where(F.col("rank") <= F.col("n_hashes") - F.ceil(threshold * F.col("n_hashes") - 1e-9) + 1).select("item_id", "size", "h").distinct()


def starts_of(threshold: float) -> Column:
    """Starts of the windows with as many hits as the similarity takes, from n_words, n_hashes, of and the sorted positions `hits`.

    A window that begins at its first hit, or ends with the text, has the hits of any window before it: no other start can be better."""
    hits, last = F.col("hits"), F.col("of") - F.col("n_words")
    least = F.greatest(F.lit(1), F.ceil(2 * threshold / (1 + threshold) * F.col("n_hashes") - 1e-9).cast("int"))
    full = F.transform(hits, lambda p, i: F.when(F.get(hits, i + least - 1) < p + F.col("n_hashes"), F.greatest(F.lit(0), F.least(p, last))))
    at_end = F.when(F.get(hits, F.size(hits) - least) >= last, F.greatest(F.lit(0), last))
    return F.array_compact(F.concat(full, F.array(at_end)))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """One row for each document and item that match: doc_id, item_id, similarity (of the best window), word_start (its first), n_words, hamming, text_hash.

    Null or empty texts and items match nothing. Items shorter than five words are matched whole, as one shingle. Rows with equal id
    and text give the same rows once. A null doc_id is kept. Empty input on either side: no rows."""
    known = index_items(items, item_id_col, item_text_col)
    sizes = [r["size"] for r in known.select("size").distinct().collect()]  # five at most
    grams = store(known.select("item_id", "item_hash", "n_words", "size", F.size("hashes").alias("n_hashes"), F.posexplode("hashes").alias("at", "h")), "item-grams")
    keys = store(rarest(grams, threshold), "item-keys")
    n_keys = keys.count()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    split = rows.select("doc_id", "text_hash", words_of(F.col("text")).alias("words"))
    found = None
    for size in sizes:
        own = split.select("doc_id", "text_hash", F.explode(shingles_of("words", size)).alias("h"))
        part = own.join(small(keys.where(F.col("size") == size), n_keys), "h").select("doc_id", "text_hash", "item_id")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = split.select("doc_id", "text_hash", F.lit(0).cast("long").alias("item_id")).where("false")
    candidates = store(found.groupBy("doc_id", "text_hash").agg(F.collect_set("item_id").alias("items")), "candidates")
    rows = _of(rows, candidates).dropDuplicates(["doc_id", "text_hash"])
    rows = store(rows.select("doc_id", "text_hash", "items", words_of(F.col("text")).alias("words")), "candidate-words")
    hits = None
    for size in sizes:
        own = rows.select("doc_id", "text_hash", "items", F.size("words").alias("of"), F.posexplode(shingles_of("words", size)).alias("pos", "h"))
        part = own.join(small(grams.where(F.col("size") == size)), "h").where(F.array_contains("items", F.col("item_id")))
        part = part.select("doc_id", "text_hash", "item_id", "n_words", "n_hashes", "of", "pos", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("of") - F.col("n_words"))).alias("start"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = rows.select("doc_id", "text_hash", *[F.lit(0).cast(kind).alias(c) for c, kind in (("item_id", "long"), ("n_words", "int"), ("n_hashes", "int"), ("of", "int"), ("pos", "int"), ("start", "int"))]).where("false")
    # at least the share `threshold` of the item's shingles must be in the document at all
    enough = hits.groupBy("doc_id", "text_hash", "item_id", "n_words", "n_hashes", "of").agg(F.count("*").alias("n"), F.collect_set("start").alias("aligned"), F.sort_array(F.collect_set("pos")).alias("hits")).where(F.col("n") >= threshold * F.col("n_hashes"))
    enough = enough.withColumn("starts", F.array_union("aligned", starts_of(threshold)))
    windows = enough.select("doc_id", "text_hash", "n_words", F.explode("starts").alias("start")).distinct()
    wanted = store(windows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n_words", "start")).alias("windows")), "windows")
    made = _window_rows(_of(rows.drop("items"), wanted)).withColumn("fp", simhash_of(F.col("hashes")))
    made = store(made.withColumn("window", F.monotonically_increasing_id()), "fingerprints")
    pairs = _within_radius(made, known, radius)
    verified = pairs.withColumn("common", overlap(F.col("item_hashes"), F.col("hashes"))).withColumn("similarity", F.col("common") / (F.size("hashes") + F.size("item_hashes") - F.col("common")))
    best = verified.where(F.col("similarity") >= threshold).groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words", "hamming")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.back")).alias("word_start"), F.col("b.n_words").alias("n_words"), F.col("b.hamming").alias("hamming"), "text_hash")


def _of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """rows(doc_id, text_hash, ...) that wanted, stored, has, with its other columns; null ids match."""
    other = wanted.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return rows.join(small(other), match).drop("_id", "_hash")


def _window_rows(picked: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, start, hashes) of the windows of picked(doc_id, text_hash, words, windows), cut from the documents' words."""
    cut = picked.select("doc_id", "text_hash", F.explode(F.transform("windows", lambda w: F.struct(w["n_words"].alias("n_words"), w["start"].alias("start"), F.slice("words", w["start"] + 1, w["n_words"]).alias("words")))).alias("w")).select("doc_id", "text_hash", "w.*")
    hashes = F.coalesce(*[F.when(F.least("n_words", F.lit(SHINGLE_WORDS)) == k, shingles_of("words", k)) for k in range(1, SHINGLE_WORDS + 1)])
    return cut.select("doc_id", "text_hash", "n_words", "start", hashes.alias("hashes"))


def _within_radius(windows: DataFrame, known: DataFrame, radius: int) -> DataFrame:
    """Pairs of windows and items of one size whose fingerprints differ in at most radius bits, found by a common block."""
    left = windows.select("window", "n_words", "fp", F.explode(blocks_of(F.col("fp"), radius)).alias("block"))
    right = known.select("item_id", "n_words", F.col("fp").alias("item_fp"), F.explode(blocks_of(F.col("fp"), radius)).alias("block"))
    n = known.count()
    near = left.join(small(right, n * (radius + 1)), ["n_words", "block"]).withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))).where(F.col("hamming") <= radius)
    near = near.select("window", "item_id", "hamming").distinct()
    return windows.join(near, "window").join(small(known.select("item_id", F.col("hashes").alias("item_hashes")), n), "item_id")


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows in which a benchmark item is found; columns stay as they are."""
    leak_id, leak_hash = unique_name(docs, "leak_id"), unique_name(docs, "leak_hash")
    found = store(leaks(docs, items, id_col, text_col).select(F.col("doc_id").alias(leak_id), F.col("text_hash").alias(leak_hash)).distinct(), "leaks")
    match = F.col(id_col).cast("long").eqNullSafe(F.col(leak_id)) & (F.xxhash64(text_col) == F.col(leak_hash))
    return docs.join(small(found), match, "left_anti")
