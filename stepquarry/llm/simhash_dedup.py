"""SimHash near-duplicates: a binary trie self-join over 64-bit fingerprints.

The 64 bits are cut into one block more than the error budget, so two fingerprints within the budget agree on a block. There is one
trie for each block, of fingerprints rotated to begin with it, where the first levels have no budget: a fingerprint goes into as many
subtrees as there are blocks, at any input size. Only a subtree of one prefix that is too large is cut deeper; there a fingerprint
goes to its own part and, as a visitor, to each later part that is within the budget of it. A task walks node pairs of a trie
together, adds up differing bits, and drops a pair when they exceed the budget. Equal texts share one fingerprint and are
aggregated before any shuffle of fingerprints, so a large group of copies is one trie entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, mix64, over_batches, partitions_for, store, texts_of, unique_name
from .components import connected_components

SEED = 42
#: A subtree of one prefix is cut if it has more fingerprints than this, or than their number by MOST_LEAVES.
LEAST_LEAF = 1 << 13
MOST_LEAVES = 1 << 14
#: How many fingerprints of small subtrees go into a bucket on average.
BUCKET = 1 << 11
#: Node pairs with no more element pairs than this are compared at once.
SMALL_PRODUCT = 16


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many of the 64-bit words have each bit, least significant first. Adds bit planes in a tree, 64 counters to a word."""
    planes = [words]
    while len(planes[0]) > 1:
        if len(planes[0]) % 2:
            planes = [np.append(p, np.uint64(0)) for p in planes]
        out, carry = [], None
        for p in planes:
            x, y = p[0::2], p[1::2]
            differ = x ^ y
            if carry is None:
                out.append(differ)
                carry = x & y
            else:
                out.append(differ ^ carry)
                carry = (x & y) | (differ & carry)
        planes = [*out, carry]
    shifts = np.arange(64, dtype=np.uint64)
    return sum(((p[0] >> shifts) & np.uint64(1)).astype(np.int64) << k for k, p in enumerate(planes))


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of the text's word shingles, repeats included. Fewer words than a shingle: the whole sequence; none: 0."""
    found = ascii_lower(text).split()
    if not found:
        return 0
    line = b" ".join(found)
    digest, seed = xxhash.xxh64_digest, SEED
    if len(found) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    hashes = np.frombuffer(b"".join([digest(line[a:b], seed) for a, b in zip(starts, stops, strict=True)]), ">u8").astype(np.uint64)
    more = 2 * bit_counts(hashes) > len(hashes)
    return int((more.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def with_fingerprints(df: DataFrame, text: str, name: str, words: int = 3) -> DataFrame:
    """df and a long column with the fingerprint's bits. Null text counts as empty."""

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = np.array([fingerprint(x, words) for x in texts_of(batch, text)], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    return over_batches(df, add, schema)


def cut_trie(prints: DataFrame, heavy: list[tuple[int, int]], leaf_size: int, step_bits: int = 6) -> list[tuple[int, int]]:
    """Cuts the trie's subtrees `heavy`, (prefix, depth) of one depth, into leaves (prefix, depth) of at most leaf_size fingerprints.

    The driver sees counts of prefixes only: at most 2**step_bits for each subtree that is still too large."""
    leaves, depth = [], heavy[0][1] + step_bits
    while heavy:
        counted = prints.select(F.shiftrightunsigned("fp", 64 - depth).alias("p"))
        counted = counted.where(F.shiftright("p", depth - heavy[0][1]).isin([p for p, _ in heavy]))
        counts = {r["p"]: r["n"] for r in counted.groupBy("p").agg(F.count("*").alias("n")).collect()}
        levels = [counts]
        for _ in range(depth - heavy[0][1]):
            up: dict[int, int] = {}
            for p, n in levels[-1].items():
                up[p >> 1] = up.get(p >> 1, 0) + n
            levels.append(up)
        stack, still = [(p, d) for p, d in heavy], []
        while stack:
            p, d = stack.pop()
            n = levels[depth - d].get(p, 0)
            if n and (n <= leaf_size or d >= 64):
                leaves.append((p, d))
            elif n and d < depth:
                stack += [(2 * p, d + 1), (2 * p + 1, d + 1)]
            elif n:
                still.append((p, d))
        heavy, depth = still, min(depth + step_bits, 63 if depth < 63 else 64)
    return sorted(leaves, key=lambda x: x[0] << (64 - x[1]))


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks of the 64 bits, widths equal or one apart, most significant first."""
    edges = [64 * k // (budget + 1) for k in range(budget + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def rotated(prints: np.ndarray, by: int) -> np.ndarray:
    """64-bit words rotated to the left."""
    return (prints << np.uint64(by)) | (prints >> np.uint64(64 - by)) if by % 64 else prints


class _Top:
    """The trie above the leaves."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.kids: list[list[int]] = [[-1, -1]]
        self.leaf: list[int] = [-1]
        for k, (p, d) in enumerate(leaves):
            at = 0
            for i in range(d - 1, -1, -1):
                bit = p >> i & 1
                if self.kids[at][bit] < 0:
                    self.kids[at][bit] = len(self.kids)
                    self.kids.append([-1, -1])
                    self.leaf.append(-1)
                at = self.kids[at][bit]
            self.leaf[at] = k

    def routes(self, prints: np.ndarray, budget: int, free: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, rows, differing bits) for every leaf within the budget of some rows, without a budget in the first `free` bits."""
        stack = [(0, 0, np.arange(len(prints)), np.zeros(len(prints), np.int8))]
        while stack:
            node, depth, rows, errors = stack.pop()
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows, errors
                continue
            bits = (prints[rows] >> np.uint64(63 - depth)) & np.uint64(1)
            for bit in (0, 1):
                if (kid := self.kids[node][bit]) >= 0:
                    e = errors + (bits != bit)
                    if (keep := e <= (budget if depth >= free else 0)).any():
                        stack.append((kid, depth + 1, rows[keep], e[keep]))


def node_pairs_join(left: np.ndarray, right: np.ndarray, budget: int, free: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with left[i] and right[j] within the budget, all of those that agree on their first `free` bits at least.

    Both are sorted and distinct: a range with a common prefix is a trie node."""
    none = np.empty(0, np.int64)
    if not len(left) or not len(right):
        return none, none
    out_i, out_j = [none], [none]
    a_lo, a_hi = np.array([0]), np.array([len(left)])
    b_lo, b_hi = np.array([0]), np.array([len(right)])
    err = np.zeros(1, np.int8)
    for depth in range(65):
        small = (a_hi - a_lo) * (b_hi - b_lo) <= SMALL_PRODUCT
        if depth == 64:
            small[:] = True
        if small.any():
            na, nb = (a_hi - a_lo)[small], (b_hi - b_lo)[small]
            n = na * nb
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a_lo[small][pair] + k // nb[pair], b_lo[small][pair] + k % nb[pair]
            near = np.bitwise_count(left[i] ^ right[j]) <= budget
            out_i.append(i[near])
            out_j.append(j[near])
            rest = ~small
            a_lo, a_hi, b_lo, b_hi, err = a_lo[rest], a_hi[rest], b_lo[rest], b_hi[rest], err[rest]
        if not len(err):
            break
        a_mid, b_mid = _split(left, a_lo, a_hi, depth), _split(right, b_lo, b_hi, depth)
        sides = [(a_lo, a_mid), (a_mid, a_hi)], [(b_lo, b_mid), (b_mid, b_hi)]
        parts = []
        for x, (al, ah) in enumerate(sides[0]):
            for y, (bl, bh) in enumerate(sides[1]):
                e = err + np.int8(x != y)
                live = (al < ah) & (bl < bh) & (e <= (budget if depth >= free else 0))
                parts.append((al[live], ah[live], bl[live], bh[live], e[live]))
        a_lo, a_hi, b_lo, b_hi, err = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.concatenate(out_i), np.concatenate(out_j)


def _split(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the children with bit 1 begin, for nodes that share their first depth bits."""
    bit = np.uint64(1) << np.uint64(63 - depth)
    keep = np.uint64((~((int(bit) << 1) - 1)) & 0xFFFFFFFFFFFFFFFF)
    first = (values[lo] & keep) | bit
    return np.clip(np.searchsorted(values, first), lo, hi)


def _roots(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Smallest label reachable over the edges; label is changed in place."""
    while len(u):
        lu, lv = label[u], label[v]
        open_ = lu != lv
        if not open_.any():
            break
        u, v, lu, lv = u[open_], v[open_], lu[open_], lv[open_]
        low = np.minimum(lu, lv)
        np.minimum.at(label, lu, low)
        np.minimum.at(label, lv, low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label[:] = jump
    return label


def heavy_parts(prints: DataFrame, budget: int, leaf_size: int) -> list[list[tuple[int, int]]]:
    """For each block, the leaves (prefix, depth) of its trie's subtrees with more than leaf_size fingerprints of one block value.

    The counts have at most the blocks' values as groups, whatever the input, and are combined before the shuffle; the driver sees only
    the groups over leaf_size, and there are at most MOST_LEAVES of them for each block."""
    parts = blocks(budget)
    turned = [F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp") for at, _ in parts]
    values = F.array(*[F.shiftrightunsigned(x, 64 - width) for x, (_, width) in zip(turned, parts, strict=True)])
    heavy = prints.select(F.posexplode(values).alias("block", "p")).groupBy("block", "p").agg(F.count("*").alias("n")).where(F.col("n") > leaf_size).collect()
    out = []
    for k, (_, width) in enumerate(parts):
        found = [(r["p"], width) for r in heavy if r["block"] == k]
        out.append(cut_trie(prints.select(turned[k].alias("fp")), found, leaf_size) if found else [])
    return out


def links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """prints(fp long, distinct) -> edges (a, b) that connect exactly what pairs within the budget connect.

    Within a subtree a task emits a spanning forest, not all pairs; no link is lost, as connection is all that is asked."""
    count = prints.count()
    if not count:
        return prints.selectExpr("fp as a", "fp as b")
    leaf_size = max(LEAST_LEAF, -(-count // MOST_LEAVES))
    parts, buckets = blocks(budget), -(-count // BUCKET)
    leaves = heavy_parts(prints, budget, leaf_size)
    shared = prints.sparkSession.sparkContext.broadcast(leaves)  # at most some MOST_LEAVES pairs of numbers for each block, at any input

    def named(rows: np.ndarray, block: int, leaf: np.ndarray, visits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(leaf * len(parts) + block), pa.array(visits), pa.array(rows.view(np.int64))], names=["leaf", "visitor", "fp"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [_Top(x) for x in shared.value]
        heavy = [np.unique(np.array([p >> (depth - width) for p, depth in x], np.uint64)) for x, (_, width) in zip(shared.value, parts, strict=True)]
        for batch in batches:
            plain = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for block, (at, width) in enumerate(parts):
                fps = rotated(plain, at)
                prefix = fps >> np.uint64(64 - width)
                large = np.isin(prefix, heavy[block])
                small = ~large
                yield named(fps[small], block, (mix64(prefix[small]) % np.uint64(buckets)).astype(np.int64), np.zeros(small.sum(), bool))
                yield from visits(fps[large], block, tops[block])

    def visits(fps: np.ndarray, block: int, top: _Top) -> Iterator[pa.RecordBatch]:
        """Fingerprints of large subtrees, each to its own part and to later ones within the budget."""
        own = np.full(len(fps), -1)
        found = list(top.routes(fps, budget, parts[block][1])) if len(fps) else []
        for leaf, rows, errors in found:
            own[rows[errors == 0]] = leaf
        for leaf, rows, _ in found:
            visit = own[rows] < leaf
            take = visit | (own[rows] == leaf)
            if take.any():
                yield named(fps[rows[take]], block, np.full(take.sum(), buckets + leaf), visit[take])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for leaf, visitor, home, fps in _runs(batches):
            at, width = parts[leaf % len(parts)]
            if not visitor:
                label = np.arange(len(home))
                for k in range(0, len(home), LEAST_LEAF):
                    i, j = node_pairs_join(home[k : k + LEAST_LEAF], home, budget, width)
                    _roots(len(home), i + k, j, label)
                yield from _edges(rotated(home, 64 - at), rotated(home[label], 64 - at))
            else:
                fps = np.sort(fps)
                i, j = node_pairs_join(fps, home, budget, width)
                found = np.unique(np.stack([fps[i], home[label[j]]], 1), axis=0) if len(i) else np.empty((0, 2), np.uint64)
                yield from _edges(rotated(found[:, 0], 64 - at), rotated(found[:, 1], 64 - at))

    routed = prints.select("fp").mapInArrow(route, "leaf long, visitor boolean, fp long")
    n = max(partitions_for(prints.sparkSession), min(len(parts) * buckets // 8, 1 << 15))
    return routed.repartition(n, "leaf").sortWithinPartitions("leaf", "visitor").mapInArrow(join, "a long, b long")


def _edges(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
    if (differ := x != y).any():
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(z[differ]).view(np.int64)) for z in (x, y)], names=["a", "b"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(leaf, False, home, home) once for each leaf when its own fingerprints are complete, then (leaf, True, home, visitors) for each batch of visitors."""
    leaf, parts, home = None, [], None
    for batch in batches:
        ids, visits, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        fps = fps.view(np.uint64)
        edges = np.flatnonzero((ids[1:] != ids[:-1]) | (visits[1:] != visits[:-1])) + 1
        for lo, hi in zip([0, *edges], [*edges, len(ids)], strict=True):
            if ids[lo] != leaf:
                if parts:
                    yield int(leaf), False, (h := np.sort(np.concatenate(parts))), h
                leaf, parts, home = ids[lo], [], None
            if visits[lo]:
                if home is None:
                    home = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                    parts = []
                    yield int(leaf), False, home, home
                yield int(leaf), True, home, fps[lo:hi]
            else:
                parts.append(fps[lo:hi])
    if parts:
        yield int(leaf), False, (h := np.sort(np.concatenate(parts))), h


def near_duplicates(rows: DataFrame, key: str, fp: str, budget: int = 2) -> DataFrame:
    """rows(key long, fp long), stored -> (fp, least): the smallest key reachable from each fingerprint over links within the budget.

    Null keys are ignored for the smallest, which is null where all are null. Equal fingerprints count as linked."""
    known = store(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "prints")
    roots = connected_components(links(known.select("fp"), budget)).select(F.col("node").alias("fp"), "root")
    placed = known.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = placed.join(roots.select("root").distinct(), "root", "left_semi")
    least = linked.groupBy("root").agg(F.min("least").alias("all_least"))
    return placed.join(least, "root", "left").select("fp", F.coalesce("all_least", "least").alias("least"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null or blank text: fingerprint zero, linked like any other. Repeated rows are kept. A null id takes part; component_id is
    null only where a component has no other. Empty input: no rows. Other columns aren't read."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = store(with_fingerprints(narrow, "text", "fp", words).select("doc_id", "fp"), "simhash")
    least = near_duplicates(prints, "doc_id", "fp", budget)
    return prints.join(least, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("least").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """docs without all but one row of each near-duplicate group: the row with the smallest id stays (null ids last; ties: any one).

    All columns stay as they are."""
    fp, row = unique_name(docs, "fp"), unique_name(docs, "row")
    stored = store(with_fingerprints(docs, text_col, fp, words).withColumn(row, F.monotonically_increasing_id()), "docs")
    narrow = stored.select(F.col(fp).alias("fp"), F.col(row).alias("row"), F.col(id_col).alias("id"))
    best = narrow.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best"))
    best = store(best.select("fp", "best.*"), "best")
    roots = connected_components(links(best.select("fp"), budget)).select(F.col("node").alias("fp"), "root")
    keep = best.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("no_id", "id", "row")).alias("best"))
    return stored.join(keep.select(F.col("best.row").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
