"""Periodic runs of words, found on a suffix tree as Stoye and Gusfield do.

The tree is held in arrays: its leaves are the suffixes in sorted order, its inner nodes the intervals of that order that share a prefix, found
by a stack scan over the common prefixes; nodes with many children are read as chains of nodes with two. For each node, of a depth D, the
leaves of its smaller half are listed, and leaf i is held against i + D and i - D: if that one lies in the node's other half, a tandem repeat
of period D ends where it can't be rotated further (a branching one). A word is so listed log2(n) times at most. Each repeat that isn't a
power of a shorter one is rotated left as far as the words agree; all repeats that meet so make one maximal run.

Texts are independent, so nothing is shuffled; a task holds one lot of texts of some LOT words (or one longer text) with its arrays."""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS

#: Words of the texts whose tree is built at once, and leaves that are tested at once.
LOT, LEAVES = 1 << 18, 1 << 20
#: A run's least length, and how many periods it spans at least.
LEAST_LENGTH, LEAST_POWER = 6, 4

Run = tuple[int, int, int]
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def sorted_suffixes(symbols: np.ndarray, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in sorted order, what each shares with the one before), by prefix doubling of the groups that are still open.

    Prefixes are told apart up to the first power of two from `deepest` on; what is shared beyond counts as that power."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[n] = -1
    levels = [rank.copy()]
    open_ = np.nonzero(~(first & np.r_[first[1:], True]))[0]
    width = 1
    while open_.size and width < deepest:
        i = order[open_]
        key = rank[i] * (n + 1) + rank[np.minimum(i + width, n)] + 1
        by = np.argsort(key, kind="stable")
        i, key = i[by], key[by]
        order[open_] = i
        first = np.r_[True, key[1:] != key[:-1]]
        rank[i] = np.maximum.accumulate(np.where(first, open_, 0))
        open_ = open_[~(first & np.r_[first[1:], True])]
        width *= 2
        levels.append(rank.copy())
    shared = np.zeros(n, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        left, right = np.minimum(order[:-1] + shared[1:], n), np.minimum(order[1:] + shared[1:], n)
        shared[1:] += (levels[k][left] == levels[k][right]) * (1 << k)
    return order, shared


def halves(shared: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Rows (from, split, to, depth): a node's leaves in sorted order are from:split and split:to. `wanted` are the splits to be given."""
    out, stack = [], []
    depths = shared.tolist()
    low: dict[int, int] = {}
    at = np.nonzero(shared > 0)[0]
    gaps = np.nonzero(np.diff(at) > 1)[0]
    asked = wanted.tolist()
    for own in np.split(at, gaps + 1):
        if not own.size:
            continue
        begin, end = int(own[0]) - 1, int(own[-1]) + 1
        for k in own.tolist():
            depth = depths[k]
            while stack and depths[stack[-1]] >= depth:
                top = stack.pop()
                if asked[top]:
                    out.append((low[top], top, k, depths[top]))
            low[k] = stack[-1] if stack else begin
            stack.append(k)
        out += [(low[top], top, end, depths[top]) for top in stack if asked[top]]
        stack.clear()
        low.clear()
    return np.array(out, np.int64).reshape(-1, 4)


def branching_repeats(order: np.ndarray, nodes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of the tandem repeats that can't be rotated to the right, in blocks of some LEAVES listed leaves."""
    n = len(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    start, split, end, depth = nodes.T
    left_is_less = split - start <= end - split
    less_from, less_to = np.where(left_is_less, start, split), np.where(left_is_less, split, end)
    more_from, more_to = np.where(left_is_less, split, start), np.where(left_is_less, end, split)
    sizes = less_to - less_from
    behind = np.r_[0, np.cumsum(sizes)]
    for at in range(0, int(behind[-1]), LEAVES):
        listed = np.arange(at, min(at + LEAVES, behind[-1]))
        node = np.searchsorted(behind, listed, "right") - 1
        leaf = order[less_from[node] + listed - behind[node]]
        for step in (depth[node], -depth[node]):
            other = leaf + step
            inside = (other >= 0) & (other < n)
            where = place[np.where(inside, other, 0)]
            found = np.nonzero(inside & (where >= more_from[node]) & (where < more_to[node]))[0]
            yield np.minimum(leaf[found], other[found]), depth[node[found]]


def rotations(symbols: np.ndarray, start: int, period: int) -> int:
    """How many times the repeat at start can be rotated to the left: words before it that equal those a period on."""
    at, size = start, 16
    while at > 0:
        a = max(0, at - size)
        differ = np.nonzero(symbols[a:at] != symbols[a + period : at + period])[0]
        if differ.size:
            return start - (a + int(differ[-1]) + 1)
        at, size = a, size * 2
    return start


def maximal_runs(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> list[list[Run]]:
    """For each text's words its runs (start, length, period) by start, then period. Each text has symbols of its own, so no prefix is shared
    between texts and no run leaves its text."""
    begins = np.r_[0, np.cumsum([len(x) for x in texts])].astype(np.int64)
    n = int(begins[-1])
    out: list[list[Run]] = [[] for _ in texts]
    if not n:
        return out
    symbols = np.empty(n, np.int64)
    for words, a in zip(texts, begins.tolist()):
        seen: dict[bytes, int] = {}
        symbols[a : a + len(words)] = np.fromiter(map(seen.setdefault, words, itertools.count(a)), np.int64, len(words))
    lengths = np.diff(begins)
    order, shared = sorted_suffixes(symbols, int(lengths.max()) // least_power + 1)
    room = np.repeat(lengths, lengths)[order] // least_power
    nodes = halves(shared, (shared > 0) & (shared <= room))
    ends: dict[int, set[int]] = defaultdict(set)
    for start, period in branching_repeats(order, nodes):
        more = (start > 0) & (symbols[start - 1] == symbols[start - 1 + period]) | (least_power == 2)  # else it is just two periods long
        for s, p in zip(start[more].tolist(), period[more].tolist()):
            ends[s + 2 * p].add(p)
    for end, periods in ends.items():
        roots: list[tuple[int, int]] = []
        for p in sorted(periods):
            if any(p % q == 0 and 2 * p <= length for q, length in roots):
                continue  # a power of a shorter root
            length = 2 * p + rotations(symbols, end - 2 * p, p)
            roots.append((p, length))
            if length >= max(least_length, least_power * p):
                t = int(np.searchsorted(begins, end - 1, "right")) - 1
                out[t].append((end - length - int(begins[t]), length, p))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return [w for w, inside in zip(words, np.cumsum(steps).tolist()) if not inside]


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_power: int = LEAST_POWER) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, runs (start and length in words, smallest period; by start, then period), collapsed (the
    words outside the runs' repetitions, joined by one space).

    least_power is 2 or more. Null and blank texts: no words, no runs, an empty collapsed text. Whole texts, however long. Repeated rows give repeated
    results, null ids stay null; an empty table gives no rows; other columns aren't read, whatever their names."""
    if least_power < 2:
        raise ValueError("a run spans at least two periods")

    def of_lot(ids: list[int | None], lot: list[list[bytes]]) -> pa.RecordBatch:
        found = maximal_runs(lot, least_length, least_power)
        runs = pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in found], pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")])))
        kept = pa.array([b" ".join(collapse(words, x)).decode() for words, x in zip(lot, found)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(x) for x in lot], pa.int64()), runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lot, held = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or "").encode().split()
                ids.append(i)
                lot.append(words)
                held += len(words)
                if held >= LOT:
                    yield of_lot(ids, lot)
                    ids, lot, held = [], [], 0
            if ids:
                yield of_lot(ids, lot)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, FOUND)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents, of which those with crc32(doc_id) divisible by ten (never null ids) repeat a stretch of words to the end.

    With h the CRC, g = h // 10 and n words, word i from a = g % n on becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8)."""

    def words() -> Column:
        return F.filter(F.split("text", f"{SPACE_CLASS}+"), lambda w: w != "")

    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("*", h.alias("h"), F.when(h % 10 == 0, F.size(words())).alias("n"))
    g, n = F.expr("h div 10"), F.col("n").cast("long")
    marked = marked.select("*", F.when(n > 0, g % n).alias("a"), (3 + g % 8).alias("parts"))
    a = F.col("a")
    marked = marked.select("*", F.expr("1 + (n - a) div parts").alias("p"))
    block = F.slice(words(), (a + 1).cast("int"), F.col("p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(block, F.expr("cast((n - a + p - 1) div p as int)"))), F.lit(1), (n - a).cast("int"))
    repeated = F.concat(F.slice(words(), F.lit(1), a.cast("int")), again)
    return marked.select("doc_id", F.when(a.isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """Digest of the runs of the planted documents: doc_id, n_runs, then of the longest run (ties: first start, then smallest period; nulls
    where there is none) start, length, period and exponent_milli, and SHA-256 of the list of runs and of the collapsed text.

    Nulls, blanks, repeats and empty tables as in `find_runs`; a null id is never planted."""
    found = find_runs(planted(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
