"""Repeated passages by sparse enhanced suffix arrays and their common-prefix intervals.

Every string of LENGTH bytes holds an anchor, a position chosen by content alone (the least KEY-gram hash of some window of starts), so
two equal strings have the same anchor at the same place. Suffixes at anchors are sorted group by group (a group: equal KEY-grams), the
common-prefix array is scanned with a stack into its interval tree, and an interval whose members' left extensions differ is a maximal
repeat with all its occurrences; the longest left extension that a member shares with another tells which bytes are repeated.

Only what can matter gets that far: anchors whose KEY-gram occurs once are dropped, and where the whole context of an anchor (all bytes
that a string through it can have) occurs again, as inside copies, the context is repeated and one copy stands for all. A group of more
than FEW different contexts is dealt out before it is scanned: a string that covers a group's common region has at least half of its
further bytes on one side, so each context goes to the group of those that also agree on that many bytes to the right, and to the like
group on the left. The same steps are taken in these groups, with contexts cut to what a string there can still cover, until they are
small or their region is a whole string. So every group is scanned in the same way, whatever its size, and none is one task."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_evenly, mix64, over_batches, partitions_for, store, texts_of

LENGTH = 200
KEY = 50
LEFT = LENGTH - KEY  # bytes before an anchor, and starts in a window less one
#: Different contexts of a group that is scanned in one task: some four megabytes.
FEW = 10_000
#: Bits of a filter at most, 16 MB, and the places that one so large can tell apart; more are found by a join instead.
MOST_BITS = 1 << 27
SIFTED = MOST_BITS >> 3
PIECE, MARGIN = 1 << 17, 512
_RANDOM = np.random.default_rng(7)
BYTES = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
POWERS, INVERSES = (np.cumprod(np.array([1, *[x] * (PIECE + 2 * MARGIN)], np.uint64)) for x in (BASE, pow(BASE, -1, 1 << 64)))
PLACE = np.uint64((1 << 20) - 1)


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, KEY-gram hashes, context hashes). A context is LEFT bytes before and LENGTH from the anchor, less at a text's ends."""
    parts = [_piece(text, lo) for lo in range(0, len(text) - LENGTH + 1, PIECE)]
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    if len(parts) == 1:
        return parts[0]
    pos, key, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
    pos, first = np.unique(pos, return_index=True)
    return pos, key[first], whole[first]


def _piece(text: bytes, lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of strings that start in [lo, lo + PIECE)."""
    base = max(0, lo - MARGIN)
    b = np.frombuffer(text, np.uint8, min(len(text), lo + PIECE + MARGIN) - base, base)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(BYTES[b] * POWERS[: len(b)], out=sums[1:])
    grams = mix64((sums[KEY:] - sums[:-KEY]) * INVERSES[: len(b) - KEY + 1])
    first, last = lo - base, min(len(text) - LENGTH, lo + PIECE - 1) - base  # starts of strings
    span = LEFT + 1
    own = grams[first : last + LEFT + 1]
    placed = (own & ~PLACE) | np.arange(len(own), dtype=np.uint64)
    padded = np.full(-(-len(placed) // span) * span, ~np.uint64(0))
    padded[: len(placed)] = placed
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = last - first + 1
    least = (np.minimum(behind[:n], ahead[LEFT : LEFT + n]) & PLACE).astype(np.int64)
    at = least[np.concatenate(([True], least[1:] != least[:-1]))] + first
    left, right = np.maximum(at - LEFT, 0), np.minimum(at + LENGTH, len(b))
    shape = (at - left) * (LENGTH + 1) + (right - at)
    whole = mix64((sums[right] - sums[left]) * INVERSES[left] + mix64(shape.astype(np.uint64)))
    return at + base, grams[at], whole


def _emit(batch: pa.RecordBatch, pick: Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], np.ndarray]) -> tuple[list, list, list, list, list[bytes]]:
    """For each text: its row, and the picked anchors."""
    found = []
    texts = texts_of(batch)
    k1, k2 = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("k1", "k2"))
    for i, text in enumerate(texts):
        if len(text) >= LENGTH:
            pos, key, whole = anchors(text)
            take = pick(pos, key, whole, k1[i], k2[i])
            if take.any():
                found.append((i, pos[take], key[take], whole[take]))
    return found, k1, k2, texts


class Sieve:
    """A Bloom filter with two bits a key, of a bounded size; it lets too much through when it is full, never too little."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    @staticmethod
    def of(df: DataFrame, key: str) -> Sieve:
        """Of a stored long column. The driver gets its words only, as Arrow columns: 2**21 at most, two numbers each."""
        n = df.count()
        bits = min(MOST_BITS, max(1 << 20, 1 << (16 * n).bit_length()))
        word = lambda shift: F.shiftrightunsigned(F.shiftrightunsigned(key, shift).bitwiseAND(bits - 1), 6)
        bit = lambda shift: F.expr(f"shiftleft(1L, cast(shiftrightunsigned({key}, {shift}) & 63 as int))")
        pairs = df.select(F.explode(F.array(*[F.struct(word(s).alias("w"), bit(s).alias("b")) for s in (0, 32)])).alias("x")).select("x.*")
        got = pairs.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(bits >> 6, np.uint64)
        words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
        return Sieve(words)

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            k = (keys >> np.uint64(shift)) & self.mask
            out &= (self.words[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63))) & np.uint64(1) == 1
        return out


def occurrence(pos: np.ndarray, k1: int, k2: int) -> np.ndarray:
    """One number for an anchor's place."""
    salt = np.uint64((k1 ^ (k2 * 31)) & 0xFFFFFFFFFFFFFFFF)
    return mix64(pos.astype(np.uint64) + mix64(np.array([salt]))[0])


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """Stored (key, window, k1, k2, pos, before, after) of docs(k1, k2, text): anchors whose KEY-gram occurs more than once, and few others."""

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = [anchors(x)[1] for x in texts_of(batch) if len(x) >= LENGTH]
        if not parts:
            return None
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["key", "n"])

    often = store(over_batches(docs.select("text"), keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1"), "keys")
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(often, "key"))

    def places(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, k1, k2, texts = _emit(batch, lambda pos, key, whole, a, b: sieve.value.passes(key))
        if not found:
            return None
        n = [len(x[1]) for x in found]
        pos, key, whole = (np.concatenate([x[j] for x in found]) for j in (1, 2, 3))
        size = np.repeat([len(texts[x[0]]) for x in found], n)
        columns = [key.view(np.int64), whole.view(np.int64), np.repeat(np.array([k1[x[0]] for x in found], np.int64), n), np.repeat(np.array([k2[x[0]] for x in found], np.int64), n), pos, np.minimum(pos, LEFT), np.minimum(size - pos, LENGTH)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "window", "k1", "k2", "pos", "before", "after"])

    # what the sieve lets through by chance has a group of its own, and is dropped with those
    return store(over_batches(docs, places, "key long, window long, k1 long, k2 long, pos long, before long, after long"), "anchors")


def contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted(k1, k2, pos, ...), stored, and the bytes around each place: left, right."""
    schema = "k1 long, k2 long, pos long, left binary, right binary"

    def cuts(found: list[tuple[int, int, bytes, list[int]]]) -> pa.RecordBatch | None:
        rows = [(k1, k2, p, text[max(0, p - LEFT) : p], text[p : p + LENGTH]) for k1, k2, text, places in found for p in places]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["k1", "k2", "pos", "left", "right"]) if rows else None

    if wanted.count() > SIFTED:
        places = wanted.groupBy("k1", "k2").agg(F.collect_set("pos").alias("places"))

        def own(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            return cuts([*zip(*(batch.column(k).to_pylist() for k in (0, 1)), texts_of(batch), batch.column(3).to_pylist(), strict=True)])

        made = over_batches(docs.dropDuplicates(["k1", "k2"]).join(places, ["k1", "k2"]).select("k1", "k2", "text", "places"), own, schema)
        return made.join(wanted, ["k1", "k2", "pos"])

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        k1, k2, pos = (batch.column(k).to_numpy() for k in range(3))
        salt = k1.view(np.uint64) ^ (k2.view(np.uint64) * np.uint64(31))
        return pa.RecordBatch.from_arrays([pa.array(mix64(pos.view(np.uint64) + mix64(salt)).view(np.int64))], names=["key"])

    numbered = store(over_batches(wanted.select("k1", "k2", "pos"), number, "key long"), "places")
    sieve = docs.sparkSession.sparkContext.broadcast(Sieve.of(numbered, "key"))
    forget(numbered)

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, k1, k2, texts = _emit(batch, lambda pos, key, whole, a, b: sieve.value.passes(occurrence(pos, a, b)))
        return cuts([(k1[i], k2[i], texts[i], pos.tolist()) for i, pos, _, _ in found])

    return over_batches(docs, cut, schema).join(wanted, ["k1", "k2", "pos"]).dropDuplicates(["k1", "k2", "pos"])


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in rows), np.uint8).reshape(len(rows), width)


def _shared(matrix: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each row in order with the next one."""
    a, b = matrix[order[:-1]], matrix[order[1:]]
    differ = a != b
    upto = np.where(differ.any(1), differ.argmax(1), matrix.shape[1])
    return np.minimum(upto, np.minimum(sizes[order[:-1]], sizes[order[1:]]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of each interval of the common-prefix tree, by a scan with a stack."""
    stack = [(0, 0)]
    for i, depth in enumerate([*lcp, 0]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, members, left extension of each that another member shares) for each interval that is a maximal repeat.

    Only repeats that some string of `length` bytes can lie in are given."""
    n = len(rights)
    back = [x[::-1] for x in lefts]
    right, left = _matrix(rights, max(1, max(map(len, rights)))), _matrix(back, max(1, max(map(len, back))))
    right_size, left_size = np.array([*map(len, rights)]), np.array([*map(len, back)])
    order = np.array(sorted(range(n), key=rights.__getitem__))
    rank = np.empty(n, np.int64)
    rank[sorted(range(n), key=back.__getitem__)] = np.arange(n)
    for depth, first, last in intervals(_shared(right, right_size, order).tolist()):
        members = order[first : last + 1]
        members = members[np.argsort(rank[members])]
        shared = _shared(left, left_size, members)
        same = shared.min() == left_size[members].max()  # no left extension differs, so the repeat isn't maximal here
        if not same or depth + shared.min() >= length:
            reach = np.maximum(np.concatenate(([0], shared)), np.concatenate((shared, [0])))
            if depth + reach.max() >= length:
                yield depth, members, reach


def _covered(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int, int]]:
    """(member, bytes before, bytes after) that repeat, over all maximal repeats."""
    out = []
    for depth, members, reach in maximal_repeats(lefts, rights):
        for i, r in zip(members.tolist(), reach.tolist(), strict=True):
            if r + depth >= LENGTH:
                out.append((i, r, depth))
    return out


def _scanned(groups: DataFrame) -> DataFrame:
    """groups(key, k1, k2, pos, left, right), no group of more than FEW rows -> spans (k1, k2, start, stop)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            columns = [x.to_pylist() for x in batch.columns]
            out = []
            for row in zip(*columns, strict=True):
                if row[0] != now:
                    out += _spans_of(rows)
                    now, rows = row[0], []
                rows.append(row)
            if out:
                yield _span_batch(out)
        if out := _spans_of(rows):
            yield _span_batch(out)

    spread = groups.select("key", "k1", "k2", "pos", "left", "right").repartition(partitions_for(groups.sparkSession), "key").sortWithinPartitions("key")
    return spread.mapInArrow(scan, "k1 long, k2 long, start long, stop long")


def _spans_of(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    if len(rows) < 2:
        return []
    return [(rows[i][1], rows[i][2], rows[i][3] - before, rows[i][3] + after) for i, before, after in _covered([r[4] for r in rows], [r[5] for r in rows])]


def _span_batch(spans: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*spans, strict=True)], names=["k1", "k2", "start", "stop"])


def _span(before: str | Column, after: str | Column) -> list[Column]:
    before, after = (F.col(x) if isinstance(x, str) else x for x in (before, after))
    return [F.col("k1"), F.col("k2"), (F.col("pos") - before).alias("start"), (F.col("pos") + after).alias("stop")]


def _groups_of(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """rows(key, window, k1, k2, pos), stored -> stored (key, window, n, k1, k2, pos of one copy) of each different context, and stored
    (key, members) of the groups in which a context that occurs once has company."""
    whole = rows.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "pos")).alias("at"))
    whole = store(whole.select("key", "window", "n", "at.*"), name)
    sizes = whole.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("members")).where("least = 1 and members > 1")
    return whole, store(sizes.select("key", "members"), "groups")


def _copied(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """Spans of contexts that occur more than once. A context with a large share of all rows isn't gathered: those few are broadcast."""
    return join_evenly(rows, whole.where("n > 1").select("key", "window", "n"), ["key", "window"], "n").select(*_span("before", "after"))


def _dealt(rows: DataFrame, further: int) -> DataFrame:
    """rows(k1, k2, pos, lo, hi, left, right): a region from lo bytes before a place to hi after it, of LENGTH - further bytes, and what
    strings over it can cover -> the same, and key and window, for the regions longer by half of what is missing, to the right and left."""
    half = -(-further // 2)
    rest = further - half

    def halves(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for k1, k2, pos, lo, hi, left, right in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            for i, j in ((lo, hi + half), (lo + half, hi)):
                before, after = left[max(0, len(left) - i - rest) :], right[: j + rest]
                if len(left) >= i and len(right) >= j and len(before) + len(after) >= LENGTH:
                    region = left[len(left) - i :] + right[:j]
                    key = xxhash.xxh3_64_intdigest(region, i) - (1 << 63)
                    window = xxhash.xxh3_64_intdigest(before + after, len(before) << 20 | len(after)) - (1 << 63)
                    out.append((key, window, k1, k2, pos, i, j, len(before), len(after), before, after))
        kinds = [*[pa.int64()] * 9, pa.binary(), pa.binary()]
        names = ["key", "window", "k1", "k2", "pos", "lo", "hi", "before", "after", "left", "right"]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names) if out else None

    schema = "key long, window long, k1 long, k2 long, pos long, lo long, hi long, before long, after long, left binary, right binary"
    return over_batches(rows.select("k1", "k2", "pos", "lo", "hi", "left", "right"), halves, schema)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (k1, k2, start, stop), with overlaps and repeats, of all bytes in docs(k1, k2, text) that a repeated string covers."""
    found = repeated_anchors(docs)
    whole, groups = _groups_of(found, "contexts")
    spans = _copied(found, whole)
    edges = join_evenly(whole, groups, ["key"], "members").select("k1", "k2", "pos", "key", "members")
    edges = store(contexts(docs, store(edges, "wanted")).withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(KEY).cast("long")}), "edges")
    further = LENGTH - KEY
    while True:
        spans = spans.unionByName(_scanned(edges.where(F.col("members") <= FEW)))
        large = edges.where(F.col("members") > FEW)
        if not further or large.isEmpty():
            return spans
        rows = store(_dealt(large, further).dropDuplicates(["key", "window", "k1", "k2", "pos"]), "dealt")  # a region has several halvings
        further //= 2
        whole, groups = _groups_of(rows, "contexts")
        spans = spans.unionByName(_copied(rows, whole))
        one = rows.join(whole.drop("n"), ["key", "window", "k1", "k2", "pos"], "left_semi")
        edges = store(join_evenly(one, groups, ["key"], "members").select("k1", "k2", "pos", "key", "members", "left", "right", "lo", "hi"), "edges")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if keep_text.

    Null text counts as empty. Texts of under LENGTH bytes keep all; texts of any length are taken whole; bytes may be cut within a
    character. Each of two equal rows is the other's repeat, so both lose all they have, given LENGTH bytes. Empty input: no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k2"))
    spans = repeated_spans(rows.select("k1", "k2", "text")).groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, own in zip(texts_of(batch), batch.column(batch.schema.get_field_index("spans")).to_pylist(), strict=True):
            kept, at, n = [], 0, 0
            stop = -1
            for s in sorted((x["start"], x["stop"]) for x in own or []):
                if s[0] > stop:
                    kept.append(text[at : s[0]])
                    n += 1
                stop = max(stop, s[1])
                at = stop
            rest = b"".join([*kept, text[at:]])
            out.append((len(text), len(text) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
        columns = [pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *columns[: 4 + keep_text]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return over_batches(rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans"), cut, schema)
