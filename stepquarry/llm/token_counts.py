"""Token counts of every prefix, for merge vocabularies in a sentencepiece model.

A sequence of pieces is what the merges make of its text if, and only if, each two neighbours are what the merges make of these two. So a prefix's
last piece is the one piece that ends there and may follow the last piece of the prefix before it, and its count is that prefix's count and
one: dynamic programming over a text, with no prefix encoded twice. Pieces hold a space mark at their beginning only, which the
vocabulary is checked for, so stretches between spaces are counted by themselves, and those that were seen are looked up.

Texts are independent, so nothing is shuffled. The model's pieces are broadcast (under a megabyte, whatever the input)."""

from __future__ import annotations

import functools
import itertools
import json
import math
import operator
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Stretches whose counts are kept in a worker (twice as many, as the older half is only dropped when the younger is full), the longest one
#: that is kept, and pairs of pieces that are.
CACHED, CACHED_CHARS, CACHED_PAIRS = 200_000, 64, 2_000_000
#: Bits of a piece's number; unknown characters have numbers beyond the pieces'.
NUMBER_BITS = 22
#: Prefixes of a batch that goes back to Spark, more only for a single text.
BATCH = 1 << 21
#: The limit of the query.
LIMIT = 4096

STRETCH = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def definition(model_path: str) -> str:
    """The normal pieces with their scores, and whether unknown characters become bytes, as JSON. Models with anything that the counts don't
    cover are an error: a normalizer, pieces of users, merges across spaces."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(model_path, "rb") as file:
        model.ParseFromString(file.read())
    kinds = proto.ModelProto.SentencePiece
    pieces = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
    spec, trainer = model.normalizer_spec, model.trainer_spec
    covered = trainer.model_type == proto.TrainerSpec.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    covered &= spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap
    covered &= {p.type for p in model.pieces} <= {kinds.NORMAL, kinds.UNKNOWN, kinds.CONTROL, kinds.BYTE}
    if not covered or any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError("the counts are for merge models with byte fallback, no normalizer and no pieces across spaces")
    return json.dumps(pieces)


class PrefixCounter:
    """Pieces that end at a character come from an automaton over all pieces (Aho and Corasick 1975), so only pieces are tried; they go by numbers."""

    def __init__(self, pieces: dict[str, float]):
        self.scores = pieces
        self.names = ["", *pieces]
        self.tokens = [0, *[1] * len(pieces)]
        self.unknown: dict[str, int] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self._automaton()

    def _automaton(self) -> None:
        """next: by state and character; ending: (length, number) of the pieces that end in a state, the longest first."""
        self.next: list[dict[str, int]] = [{}]
        own, depth = [0], [0]
        for number, name in enumerate(self.names[1:], 1):
            at = 0
            for c in name:
                if (to := self.next[at].get(c)) is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    own.append(0)
                    depth.append(depth[at] + 1)
                at = to
            own[at] = number
        self.shorter, self.kept = [0] * len(own), 0
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        level = [0]
        while level:
            below = [(at, c, to) for at in level for c, to in self.next[at].items()]
            for at, c, to in below:
                link = self.shorter[to] = self._after(self.shorter[at], c) if at else 0
                self.ending[to] = ((depth[to], own[to]), *self.ending[link]) if own[to] else self.ending[link]
            level = [to for _, _, to in below]

    def _after(self, state: int, c: str) -> int:
        while (to := self.next[state].get(c)) is None and state:
            state = self.shorter[state]
        return to or 0

    def step(self, state: int, c: str) -> int:
        """The next state where the trie has none; kept for the next time, CACHED of them at most."""
        to = self._after(self.shorter[state], c)
        if self.kept < CACHED:
            self.kept += 1
            self.next[state][c] = to
        return to

    def merged(self, text: str) -> list[str]:
        """What the merges make of a short text: the best score first, then the leftmost."""
        score, none, out = self.scores.get, -math.inf, list(text)
        scores = [score(x + y, none) for x, y in zip(out, out[1:])]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            out[i] += out.pop(i + 1)
            del scores[i]
            if i:
                scores[i - 1] = score(out[i - 1] + out[i], none)
            if i < len(scores):
                scores[i] = score(out[i] + out[i + 1], none)
        return out

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave piece b after piece a (a 0: alone)."""
        x, y = self.names[a], self.names[b]
        fits = self.merged(x + y) == ([x, y] if a else [y])
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        self.pairs[a << NUMBER_BITS | b] = fits
        return fits

    def unknown_number(self, c: str) -> int:
        """A character that no piece is becomes bytes."""
        if (known := self.unknown.get(c)) is None:
            known = self.unknown[c] = len(self.names)
            self.names.append(c)
            self.tokens.append(len(c.encode()))
        return known

    def steps(self, stretch: str) -> bytes:
        """What each character of the stretch adds to the count, as 16-bit integers; a merge may take several tokens away."""
        if (known := self.young.get(stretch)) is None:
            if (known := self.old.get(stretch)) is None:
                known = self.counted(stretch).tobytes()
            if len(stretch) <= CACHED_CHARS:
                if len(self.young) >= CACHED:
                    self.young, self.old = {}, self.young
                self.young[stretch] = known
        return known

    def counted(self, stretch: str) -> array:
        """The dynamic programme: `last` and `counts` are of the prefixes so far."""
        after, ending, pairs, tokens, state = self.next, self.ending, self.pairs, self.tokens, 0
        last, counts = [0], [0]
        for end, c in enumerate(stretch, 1):
            if (to := after[state].get(c)) is None:
                to = self.step(state, c)
            state = to
            for length, piece in ending[state]:
                before = last[end - length]
                if (fits := pairs.get(before << NUMBER_BITS | piece)) is None:
                    fits = self.may_follow(before, piece)
                if fits:
                    counts.append(counts[end - length] + 1)
                    break
            else:
                if c in self.scores or not self.may_follow(last[-1], piece := self.unknown_number(c)):
                    raise AssertionError(f"no piece of the vocabulary ends at {end} of {stretch!r}")
                counts.append(counts[-1] + tokens[piece])
            last.append(piece)
        return array("h", map(operator.sub, counts[1:], counts))

    def table(self, text: str) -> np.ndarray:
        """The tokens of each of the text's prefixes, from the empty one to the whole text, as the library counts them."""
        if not text:
            return np.zeros(1, np.int32)
        found = STRETCH.finditer(SPACE + text.replace(" ", SPACE))
        parts = []
        while lot := [m[0] for m in itertools.islice(found, 1 << 16)]:
            parts.append(b"".join(map(self.steps, lot)))
        table = np.cumsum(np.frombuffer(b"".join(parts), np.int16), dtype=np.int32)
        table[0] = 0  # no text, no mark before it
        return table


@functools.lru_cache(maxsize=4)
def counter_for(pieces: str) -> PrefixCounter:
    """One for each worker process and model."""
    return PrefixCounter(json.loads(pieces))


def prefix_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), token_counts, whose element k (from 0) is the number of tokens of the text's
    first k code points, as the library counts them without begin and end; strings of special tokens in a text are ordinary text.

    `token_count`, `count_at` and `longest_prefix` answer from this column alone. Null text counts as empty: token_counts is [0]. Whole texts of any
    length (a row holds four bytes a code point). Repeated rows give repeated results, null ids stay null, an empty table gives no rows;
    other columns aren't read. The file is read by the driver."""
    pieces = docs.sparkSession.sparkContext.broadcast(definition(model_path))

    def of_lot(ids: list, sizes: list[int], tables: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, tables)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tables)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "n_bytes", "token_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(pieces.value)
        for batch in batches:
            ids, sizes, tables, held = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                ids.append(i)
                sizes.append(len(text.encode()))
                tables.append(counter.table(text))
                held += len(text) + 1
                if held >= BATCH:
                    yield of_lot(ids, sizes, tables)
                    ids, sizes, tables, held = [], [], [], 0
            if ids:
                yield of_lot(ids, sizes, tables)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, token_counts array<int>")


def token_count(counts: str | Column = "token_counts") -> Column:
    """The whole text's tokens."""
    return F.element_at(counts, -1).cast("long")


def count_at(chars: int | Column, counts: str | Column = "token_counts") -> Column:
    """The tokens of the first `chars` code points; of the whole text if it has fewer."""
    chars = F.lit(chars) if isinstance(chars, int) else chars
    return F.element_at(counts, F.least(F.greatest(chars, F.lit(0)) + 1, F.size(counts)).cast("int")).cast("long")


def longest_prefix(budget: int | Column, counts: str | Column = "token_counts") -> Column:
    """The code points of the longest prefix with at most `budget` tokens (counts may fall as a merge ends, so it is the last such one)."""
    return F.array_max(F.transform(counts, lambda c, k: F.when(c <= budget, k))).cast("long")


def counted(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens), chars_in_limit (the longest prefix's code points within it)."""
    rows, n = prefix_counts(docs, model_path), token_count()
    fits = F.when(n > limit, longest_prefix(limit)).otherwise(F.size("token_counts").cast("long") - 1)
    return rows.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), fits.alias("chars_in_limit"))
