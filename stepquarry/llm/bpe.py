"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Encoding emits a token once nothing that follows can change it. How far that is depends on the merge list alone and is computed from it:
a merge (x, y) can be undone from the right only by an earlier merge of a suffix of y with what follows, which in turn only by an
earlier one still, so the longest such chain bounds the lookahead (cf. Berglund and van der Merwe 2023). The buffer holds the lookahead
and one stretch of input, whatever the word's length. Decoding is a state machine over the tokens' bytes that holds back incomplete
characters. Both go on piece by piece through a text and feed running hashes, so beside the text itself, which is a row's value, a task
holds a piece of some PIECE characters (more only where a text has no white space for so long) and the bounded caches of chunks."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
import weakref
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, small_batches, store

#: Symbols that the transducer takes in beyond the lookahead before it encodes again.
STRETCH = 256
#: Characters of a text that are taken in at once, and from how many on a chunk's tokens are hashed as they come.
PIECE, LONG = 1 << 16, 1 << 12
#: Results kept by white-space separated chunk, per worker and generation, and the longest chunk that is kept.
CACHED = 150_000
CACHED_CHARS = 64
#: Texts handed to Python at once.
BATCH = 256
#: Fewer symbols than this are merged without a heap.
FEW = 32
#: The pre-tokenizer's pattern, on lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next from code point 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary and merge list, with the lookahead that suffices for it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.vocab, self.end = vocab, end
        self.ranks = {pair: k for k, pair in reversed([*enumerate(merges)])}
        self.lookahead = self._sufficient_lookahead(merges)

    def _length(self, token: str) -> int:
        return len(token.removesuffix(self.end)) or 1

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        reach: dict[str, int] = {}  # by left token: how far earlier merges of it depend on what follows
        spine: dict[str, frozenset[str]] = {}  # tokens that end where the token ends
        most = 1
        for x, y in merges:
            ends = spine.setdefault(y, frozenset([y]))
            own = self._length(y) + max((reach[u] for u in ends if u in reach), default=0)
            most = max(most, own)
            reach[x] = max(reach.get(x, 0), own)
            made = x + y
            spine[made] = spine.get(made, frozenset([made])) | ends
        return most

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges in order of rank, leftmost first, over symbols that are held at once."""
        n = len(symbols)
        if n < FEW:
            return self._merge_few(symbols)
        ranks, after, before, live = self.ranks, [*range(1, n), -1], [*range(-1, n - 1)], list(symbols)
        heap = [(r, i, live[i], live[i + 1]) for i in range(n - 1) if (r := ranks.get((live[i], live[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if live[i] != x or j < 0 or live[j] != y:
                continue
            live[i], live[j] = x + y, None
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((live[i], live[k]))) is not None:
                    heapq.heappush(heap, (r, i, live[i], live[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((live[h], live[i]))) is not None:
                heapq.heappush(heap, (r, h, live[h], live[i]))
        return [x for x in live if x is not None]

    def _merge_few(self, symbols: list[str]) -> list[str]:
        """As merge, without a heap."""
        get, none, held = self.ranks.get, len(self.ranks), list(symbols)
        ranks = [get(p, none) for p in zip(held, held[1:])]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            held[i] += held.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get((held[i - 1], held[i]), none)
            if i < len(ranks):
                ranks[i] = get((held[i], held[i + 1]), none)
        return held

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one word, each as soon as it is stable. Holds STRETCH + lookahead symbols and the longest token at most."""
        held: list[str] = []
        fill = STRETCH + self.lookahead
        for s in symbols:
            held.append(s)
            if len(held) >= fill:
                at, stable = 0, len(held) - self.lookahead
                for token in self.merge(held):
                    if at + self._length(token) > stable:
                        break
                    at += self._length(token)
                    yield token
                held = held[at:]
                fill = max(STRETCH + self.lookahead, len(held) + STRETCH)
        yield from self.merge(held)



class Decoder:
    """Ids to text, a token at a time: `feed` returns what is certain, `close` the rest; bytes that are no UTF-8 become U+FFFD.

    Joined, as a tokenizer file without a decoder has it, tokens' names follow each other with a space between. Else names stand for
    bytes, and a space follows a word's end."""

    def __init__(self, names: dict[int, str], special: set[int], end: str = "</w>", joined: bool = False):
        self.names, self.special, self.end, self.joined = names, special, end, joined
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def feed(self, token: int) -> str:
        name = self.names[token]
        if self.joined:
            out = f" {name}" if self.begun else name
            self.begun = True
            return out
        if token in self.special:
            return self.state.decode(b"", True) + name
        word_ends = name.endswith(self.end)
        data = bytes(self.bytes_of[c] for c in name.removesuffix(self.end))
        out = self.state.decode(data)
        return out + self.state.decode(b"", True) + " " if word_ends else out

    def close(self) -> str:
        self.begun = False
        return self.state.decode(b"", True)


class Tokenizer:
    """The parts of a tokenizer file that decide its ids: special tokens, NFC, lower case, words, bytes, merges."""

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.names = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.symbols = byte_symbols()
        self.decoder = Decoder(self.names, set(self.special.values()), self.merges.end, joined=d.get("decoder") is None)
        self.between = b" " if self.decoder.joined else b""
        self.stops = not any(set(".,") & set(x) for x in self.special)
        self.cache = _Cache(self)

    def _symbols(self, word: str) -> Iterator[str]:
        """A word's bytes as characters, lazily; the last one carries the mark of a word's end. ASCII words stand for themselves."""
        data = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode()))
        yield from itertools.islice(data, len(data) - 1)
        yield data[-1] + self.merges.end

    def _tokens(self, word: str) -> Iterable[str]:
        """A word's tokens; a short word is held at once, as the stream would hold it."""
        symbols = self._symbols(word)
        return self.merges.merge([*symbols]) if len(word) < STRETCH // 4 else self.merges.stream(symbols)

    def chunk_ids(self, chunk: str) -> Iterator[int]:
        """Ids of a chunk without white space."""
        vocab = self.merges.vocab
        for part in self.split_special.split(chunk) if self.split_special and "<" in chunk else [chunk]:
            if part in self.special:
                yield self.special[part]
            elif part:
                lower = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                for word in self.words.finditer(lower):
                    for token in self._tokens(word[0]):
                        yield vocab[token]

    def decoded(self, ids: Iterable[int]) -> str:
        """As the file's decoder gives it, from the state machine, which for joined names is in no state between two lots."""
        if self.decoder.joined:
            return " ".join(map(self.names.__getitem__, ids))
        return "".join(map(self.decoder.feed, ids)) + self.decoder.close()

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The text's chunks without white space, in lots of some PIECE characters."""
        at = 0
        while at < len(text):
            stop = len(text)
            if stop - at > PIECE and (space := self.spaces.search(text, at + PIECE)):
                stop = space.start()
            part = text[at:stop] if at or stop < len(text) else text
            yield [c for c in (self.spaces.split(part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()) if c]
            at = stop

    def encode(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, their decoded text in UTF-8) bit by bit; self.between stands between two bits' texts."""
        for chunks in self.pieces(text):
            if max(map(len, chunks), default=0) < LONG:
                yield self._joined([self.cache[c] for c in chunks])
                continue
            for long, some in itertools.groupby(chunks, lambda c: len(c) >= LONG):
                if not long:
                    yield self._joined([self.cache[c] for c in some])
                    continue
                for c in some:
                    ids = self.chunk_ids(c)
                    while part := list(itertools.islice(ids, LONG)):
                        yield b"".join([i.to_bytes(4, "little") for i in part]), self.decoded(part).encode()

    def _joined(self, found: list[tuple[bytes, bytes]]) -> tuple[bytes, bytes]:
        return b"".join([x[0] for x in found]), self.between.join([x[1] for x in found if x[0]])

    def digest(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids, SHA-256 of the decoded text), hashed as they come."""
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()
        for ids, decoded in self.encode(text):
            if ids:
                if n:
                    text_hash.update(self.between)
                n += len(ids) // 4
                ids_hash.update(ids)
                text_hash.update(decoded)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()


class _Cache(dict):
    """Results by chunk, in two generations: when the young one is full it becomes the old one, whose entries come back when asked for."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.old = weakref.proxy(tokenizer), {}

    def __missing__(self, chunk: str) -> tuple[bytes, bytes]:
        if chunk[-1] in ".," and len(chunk) > 1 and chunk[-2] < "\u0250" and chunk[-2].isalnum() and self.tokenizer.stops:  # a word apart, never kept twice
            (ids, text), (stop, mark) = self[chunk[:-1]], self[chunk[-1]]
            return ids + stop, text + self.tokenizer.between + mark
        if (out := self.old.get(chunk)) is None:
            ids = list(self.tokenizer.chunk_ids(chunk))
            out = b"".join([i.to_bytes(4, "little") for i in ids]), self.tokenizer.decoded(ids).encode()
        if len(chunk) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[chunk] = out
        return out


def tokenizer_for(definition: Broadcast) -> Tokenizer:
    """One for each worker process and broadcast definition: the tables and the cache outlive a task, but not the query, as Spark drops a worker's
    broadcasts when a task comes that doesn't use them."""
    if (known := getattr(definition, "_tokenizer", None)) is None:
        known = definition._tokenizer = Tokenizer(definition.value)
    return known


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, ids_sha256 (ids as little-endian 32-bit integers), decoded_sha256.

    Null text counts as empty: no tokens, the hashes of nothing. Texts of any length are encoded whole. Repeated rows give repeated
    results; empty input: no rows; other columns aren't read. Results are stored, so that BATCH texts go to Python at once. The file is read by the driver and broadcast (some megabytes, whatever the input)."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = tokenizer_for(definition)
        n, ids, decoded = zip(*[tokenizer.digest(x or "") for x in batch.column(1).to_pylist()], strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession, BATCH):
        return store(over_batches(narrow, encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"), "tokens")


def tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs and an array column of ids; all other columns stay."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    @F.udf("array<int>", useArrow=True)
    def ids(text: str | None) -> list[int]:
        data = b"".join([x[0] for x in tokenizer_for(definition).encode(text or "")])
        return [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]

    return docs.withColumn(out_col, ids(F.col(text_col)))


def texts(rows: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows and the text of their ids by the incremental decoder; a space follows each word's end. Null ids: empty text."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.udf("string", useArrow=True)
    def text(ids: list[int] | None) -> str:
        t = tokenizer_for(definition)
        d = Decoder(t.names, set(t.special.values()), t.merges.end)
        return "".join([*map(d.feed, [] if ids is None else [int(i) for i in ids]), d.close()])

    return rows.withColumn(out_col, text(F.col(ids_col)))
