"""Hidden Markov language model: Baum-Welch with counts aggregated across partitions, exact likelihood by the scaled forward recursion.

States emit symbols, and a symbol emits a word: the commonest words have a symbol each, the next ones share some, all other words and
unknown ones share the last (`rare`). So the states' table is of a fixed size whatever the vocabulary, and probabilities of all words
still sum to one: p(word) = p(symbol | state) * (c + 1) / (sum of c + 1 over the symbol's words). With one state and no training this is
the add-one unigram model. Words are 64-bit hashes; counts of rare words are joined, not broadcast."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, over_batches, store, texts_of

STATES = 8
ITERATIONS = 4
#: The states begin as texts that are far from each other: of so many training texts (by hash), so many first symbols each. It decides
#: where the training sets out from, not what it counts.
FIRST_TEXTS, FIRST_SYMBOLS = 256, 4096
#: Symbols: OWN for one word each, SHARED for the rest of the head, one for the end, one for all rare and unknown words.
OWN, SHARED = 3072, 1024
#: Words with a symbol other than `rare`; their table, of 16 bytes each, is all that is broadcast.
HEAD = 1 << 18
#: Tokens of a text that are worked on at once, and how many such pieces; what a piece is entered with and followed by comes from the others.
PIECE = 2048
PIECES_AT_ONCE = 256
#: Tokens' worth of the unigram distribution that every state's emissions are smoothed with.
SMOOTHING = 1000.0
END_WORD = b"\n"  # no word holds white space
FOLDS, HELD_OUT = 7, 2


@dataclass
class Vocabulary:
    hashes: np.ndarray  # of head words, sorted
    counts: np.ndarray
    symbols: np.ndarray
    within: np.ndarray  # log10 p(word | symbol)
    tokens: int  # N
    words: int  # V
    base: np.ndarray  # p(symbol) under the add-one unigram model
    rare_mass: int  # sum of c + 1 over rare words, plus 1 for the unknown one

    @property
    def rare(self) -> int:
        return len(self.base) - 1

    @property
    def total(self) -> int:
        return self.tokens + self.words + 1


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), ">u8").astype(np.uint64).view(np.int64)


def held_out(doc_id: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def count_words(docs: DataFrame) -> DataFrame:
    """(h, n) over docs(text): tokens, each text's end included. Added up within a batch before the shuffle."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for x in texts_of(batch):
            seen.update(ascii_lower(x).split())
        seen[END_WORD] = batch.num_rows
        return pa.RecordBatch.from_arrays([pa.array(hashes_of(list(seen))), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])

    return over_batches(docs, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the stored counts. The driver sees a histogram of counts, in steps of a sixteenth of a power of two, and HEAD words at most."""
    step = F.floor(16 * F.log2("n")).cast("int")
    steps = sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens")).collect(), key=lambda r: -r["s"])
    taken, lowest = 0, None
    for r in steps:
        if taken + r["words"] > HEAD:
            break
        taken, lowest = taken + r["words"], r["s"]
    head = counts.where(step >= lowest).toPandas() if lowest is not None else counts.limit(0).toPandas()
    head = head.sort_values(["n", "h"], ascending=[False, True])
    h, n = head["h"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    end = hashes_of([END_WORD])[0]
    rank = np.arange(len(h))
    symbols = np.where(rank < OWN, rank, OWN + 1 + (h.view(np.uint64) % np.uint64(SHARED)).astype(np.int64))
    symbols[h == end] = OWN
    tokens, words = sum(r["tokens"] for r in steps), sum(r["words"] for r in steps)
    mass = np.bincount(symbols, n + 1, OWN + SHARED + 2).astype(np.float64)
    rare = int(tokens - n.sum() + words - len(n) + 1)
    mass[-1] = rare
    order = np.argsort(h)
    within = np.log10((n + 1) / mass[symbols]) if len(h) else np.empty(0)
    return Vocabulary(h[order], n[order], symbols[order].astype(np.int16), within[order], tokens, words, mass / mass.sum(), rare)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs(row, doc_id, held_out, text) -> symbols of each text and its end, sums over head words, and the rare words with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = shared.value
        ids: dict[bytes, int] = {END_WORD: 0}
        number, parts, lengths = ids.setdefault, [], []
        for x in texts_of(batch):
            words = ascii_lower(x).split()
            parts += [number(w, len(ids)) for w in words]
            parts.append(0)
            lengths.append(len(words) + 1)
        h = hashes_of(list(ids))
        at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
        known = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
        symbol = np.where(known, v.symbols[at], v.rare).astype(np.int16) if len(v.hashes) else np.full(len(h), v.rare, np.int16)
        within = np.where(known, v.within[at], 0.0) if len(v.hashes) else np.zeros(len(h))
        base = np.where(known, np.log10((v.counts[at] + 1) / v.total), 0.0) if len(v.hashes) else np.zeros(len(h))
        token = np.array(parts, np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        data = symbol[token].tobytes()
        add = lambda values: np.add.reduceat(values[token], starts)
        rare_words, rare_counts = [], []
        for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
            own = token[lo:hi]
            own = own[~known[own]]
            found, n = np.unique(own, return_counts=True)
            rare_words.append(h[found])
            rare_counts.append(n)
        offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in rare_words]))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int64))) for x in (rare_words, rare_counts)]
        kept = [batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "held_out")]
        made = [pa.array([data[2 * a : 2 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary()), pa.array(np.array(lengths, np.int64)), pa.array(add(within)), pa.array(add(base)), pa.array(add(known.astype(np.int64)))]
        return pa.RecordBatch.from_arrays([*kept, *made, *lists], names=["row", "doc_id", "held_out", "symbols", "n_tokens", "within", "base", "n_known", "rare", "times"])

    return over_batches(docs, run, "row long, doc_id long, held_out boolean, symbols binary, n_tokens long, within double, base double, n_known long, rare array<long>, times array<long>")


@dataclass
class Parameters:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @staticmethod
    def first(base: np.ndarray, texts: list[np.ndarray]) -> Parameters:
        """Sticky states, each with the words of one of the texts: the longest, then whichever is least like those taken. Without enough texts,
        the unigram distribution distorted at random (a fixed seed)."""
        size = len(base)
        counts = np.array([np.bincount(x, minlength=size) for x in texts if len(x)], float).reshape(-1, size)
        emit = base * np.exp(np.random.default_rng(9).normal(0, 0.7, (STATES, size)))
        if len(counts):
            heads = counts[:, :OWN] + 1e-9
            heads = heads / np.linalg.norm(heads, axis=1, keepdims=True)
            taken = [int(counts.sum(1).argmax())]
            while len(taken) < min(STATES, len(counts)):
                taken.append(int((heads @ heads[taken].T).max(1).argmin()))
            own = counts[taken]
            emit[: len(own)] = 0.5 * base + 0.5 * own / own.sum(1, keepdims=True)
        move = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.9)
        return Parameters(np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True))

    @staticmethod
    def fitted(counts: np.ndarray, base: np.ndarray) -> Parameters:
        k, s = STATES, len(base)
        start, move, emit = counts[:k] + 1, counts[k : k + k * k].reshape(k, k) + 1, counts[k + k * k :].reshape(k, s) + SMOOTHING * base
        return Parameters(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class Pieces:
    """Sequences in pieces of PIECE symbols at most, sorted by length, with what each piece is entered with (a distribution over its first
    state, before it emits) and followed by (how likely the rest is from its last state, up to a factor)."""

    symbols: list[np.ndarray]
    enter: np.ndarray
    after: np.ndarray
    begins: np.ndarray  # whether the piece is its text's first


def _transfers(pieces: list[np.ndarray], p: Parameters) -> np.ndarray:
    """For each piece, from each first state to each last one, how likely it is, up to a factor for each piece."""
    k = p.emit.shape[0]
    by_symbol, out = np.ascontiguousarray(p.emit.T), np.zeros((len(pieces), k, k))
    for lo in range(0, len(pieces), PIECES_AT_ONCE):
        order = sorted(range(lo, min(lo + PIECES_AT_ONCE, len(pieces))), key=lambda i: -len(pieces[i]))
        lengths = np.array([len(pieces[i]) for i in order])
        live = np.searchsorted(-lengths, -np.arange(int(lengths[0])), "left")
        symbols = np.zeros((int(lengths[0]), len(order)), np.int16)
        for j, i in enumerate(order):
            symbols[: len(pieces[i]), j] = pieces[i]
        now = np.eye(k) * by_symbol[symbols[0]][:, None, :]
        for t in range(len(symbols)):
            n = live[t]
            if t:
                now[:n] = (now[:n] @ p.move) * by_symbol[symbols[t, :n]][:, None, :]
            now[:n] /= now[:n].sum((1, 2), keepdims=True)
        out[order] = now
    return out


def in_pieces(sequences: list[np.ndarray], p: Parameters) -> tuple[Pieces, np.ndarray]:
    """The sequences' pieces, and the expected moves from a piece to the next. Sequences of one piece need no more than that."""
    k = p.emit.shape[0]
    symbols, enter, after, begins = [], [], [], []
    cross = np.zeros((k, k))
    long = [x for x in sequences if len(x) > PIECE]
    cut = [[x[a : a + PIECE] for a in range(0, len(x), PIECE)] for x in long]
    transfers = _transfers([piece for own in cut for piece in own], p) if cut else np.zeros((0, k, k))
    at = 0
    for own in cut:
        m = transfers[at : at + len(own)]
        at += len(own)
        rest = [np.ones(k)]
        for step in m[:0:-1]:
            back = p.move @ (step @ rest[-1])
            rest.append(back / back.sum())
        rest.reverse()
        prior = p.start
        for i, step in enumerate(m):
            symbols.append(own[i])
            enter.append(prior)
            after.append(rest[i])
            begins.append(i == 0)
            if i + 1 < len(m):
                end = prior @ step
                ahead = m[i + 1] @ rest[i + 1]
                joint = end[:, None] * ahead[None, :]
                cross += joint / (joint * p.move).sum()
                prior = end @ p.move
                prior = prior / prior.sum()
    for x in sequences:
        if 0 < len(x) <= PIECE:
            symbols.append(x)
            enter.append(p.start)
            after.append(np.ones(k))
            begins.append(True)
    order = sorted(range(len(symbols)), key=lambda i: -len(symbols[i]))
    pick = lambda xs: np.array([xs[i] for i in order], float).reshape(-1, k)
    return Pieces([symbols[i] for i in order], pick(enter), pick(after), np.array([begins[i] for i in order], bool)), cross


def expected_counts(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """Expected starts, moves and emissions over whole sequences of any length: the E step, flat."""
    k, s = p.emit.shape
    start, emit = np.zeros(k), np.zeros((k, s))
    pieces, move = in_pieces(sequences, p)
    by_symbol, moves = np.ascontiguousarray(p.emit.T), p.move
    for lo in range(0, len(pieces.symbols), PIECES_AT_ONCE):
        some = slice(lo, lo + PIECES_AT_ONCE)
        block, after, first = pieces.symbols[some], pieces.after[some], pieces.begins[some]
        lengths = np.array([len(x) for x in block])
        steps = int(lengths[0])
        live = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than t come first
        symbols = np.zeros((steps, len(block)), np.int16)
        for i, x in enumerate(block):
            symbols[: len(x), i] = x
        forward, scale = np.zeros((steps, len(block), k)), np.ones((steps, len(block)))
        now = pieces.enter[some] * by_symbol[symbols[0]]
        for t in range(steps):
            if t:
                now = (now[: live[t]] @ moves) * by_symbol[symbols[t, : live[t]]]
            c = now.sum(1)
            now = now / c[:, None]
            forward[t, : live[t]], scale[t, : live[t]] = now, c
        behind = np.empty((0, k))
        for t in range(steps - 1, -1, -1):
            n = live[t]
            if len(behind) < n:
                ends = slice(len(behind), n)  # these end here
                last = after[ends] / (forward[t, ends] * after[ends]).sum(1, keepdims=True)
                behind = np.concatenate([behind, last])
            forward[t, :n] *= behind  # now the posterior of each state
            if t:
                ahead = by_symbol[symbols[t, :n]] * behind / scale[t, :n, None]
                move += forward[t - 1, :n].T @ ahead
                behind = ahead @ moves.T
        start += forward[0][first].sum(0)
        flat = np.concatenate([symbols[t, : live[t]] for t in range(steps)])
        weight = np.concatenate([forward[t, : live[t]] for t in range(steps)])
        for j in range(k):
            emit[j] += np.bincount(flat, weight[:, j], s)
    return np.concatenate([start, (move * moves).ravel(), emit.ravel()])


def baum_welch(encoded: DataFrame, base: np.ndarray, iterations: int = ITERATIONS) -> Parameters:
    """Fitted on the training texts in encoded. Each task adds up its counts; Spark adds the tasks' up, so the driver gets one table of fixed size."""
    spark = encoded.sparkSession
    training = encoded.where("not held_out").select("symbols")
    some = training.orderBy(F.xxhash64("symbols")).limit(FIRST_TEXTS).select(F.expr(f"substring(symbols, 1, {2 * FIRST_SYMBOLS})").alias("symbols")).collect()
    p = Parameters.first(base, [np.frombuffer(r["symbols"], np.int16) for r in some])
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(p)

        def count(batches, shared=shared):  # noqa: ANN001, ANN202
            total = None
            for batch in batches:
                texts = [np.frombuffer(x, np.int16) for x in batch.column(0).to_pylist()]
                if texts:
                    own = expected_counts(texts, shared.value)
                    total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])

        rows = training.mapInArrow(count, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
        if not len(rows):
            return p
        counts = np.zeros(STATES + STATES * STATES + STATES * len(base))
        counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
        p = Parameters.fitted(counts, base)
        shared.destroy()
    return p


def log_likelihoods(sequences: list[np.ndarray], p: Parameters) -> np.ndarray:
    """log10 likelihood of each whole sequence, by the forward recursion scaled to sum to one at every step."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    lengths = np.array([len(sequences[i]) for i in order])
    flat = np.concatenate([sequences[i] for i in order]) if order else np.empty(0, np.int16)
    offsets = np.cumsum(lengths) - lengths
    by_symbol, out = np.ascontiguousarray(p.emit.T), np.zeros(len(order))
    now, live = np.tile(p.start, (len(order), 1)), len(order)
    for t in range(int(lengths[0]) if order else 0):
        while lengths[live - 1] <= t:
            live -= 1
        now = (now[:live] @ p.move if t else now) * by_symbol[flat[offsets[:live] + t]]
        c = now.sum(1)
        now /= c[:, None]
        out[:live] += np.log10(c)
    result = np.empty(len(order))
    result[order] = out
    return result


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    Null text counts as empty: one token, its end. A null id hashes as the empty text and is trained on. Texts are scored whole, of any length.
    Repeated rows count and score like others. No training text: every word is unknown. Empty input: no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    counts = store(count_words(rows.where("not held_out").select("text")), "words")
    v = vocabulary(counts)
    encoded = store(encode(rows, v), "symbols")
    shared = docs.sparkSession.sparkContext.broadcast(baum_welch(encoded, v.base))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = log_likelihoods([np.frombuffer(x, np.int16) for x in batch.column(0).to_pylist()], shared.value)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found)], names=[*batch.schema.names[1:], "states"])

    columns = ["row", "doc_id", "held_out", "n_tokens", "within", "base", "n_known"]
    scored = over_batches(encoded.select("symbols", *columns), score, "row long, doc_id long, held_out boolean, n_tokens long, within double, base double, n_known long, states double")
    rare = encoded.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    counted = rare.join(counts, "h", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = counted.groupBy("row").agg(F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(v.rare_mass)))).alias("rare_within"), F.sum(F.col("times") * F.log10((F.col("n") + 1) / F.lit(float(v.total)))).alias("rare_base"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("rare_known")).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("rare_base")).alias("base_score"), (F.col("states") + F.col("within") + zero("rare_within")).alias("score"))
