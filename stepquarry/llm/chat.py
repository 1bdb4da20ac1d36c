"""Chat formatting by minimum-cost role repair: dynamic programming over an automaton of legal turns, then rendering.

A conversation is legal if it is (system)? (user assistant)+. Per turn the repair keeps or relabels the role, and appends the turn, merges
it into the turn before, or inserts empty turns to make it legal. Of all cheapest repairs the one is taken whose steps, first to last, come
first in the order of OPTIONS. Conversations of any length are cut into blocks: rows are dealt by range of (conversation, turn), so a hot
conversation spans many tasks. A block's costs from state to state are a small matrix; matrices of blocks compose, which gives each block
the state it is entered in and the cost of what follows. Only conversations that straddle blocks need that, two for a task at most."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions_for, store

#: The roles, what else they are called, and the costs of a repair.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant"}
MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 40
#: state -> (role, how, inserted roles): how a turn of the role may follow.
MOVES = {
    START: [(0, "append", ()), (1, "append", ()), (2, "insert", (1,))],
    SYSTEM: [(1, "append", ()), (0, "merge", ()), (2, "insert", (1,))],
    USER: [(2, "append", ()), (1, "merge", ()), (1, "insert", (2,))],
    ASSISTANT: [(1, "append", ()), (2, "merge", ()), (2, "insert", (1,))],
}
ENDINGS = {START: (1, 2), SYSTEM: (1, 2), USER: (2,), ASSISTANT: ()}
FINISH = [INSERT * len(ENDINGS[s]) for s in range(4)]


def _options() -> dict[tuple[int, int], list[tuple[int, int, str, tuple[int, ...]]]]:
    """(state, role or -1) -> (cost, next state, how, inserted), in the order of preference."""
    out = {}
    for state, moves in MOVES.items():
        for role in (-1, 0, 1, 2):
            found = [((how == "merge") * MERGE + INSERT * len(inserted) + (to != role) * RELABEL, to + 1, how, inserted) for to, how, inserted in moves]
            out[state, role] = sorted(found, key=lambda x: x[0])
    return out


OPTIONS = _options()


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def costs_to_go(roles: list[int], end: list[int]) -> list[list[int]]:
    """For each position, from each state, the least cost of what follows; end: after the last turn."""
    out = [list(end)]
    for role in reversed(roles):
        after = out[-1]
        out.append([min(cost + after[to] for cost, to, _, _ in OPTIONS[s, role]) for s in range(4)])
    return out[::-1]


def matrix(roles: list[int]) -> list[list[int]]:
    """Least cost from each state before the turns to each state after them."""
    return [list(x) for x in zip(*[costs_to_go(roles, [0 if s == to else NEVER for s in range(4)])[0] for to in range(4)], strict=True)]


def walk(roles: list[int], end: list[int], state: int) -> tuple[list[tuple[int, int, str, tuple[int, ...]]], int]:
    """The preferred cheapest steps from a state, and the state they end in."""
    ahead, steps = costs_to_go(roles, end), []
    for k, role in enumerate(roles):
        step = min(OPTIONS[state, role], key=lambda x: x[0] + ahead[k + 1][x[1]])
        steps.append(step)
        state = step[1]
    return steps, state


def escaped(text: str) -> str:
    """Text that holds no mark of a turn: each <| in it, and each <\\| and so on, gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    turns = re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", rendered, flags=re.S)
    return [(role, re.sub(r"<\\(\\*)\|", r"<\1|", text)) for role, text in turns]


def repair(roles: list[str | None]) -> list[tuple[int, int, str, tuple[int, ...]]]:
    return walk([role_number(r) for r in roles], FINISH, START)[0]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first two columns (conversation, block)."""
    now, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[:2] != now:
                if rows:
                    yield now, rows
                now, rows = row[:2], []
            rows.append(row)
    if rows:
        yield now, rows


def _dealt(df: DataFrame) -> DataFrame:
    return df.repartition(partitions_for(df.sparkSession), "conv", "block").sortWithinPartitions("conv", "block", "seq")


def _straddlers(rows: DataFrame) -> dict[tuple, tuple[int, list[int], int]]:
    """(conversation, block) -> entry state, cost of what follows by state, turns before, whether it is the last; for conversations of several blocks.

    The driver gets a few numbers for each such block, of which there are two for a task at most."""
    many = rows.groupBy("conv").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("conv")
    roles = store(rows.select("conv", "block", "seq", "role").join(F.broadcast(many.select(F.col("conv").alias("c"))), F.col("conv").eqNullSafe(F.col("c")), "left_semi"), "straddlers")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in _blocks(batches):
            yield pa.RecordBatch.from_pylist([{"conv": conv, "block": block, "m": sum(matrix([role_number(r[3]) for r in own]), [])}], pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("m", pa.list_(pa.int64()))]))

    found: dict = {}
    for r in _dealt(roles).mapInArrow(matrices, "conv long, block long, m array<long>").collect():
        found.setdefault(r["conv"], []).append((r["block"], r["m"]))
    ends = {}
    for conv, blocks in found.items():
        after = list(FINISH)
        for block, m in sorted(blocks, reverse=True):
            ends[conv, block] = after
            after = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), own in _blocks(batches):
            walks = [walk([role_number(r[3]) for r in own], ends[conv, block], s) for s in range(4)]
            turns = [sum((how != "merge") + len(inserted) for _, _, how, inserted in steps) for steps, _ in walks]
            yield pa.RecordBatch.from_pylist([{"conv": conv, "block": block, "to": [w[1] for w in walks], "turns": turns}], pa.schema([("conv", pa.int64()), ("block", pa.int64()), ("to", pa.list_(pa.int64())), ("turns", pa.list_(pa.int64()))]))

    lasts = {conv: max(b for b, _ in blocks) for conv, blocks in found.items()}
    out, state, before, last = {}, START, 0, object()
    for r in sorted(_dealt(roles).mapInArrow(exits, "conv long, block long, to array<long>, turns array<long>").collect(), key=lambda r: (r["conv"] is None, r["conv"] or 0, r["block"])) if ends else []:
        if r["conv"] != last:
            state, before, last = START, 0, r["conv"]
        out[r["conv"], r["block"]] = (state, ends[r["conv"], r["block"]], before, r["block"] == lasts[r["conv"]])
        state, before = r["to"][state], before + r["turns"][state]
    return out


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each row of turns: conv_id, turn, role, out_role, action (append, merge or insert), relabelled, inserted (roles of empty turns
    before it), out_turn (its place in the repaired conversation), cost, rendered. A conversation's rendered values in order of (out_turn, seq)
    are its text; the last one also holds the empty turns that complete it, and counts their cost. Marks of turns in a text are escaped, so
    read_back gives the turns again.

    Turns are ordered by turn (null last), then role and text; repeated rows are turns of their own. Null text is empty; a null or unknown
    role is relabelled. Rows with a null conv_id are one conversation. Empty input: no rows. Other columns aren't read."""
    rows = turns.select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # so that equal rows don't all fall into one range
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text"), F.col("row")]
    spread = rows.repartitionByRange(partitions_for(turns.sparkSession), *order).sortWithinPartitions(*order)
    placed = spread.select("conv", F.spark_partition_id().cast("long").alias("block"), F.monotonically_increasing_id().alias("seq"), "role", "turn", "text")
    stored = store(placed, "turns")
    known = turns.sparkSession.sparkContext.broadcast(_straddlers(stored))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for (conv, block), own in _blocks(batches):
            state, end, turn_number, ends_here = known.value.get((conv, block), (START, FINISH, 0, True))
            steps, final = walk([role_number(r[3]) for r in own], end, state)
            for k, (row, (cost, to, how, inserted)) in enumerate(zip(own, steps, strict=True)):
                text = ["\n"] if how == "merge" else []
                for role in (*inserted, *([to - 1] if how != "merge" else [])):
                    text.append(("" if state == START else "<|end|>\n") + f"<|{ROLES[role]}|>\n")
                    state = role + 1
                    turn_number += 1
                text.append(escaped(row[5]))
                tail = ENDINGS[final] if ends_here and k == len(own) - 1 else ()
                if ends_here and k == len(own) - 1:
                    text += [f"<|end|>\n<|{ROLES[r]}|>\n" for r in tail] + ["<|end|>\n"]
                out.append((conv, row[4], row[2], row[3], ROLES[to - 1], how, role_number(row[3]) != to - 1, [ROLES[r] for r in inserted], turn_number - 1, cost + INSERT * len(tail), "".join(text)))
            if len(out) >= 2000:
                yield _rendered(out)
                out = []
        if out:
            yield _rendered(out)

    narrow = stored.select("conv", "block", "seq", "role", "turn", "text")
    return _dealt(narrow).mapInArrow(render, "conv_id long, turn long, seq long, role string, out_role string, action string, relabelled boolean, inserted array<string>, out_turn long, cost long, rendered string")


def _rendered(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "turn", "seq", "role", "out_role", "action", "relabelled", "inserted", "out_turn", "cost", "rendered"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
