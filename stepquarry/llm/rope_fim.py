"""Fill-in-the-middle by ropes.

A text is held as a balanced tree whose leaves are stretches of it, cut between units, with the counts of units and of code points cached in
every node. The tree is split at two unit ranks, the parts are put together in another order with sentinels between them, and the counts give
the parts' sizes without reading them again. The way back builds a rope of the output, splits it at its sentinels by code-point rank and puts
the parts together as they were. Trees are never changed: a split makes new nodes along one path only.

Texts are independent, so nothing is shuffled; a task holds one Arrow batch and one text's rope."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NONSPACE_CLASS, SPACE_CLASS, over_batches

#: Code points of a leaf, more only where a unit is longer.
LEAF = 1 << 10
#: Before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: The seed of a document's draws, and per cent of the texts that are transformed, and of these with the suffix first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80

UNIT = re.compile(f"{SPACE_CLASS}*{NONSPACE_CLASS}+|{SPACE_CLASS}+")
UNIT_ENDS = re.compile(NONSPACE_CLASS + SPACE_CLASS)


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf has text, an inner node left and right. `units` sums those of the leaves, each leaf's counted by itself."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += [node.right, node.left]


def leaf(text: str) -> Rope:
    return Rope(sum(1 for _ in UNIT.finditer(text)), len(text), 0, text)


EMPTY = leaf("")


def join(a: Rope, b: Rope) -> Rope:
    """a and b as one rope; the lower one goes down the other's side, so heights stay within a constant of the leaves' logarithm."""
    if not a.chars or not b.chars:
        return a if a.chars else b
    if a.height > b.height + 1:
        return _node(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _node(join(a, b.left), b.right)
    return _node(a, b)


def _node(a: Rope, b: Rope) -> Rope:
    """The node over a and b, turned once where one is two levels higher."""
    if a.height > b.height + 1:
        return _over(a.left, _over(a.right, b)) if a.left.height >= a.right.height else _over(_over(a.left, a.right.left), _over(a.right.right, b))
    if b.height > a.height + 1:
        return _over(_over(a, b.left), b.right) if b.right.height >= b.left.height else _over(_over(a, b.left.left), _over(b.left.right, b.right))
    return _over(a, b)


def _over(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def rope(text: str) -> Rope:
    """The balanced rope of a text, its leaves cut where a unit ends."""
    parts, at = [], 0
    while at < len(text):
        end = UNIT_ENDS.search(text, at + LEAF - 1)
        stop = end.start() + 1 if end else len(text)
        parts.append(leaf(text[at:stop]))
        at = stop
    while len(parts) > 1:
        parts = [_over(*pair) if len(pair) == 2 else pair[0] for pair in (parts[k : k + 2] for k in range(0, len(parts), 2))]
    return parts[0] if parts else EMPTY


def split(node: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The first `rank` units (or chars) and the rest."""
    if node.left is None:
        if rank <= 0 or rank >= getattr(node, by):
            return (EMPTY, node) if rank <= 0 else (node, EMPTY)
        if by == "units":
            found = UNIT.finditer(node.text)
            for _ in range(rank - 1):
                next(found)
            rank = next(found).end()
        return leaf(node.text[:rank]), leaf(node.text[rank:])
    own = getattr(node.left, by)
    if rank < own:
        a, b = split(node.left, rank, by)
        return a, join(b, node.right)
    a, b = split(node.right, rank - own, by)
    return join(node.left, a), b


def place(node: Rope, mark: str) -> int:
    """The code-point rank of the first `mark`, which has no white space, so that it lies in one unit and thus in one leaf."""
    at = 0
    for text in node.leaves():
        if (found := text.find(mark)) >= 0:
            return at + found
        at += len(text)
    raise ValueError(f"the output has no {mark}")


def arrange(parts: tuple[Rope, Rope, Rope], form: str, marks: tuple[str, str, str]) -> Rope:
    """Prefix, middle and suffix in the form's order, each after its sentinel."""
    prefix, middle, suffix = parts
    order = ((0, prefix), (1, suffix), (2, middle)) if form == "psm" else ((1, suffix), (0, prefix), (2, middle))
    whole = EMPTY
    for k, part in order:
        whole = join(join(whole, leaf(marks[k])), part)
    return whole


def restore(output: str, form: str, marks: tuple[str, str, str]) -> str:
    """The text that `arrange` was given, from its output and form."""
    if form == "plain":
        return output
    rest, found = rope(output), {}
    for k in (0, 1, 2) if form == "psm" else (1, 0, 2):
        part, rest = split(rest, place(rest, marks[k]), "chars")
        if found:
            found[last] = part
        _, rest = split(rest, len(marks[k]), "chars")
        last, found[k] = k, rest
    return "".join(join(join(found[0], found[2]), found[1]).leaves())


def _can_meet(a: str, b: str) -> bool:
    """Whether an end of a begins b, or a lies in another b: then the first place of a mark may not be its own."""
    return any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (a != b and a in b)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain), output.

    The draws are the first four groups of eight hexadecimal digits of the SHA-256 of `seed:doc_id`; a null id counts as an empty string. Plain are
    empty and null texts (output empty), texts that hold a sentinel, and those not drawn. Any length; a text without white space is one unit.
    Repeated rows give equal results; an empty table gives no rows; other columns aren't read. Sentinels are three strings without
    white space that can't overlap."""
    if len(set(sentinels)) < 3 or any(not m or re.search(SPACE_CLASS, m) for m in sentinels) or any(_can_meet(a, b) for a in sentinels for b in sentinels):
        raise ValueError("sentinels must be three strings without white space that can't overlap")

    def transform(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {k: [] for k in ("n", "form", "prefix_chars", "middle_chars", "output")}
        for text, hashed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            h1, h2, h3, h4 = (int(hashed[k : k + 8], 16) for k in range(0, 32, 8))
            tree = rope(text or "")
            row = tree.units, "plain", None, None, text or ""
            if tree.chars and h3 % 100 < rate and not any(m in text for m in sentinels):
                one, two = sorted((h1 % (tree.units + 1), h2 % (tree.units + 1)))
                head, suffix = split(tree, two)
                prefix, middle = split(head, one)
                form = "spm" if h4 % 100 < suffix_first else "psm"
                row = tree.units, form, prefix.chars, middle.chars, "".join(arrange((prefix, middle, suffix), form, sentinels).leaves())
            for k, x in zip(out, row):
                out[k].append(x)
        longs = {"n", "prefix_chars", "middle_chars"}
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.int64() if k in longs else pa.string()) for k, v in out.items()]], names=["doc_id", *out])

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), drawn.alias("drawn"))
    return over_batches(rows, transform, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(rows: DataFrame, output_col: str = "output", form_col: str = "form", out_col: str = "restored", sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """rows and the text rebuilt from output and form alone. A null output or form counts as an empty text, plain."""

    @F.udf("string", useArrow=True)
    def back(output: str | None, form: str | None) -> str:
        return restore(output or "", form or "plain", sentinels)

    return rows.withColumn(out_col, back(F.col(output_col), F.col(form_col)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the SHA-256 of the output and of the text rebuilt from it."""
    return restored(fill_in_middle(docs)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
