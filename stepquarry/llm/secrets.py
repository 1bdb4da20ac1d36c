"""Secret scans: candidates by pattern, then corpus-wide ownership frequency.

A candidate value that turns up under many owners or in many repositories is a copied example; one that a single owner has in one or two looks live. Patterns with a
telling prefix or length are always reported (the base); unprefixed high-entropy tokens are reported only where ownership says that they
are specific. Texts are scanned once, with built-in functions; only spans and 64-bit hashes of values are kept and shuffled."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_evenly, small, store, unique_name

#: Kind, pattern, the group that holds the value.
KINDS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", r"AKIA[A-Z0-9]{16,}", 0),
    ("hex", r"[0-9a-f]{24,}", 0),
    ("generic", r"[A-Za-z0-9_-]{24,}", 0),
]
BASE = ("assign", "access", "hex")
LEAST_ASSIGNED = 6
#: Bits of entropy a character that an unprefixed token has at least.
LEAST_ENTROPY = 3.0


def scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_cols: tuple[str, ...]) -> DataFrame:
    """Stored rows (row, doc_id, owner, repo, found): found has, per kind and in order, the gap before a match, its length, the value's hash and whether it counts.

    A match runs as far as its pattern does and consumes what it covers, also where it then doesn't count: an assignment whose value is short."""
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit("")) if owner_col in docs.columns else F.lit("")
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols if c in docs.columns])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), owner.alias("owner"), repo.alias("repo"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    for kind, pattern, group in KINDS:
        rows = rows.withColumn(f"m_{kind}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        if group:
            some = F.size(f"m_{kind}") > 0
            rows = rows.withColumn(f"v_{kind}", F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(group))))
        else:
            rows = rows.withColumn(f"v_{kind}", F.col(f"m_{kind}"))
    parts = []
    for k, (kind, pattern, _) in enumerate(KINDS):
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.slice(gaps, F.lit(1), F.size(f"m_{kind}"))))
        made = F.transform(F.arrays_zip(f"g_{kind}", f"m_{kind}", f"v_{kind}"), _match(k, kind))
        parts.append(F.coalesce(F.when(F.size(f"m_{kind}") > 0, made), F.array()))
    return store(rows.select("row", "doc_id", "text_hash", "owner", "repo", F.concat(*parts).alias("found")), "secrets")


def _match(number: int, kind: str) -> Callable[[Column, Column], Column]:
    def counts(value: Column) -> Column:
        if kind == "assign":
            return F.length(value) >= LEAST_ASSIGNED
        if kind == "generic":
            mixed = value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
            return F.when(mixed, entropy(value) >= LEAST_ENTROPY).otherwise(False)
        return F.lit(True)

    def made(z: Column, i: Column) -> Column:
        value = z[f"v_{kind}"]
        return F.struct(F.lit(number).alias("kind"), i.alias("pos"), z[f"g_{kind}"].alias("gap"), F.length(z[f"m_{kind}"]).alias("len"), F.xxhash64(value).alias("value"), counts(value).alias("counts"))

    return made


def entropy(value: Column) -> Column:
    """Bits a character, by how often each character is in the value."""
    letters = F.filter(F.split(value, ""), lambda x: x != "")
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / F.size(letters)
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda h, c: h - share(c) * F.log2(share(c)))


class Spread(NamedTuple):
    """How many owners and repositories have a value."""

    owners: int
    repos: int


#: What a value that only its owner has is spread over at most, and an example that is copied widely at least.
LIVE, EXAMPLE = Spread(1, 2), Spread(3, 8)


def ownership(spans: DataFrame) -> DataFrame:
    """(value, n, owners, repos): how many spans a candidate value has, and how many distinct owners and repositories. Combined before every shuffle."""
    held = spans.groupBy("value", "owner", "repo").agg(F.count("*").alias("n")).groupBy("value", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return held.groupBy("value").agg(F.sum("n").alias("n"), F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def spans(found: DataFrame) -> DataFrame:
    """Spans that count: (row, doc_id, owner, repo, kind number, start, end, value); code points, end exclusive."""
    one = found.select("row", "doc_id", "text_hash", "owner", "repo", F.explode("found").alias("f")).select("row", "doc_id", "text_hash", "owner", "repo", "f.*")
    placed = one.withColumn("end", F.expr("sum(gap + len) over (partition by row, kind order by pos)"))
    return placed.where("counts").select("row", "doc_id", "text_hash", "owner", "repo", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "value")


def judged(found: DataFrame, live: Spread, example: Spread) -> DataFrame:
    """Spans with owners, repos and verdict: `example` (so many owners or so many repositories at least), `live` (so many owners and so many repositories
    at most) or `shared`. Unprefixed tokens only where live."""
    all_spans = store(spans(found), "spans")
    wide = (F.col("owners") >= example.owners) | (F.col("repos") >= example.repos)
    verdict = F.when(wide, "example").when((F.col("owners") <= live.owners) & (F.col("repos") <= live.repos), "live").otherwise("shared")
    out = join_evenly(all_spans, store(ownership(all_spans), "owners"), ["value"], "n").withColumn("verdict", verdict)
    return out.where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), live: Spread = LIVE, example: Spread = EXAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, most_owners, most_repos.

    Null or empty text has no spans. A null owner or repository, or a column that docs doesn't have, counts as one unnamed owner.
    Repeated rows are scanned alike and count once for ownership. Empty input: no rows. Very long texts are scanned whole."""
    found = scan(docs, id_col, text_col, owner_col, repo_cols)
    kind = F.element_at(F.array(*[F.lit(k) for k, _, _ in KINDS]), F.col("kind") + 1)
    label = F.concat_ws(":", kind, F.col("start"), F.col("end"))
    base = F.col("kind") < len(BASE)
    item = F.struct("start", F.col("kind"), "end", label.alias("label"))
    joined = lambda items: F.array_join(F.transform(F.sort_array(items), lambda x: x["label"]), ",")
    per_row = judged(found, live, example).groupBy("row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        joined(F.collect_list(F.when(base, item))).alias("base"),
        joined(F.collect_list(item)).alias("spans"),
        F.count_if(F.col("verdict") == "live").alias("n_live"),
        F.count_if(F.col("verdict") == "example").alias("n_example"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("row", "doc_id").join(per_row, "row", "left").select("doc_id", *[zero(f"n_{x}") for x in BASE], F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"), zero("most_owners"), zero("most_repos"))


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), mark: str = "[SECRET]") -> DataFrame:
    """docs with a mark in place of each judged span (overlapping ones become one mark). All rows and other columns stay; null text stays null.

    Rows of equal id and text are treated alike. Where docs has n_chars, it follows the text."""
    found = scan(docs, id_col, text_col, owner_col, repo_cols)
    cut_id, cut_hash, name = (unique_name(docs, x) for x in ("cut_id", "cut_hash", "cuts"))
    cuts = judged(found, LIVE, EXAMPLE).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("cuts"))
    cuts = store(cuts.select(F.col("doc_id").alias(cut_id), F.col("text_hash").alias(cut_hash), F.col("cuts").alias(name)), "cuts")
    forget(found)
    match = F.col(id_col).cast("long").eqNullSafe(F.col(cut_id)) & (F.xxhash64(text_col) == F.col(cut_hash))
    text = F.col(text_col)

    def cut(state: Column, span: Column) -> Column:
        piece = F.concat(F.substring(text, state["at"] + 1, span["start"] - state["at"]), F.lit(mark))
        pieces = F.when(span["start"] >= state["at"], F.concat(state["pieces"], F.array(piece))).otherwise(state["pieces"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), pieces.alias("pieces"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("pieces"))
    done = F.aggregate(F.col(name), begin, cut, lambda s: F.concat(F.array_join(s["pieces"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    joined = docs.join(small(cuts), match, "left")
    out = joined.withColumn(text_col, F.when(F.col(name).isNull(), text).otherwise(done)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
