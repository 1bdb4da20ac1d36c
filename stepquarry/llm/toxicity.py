"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it.

In training a link gets the out-of-fold probabilities of earlier links, so that it learns from predictions as unsure as those it will
see; the models kept are then fitted on all of the sample. Features are hashed words. The sample of labelled rows is bounded by a
parameter (SAMPLE), chosen by a hash of the id, evenly from rows of each combination of labels; scoring covers every row and whole texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches

SAMPLE = 8192
FOLDS = 5
BITS = 18
STEPS = 300
#: Slots are used whose share differs between the classes by so many standard errors.
TELLING = 4.0
RIDGE = 1e-4
WORD = re.compile(r"[^\W\d_]+")
#: Words whose weights a task keeps.
CACHED = 200_000


def slot(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> (64 - BITS)


def features(text: str | None) -> np.ndarray:
    """Slots of the distinct lower-cased words of a whole text; null has none."""
    return np.unique(np.fromiter(map(slot, set(WORD.findall((text or "").lower()))), np.int64))


@dataclass
class Linear:
    """p = sigmoid(bias + weights of the words present + weights of earlier links' log odds)."""

    words: np.ndarray
    links: np.ndarray
    bias: float

    def odds(self, rows: list[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        return np.array([self.words[r].sum() for r in rows]) + earlier @ self.links + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], earlier: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Linear:
    """Ridge logistic regression over telling slots, by accelerated, diagonally scaled gradient steps."""
    n = len(rows)
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows) if n else np.empty(0, np.int64)
    slots, at, seen = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    with_y = np.bincount(at, y[owner], len(slots))
    n1, n0 = max(1.0, y.sum()), max(1.0, n - y.sum())
    p1, p0, p = with_y / n1, (seen - with_y) / n0, (seen + 1) / (n + 2)
    usable = np.abs(p1 - p0) > TELLING * np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    slots, seen = slots[usable], seen[usable]
    keep, number = usable[at], np.cumsum(usable) - 1
    at, owner = number[at[keep]], owner[keep]
    weight = weight * n / max(weight.sum(), 1e-9)
    ones = (weight * y).sum()
    w, a, bias = np.zeros(len(slots)), np.zeros(earlier.shape[1]), float(np.log((ones + 0.5) / (n - ones + 0.5)))
    held = max(1, len(at) / max(1, n))  # telling slots to a row
    scale = 1 / (0.25 * np.bincount(at, weight[owner], len(slots)) * held + 1)
    last_w, last_a = w.copy(), a.copy()
    for step in range(STEPS):
        push = step / (step + 3)
        look_w, look_a = w + push * (w - last_w), a + push * (a - last_a)
        odds = np.bincount(owner, look_w[at], n) + earlier @ look_a + bias
        error = (sigmoid(odds) - y) * weight
        last_w, last_a = w, a
        w = look_w - scale * (np.bincount(at, error[owner], len(slots)) + RIDGE * n * look_w)
        a = look_a - (earlier.T @ error) / (n + 1)
        bias -= error.sum() / (0.25 * n + 1) / 4
    full = np.zeros(1 << BITS, np.float32)
    full[slots] = w
    return Linear(full, a, bias)


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray, weight: np.ndarray) -> list[Linear]:
    """labels: a column for each category in the chain's order, NaN where unknown. weight: how many labelled rows a row of the sample stands for."""
    chain, earlier = [], np.zeros((len(rows), 0))
    for c in range(labels.shape[1]):
        known = ~np.isnan(labels[:, c])
        own = lambda mask: ([rows[i] for i in np.flatnonzero(mask)], earlier[mask])  # noqa: B023, E731
        chain.append(fit(*own(known), labels[known, c], weight[known]))
        outside = np.zeros(len(rows))
        for k in range(FOLDS):
            inside = folds == k
            if inside.any() and (known & ~inside).any():
                outside[inside] = sigmoid(fit(*own(known & ~inside), labels[known & ~inside, c], weight[known & ~inside]).odds(*own(inside)))
        earlier = np.column_stack([earlier, outside])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str, text_col: str, sample: int = SAMPLE) -> list[Linear]:
    """categories: name -> SQL of a 0/1 value over labels. The driver collects the features of `sample` rows at most."""
    marked = labels.select(F.col(id_col).cast("long").alias("id"), *[F.expr(sql).cast("double").alias(f"y{k}") for k, sql in enumerate(categories.values())]).where("id is not null")
    ys = [f"y{k}" for k in range(len(categories))]
    kinds = marked.groupBy(*ys).count().collect()  # a row for each combination of labels
    order = F.xxhash64("id")
    picked = None
    for kind in kinds:
        match = F.lit(True)
        for y in ys:
            match = match & F.col(y).eqNullSafe(F.lit(kind[y]))
        most = max(1, sample // len(kinds))
        part = marked.where(match).orderBy(order, "id").limit(most).withColumn("weight", F.lit(kind["count"] / min(most, kind["count"])))
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return [Linear(np.zeros(1 << BITS, np.float32), np.zeros(k), 0.0) for k in range(len(categories))]

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.astype(np.int32) for f in found], pa.list_(pa.int32())), *batch.columns[2:]], names=["id", "slots", *ys, "weight"])

    # a label for each row of the sample, and of several texts with its id the one with the least hash: no more than `sample` rows
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked.select("id").distinct()), "id")
    one = texts.groupBy("id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    rows = over_batches(one.join(F.broadcast(picked), "id"), extract, "id long, slots array<int>, " + ", ".join(f"{y} double" for y in [*ys, "weight"])).toPandas().sort_values("id")
    table = np.column_stack([rows[y].to_numpy(float) for y in ys])
    folds = np.array([xxhash.xxh64_intdigest(str(i)) % FOLDS for i in rows["id"]])
    return fit_chain([np.asarray(x, np.int64) for x in rows["slots"]], table, folds, rows["weight"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, a probability p_<category> for each link, and toxic, whether the last one reaches the threshold.

    Default chain: low_quality, then toxic. Null or empty text has the bias only. Labels may be null or lack (those rows train other links);
    labels whose id has several rows count each. Without labels every probability is a half. Repeated rows are scored alike; empty input: no rows."""
    categories = categories or {"low_quality": "1 - quality", "toxic": "toxic"}
    chain = docs.sparkSession.sparkContext.broadcast(train(docs, labels, categories, id_col, text_col, sample))
    names = [f"p_{c}" for c in categories]

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        links = chain.value
        weights: dict[str, tuple[float, ...]] = {}
        sums = np.zeros((batch.num_rows, len(links)))
        for i, text in enumerate(batch.column(1).to_pylist()):
            slots = {}
            for w in set(WORD.findall((text or "").lower())):
                if (s := weights.get(w)) is None:
                    if len(weights) >= CACHED:
                        weights.clear()
                    s = weights[w] = slot(w)
                slots[s] = None
            if slots:
                own = np.fromiter(slots, np.int64, len(slots))
                for c, link in enumerate(links):
                    sums[i, c] = link.words[own].sum()
        earlier = np.zeros((batch.num_rows, 0))
        for c, link in enumerate(links):
            earlier = np.column_stack([earlier, sigmoid(sums[:, c] + earlier @ link.links + link.bias)])
        return pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(earlier[:, c]) for c in range(len(links))], pa.array(earlier[:, -1] >= threshold)], names=["doc_id", *names, "toxic"])

    schema = "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return over_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), score, schema)
