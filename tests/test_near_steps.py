"""Near-duplicate steps and token rows, which SQL can't express, against plain versions over whole tables."""

import difflib
import random
import re
import zlib

import pandas as pd
import pytest

from stepquarry.functions import udfs
from stepquarry.plans import catalog, tree_queries

DATA = "/root/testdata/sf0.001"


def key(text):
    low = (text or "").lower().replace("premature final review draft retained as a reasoning note, not as the final scored review:", " ")
    return re.sub(r"[^a-z0-9_]+", " ", re.sub(r"</?(step|review)>", " ", low)).strip()


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


@pytest.fixture(scope="module")
def turns():
    out = {}
    for r in pd.read_parquet(f"{DATA}/conversations.parquet").sort_values(["conv_id", "turn"]).itertuples():
        out.setdefault(r.conv_id, []).append((r.turn, r.text))
    return out


def test_adjacent_turns(spark, turns):
    want = {}
    for rec, own in turns.items():
        for (_, before), (pos, text) in zip([(None, None), *own], own):
            a, b = key(before), key(text)
            want[rec, pos] = min(len(a.split()), len(b.split())) >= 6 and ratio(a, b) >= 0.9
    got = {(r.rec, r.pos): bool(r.near) for r in catalog.QUERIES["near_duplicate_steps"](spark, DATA).collect()}
    assert got == want


def test_steps_under_one_parent(spark, turns):
    want = {}
    for rec, own in turns.items():
        above, kept = key(own[0][1]), []
        for at, (_, text) in enumerate(own[1:]):
            step = key(text)
            near = len(step.split()) >= 6 and (ratio(step, above) >= 0.9 or any(ratio(step, k) >= 0.9 for k in kept))
            want[rec, at] = not near
            if not near:
                kept.append(step)
    got = {(r.rec, r["at"]): r.fresh for r in catalog.QUERIES["redundant_steps"](spark, DATA).collect()}
    assert got == want


def test_bounds_lose_no_pair_and_prune_most():
    rnd = random.Random(6)
    words = "check the loop bound against length of list returns none where zero is wanted and keep largest value first".split()
    texts = [" ".join(rnd.choices(words, k=rnd.randint(6, 14))) for _ in range(60)]
    texts += [t.replace("loop", "loops") for t in texts] + [t + " 7" for t in texts]
    aligned = near = 0
    for a in texts:
        for b in texts[:60]:
            whole = len(a) + len(b)
            aligned += 2 * min(len(a), len(b)) / whole >= 0.9 and 2 * sum(min(a.count(c), b.count(c)) for c in set(a)) / whole >= 0.9
            near += (want := ratio(a, b) >= 0.9)
            assert udfs.is_near(a, b) == want
    assert near and aligned < 0.5 * 180 * 60


def test_bound_columns_hold(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(9)
    rows = [(key(" ".join(rnd.choices(["ab", "ba", "c_1", "ddd", "e"], k=rnd.randint(0, 12)))), key(" ".join(rnd.choices(["ab", "ba", "c_1", "ddd", "e"], k=rnd.randint(0, 12))))) for _ in range(300)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", udfs.similarity_bound(F.col("a"), F.col("b")).alias("bound"), udfs.near(F.col("a"), F.col("b")).alias("near")).collect()
    for r in got:
        assert r.bound is None or r.bound >= ratio(r.a, r.b) - 1e-12
        assert r.near == (min(len(r.a.split()), len(r.b.split())) >= 6 and ratio(r.a, r.b) >= 0.9)


def test_token_rows(spark):
    items = tree_queries.kept(spark, DATA).select("order", "terminal_tag", "instruction", "response", "q_value", "train_lm").collect()
    want = []
    for r in items:
        ids, marks = len(r.instruction.split()), []
        for text, q in zip(r.response, r.q_value):
            own = len(text.split())
            ids += own
            if own and q != -100.0:
                marks.append(ids - 1)
            if ids > 80:
                break
        n, labelled = min(ids + 1, 80), max(0, min(ids + 1, 80) - len(r.instruction.split())) if r.train_lm else 0
        want.append((r.order, r.terminal_tag, n, sum(m < 80 for m in marks), labelled, ids + 1 > 80))
    got = [tuple(r) for r in catalog.QUERIES["token_rows"](spark, DATA).collect()]
    assert zlib.crc32(b"a") and sorted(got) == sorted(want)
