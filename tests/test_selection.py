"""Exact rounding against Python's, and selection by hash against sorting."""

import collections
import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepquarry.functions.exact import half_even
from stepquarry.operators import sampling, selection


def rounded(spark, xs, digits):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    return [r.r for r in df.select(half_even("x", digits).alias("r")).collect()]


def test_rounding_equals_python_at_all_ties(spark):
    xs = [s * k / 20000 for k in range(20001) for s in (1, -1)] + [k / 64 for k in range(-300, 300)] + [0.50015, 2.675, 1.005, 5e-324, 1e300, -0.00001]
    assert rounded(spark, xs, 4) == [round(x, 4) + 0.0 for x in xs]
    assert rounded(spark, xs, 2) == [round(x, 2) + 0.0 for x in xs]
    assert sum(a != b for a, b in zip([r.r for r in spark.createDataFrame([(x,) for x in xs], "x double").select(F.bround("x", 4).alias("r")).collect()], [round(x, 4) for x in xs])) > 2000


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=200, max_size=400), st.sampled_from([0, 1, 3, 4, 6]))
def test_rounding_equals_python_anywhere(spark, xs, digits):
    assert rounded(spark, xs, digits) == [round(x, digits) + 0.0 for x in xs]


def test_rounding_keeps_what_has_no_fraction(spark):
    got = spark.createDataFrame([(None,), (float("inf"),), (float("nan"),)], "x double").select(half_even("x", 4).alias("r")).collect()
    assert got[0].r is None and got[1].r == float("inf") and got[2].r != got[2].r
    with pytest.raises(ValueError):
        half_even("x", 8)


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = [(i, rnd.choice(["hot", "hot", "hot", "a", "b", "c", None, f"g{rnd.randrange(40)}"])) for i in range(3000)] + [(7, "hot"), (7, "hot")]
    return out, spark.createDataFrame(out, "id long, g string")


def digest(i):
    return hashlib.md5(f"5:{i}".encode()).hexdigest()


@pytest.mark.parametrize("quota", [0, 1, 30, 700, 10**6])
def test_first_of_each_group(spark, rows, quota, monkeypatch):
    monkeypatch.setattr(selection, "BUCKET", 20)
    out, df = rows
    groups = collections.defaultdict(list)
    for i, g in out:
        groups[g].append((digest(i), i))
    want = sorted((i, str(g), k + 1) for g, found in groups.items() for k, (_, i) in enumerate(sorted(found)[:quota]))
    ranked = selection.first_of_each(df, ["g"], sampling.seeded(5, "id"), quota, rank="_n")
    assert sorted((r.id, str(r.g), r["_n"]) for r in ranked.collect()) == want
    plain = selection.first_of_each(df, ["g"], sampling.seeded(5, "id"), quota)
    assert plain.columns == df.columns and sorted((r.id, str(r.g)) for r in plain.collect()) == [w[:2] for w in want]


def test_first_rows_of_all(rows, monkeypatch):
    monkeypatch.setattr(selection, "BUCKET", 20)
    monkeypatch.setattr(selection, "FEW", 0)
    out, df = rows
    for n in (0, 1, 999, 3001, 5000):
        assert sorted(r.id for r in sampling.take(df, n, 5, "id").collect()) == sorted(i for _, i in sorted((digest(i), i) for i, _ in out)[:n])
        assert sorted(r.id for r in selection.first_in_order(df, n, [F.col("id")]).collect()) == sorted(i for i, _ in out)[:n]


@pytest.mark.parametrize("target", [0, 1, 5, 44, 45, 300, 1500, 3002, 9999])
def test_round_robin_equals_turns_taken_by_hand(rows, target, monkeypatch):
    monkeypatch.setattr(selection, "BUCKET", 20)
    monkeypatch.setattr(selection, "FEW", 0)
    out, df = rows
    groups = collections.defaultdict(list)
    for i, g in out:
        groups[g].append((digest(i), i))
    order = sorted(groups, key=lambda g: (g is not None, g or ""))
    want = [(g, i, t + 1) for t in range(3002) for g in order for _, i in sorted(groups[g])[t : t + 1]][:target]
    got = sampling.round_robin(df, "g", target, 5, "id").collect()
    assert sorted((str(r.g), r.id, r.turn) for r in got) == sorted((str(g), i, t) for g, i, t in want)


def test_selection_of_nothing(spark):
    none = spark.createDataFrame([], "id long, g string, _n int, _hash string")
    assert selection.first_of_each(none, ["g"], sampling.seeded(5, "id"), 3).count() == 0
    assert sampling.round_robin(none, "g", 4, 5, "id").count() == 0
