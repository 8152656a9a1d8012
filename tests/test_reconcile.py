"""Reconciling by digests, against the comparison of all points."""

from __future__ import annotations

import random

import pytest
from conftest import records

from tidemark.operators import quality

SCHEMA = "day int, kind string, point int, a double, b decimal(18,2)"
STEPS, KEYS = [["day"], ["day", "kind"]], ["day", "kind", "point"]


def by_digest(result, oracle, tolerance=0, steps=STEPS):
    found, compared = quality.reconcile_digest(result, oracle, steps, KEYS, ["a", "b"], tolerance)
    return records(found, *KEYS), [r["rows_compared"] for r in records(compared, "step")]


def drawn(seed):
    """Two results that differ in a few rows: lost, repeated, changed, null; also under null keys."""
    rng = random.Random(seed)
    rows = [(d, k, p, rng.choice([None, 0.5, float(rng.randrange(9))]), None) for d in (1, 2, 3, None) for k in ("x", "y", None) for p in range(5)]
    other = list(rows)
    for _ in range(rng.randrange(5)):
        at = rng.randrange(len(other))
        d, k, p, a, b = other[at]
        change = rng.randrange(4)
        other[at : at + 1] = [[], [other[at]] * 2, [(d, k, p, (a or 0) + 0.25, b)], [(d, k, p, None if a is not None else 0.0, b)]][change]
    rng.shuffle(other)
    return rows, other


@pytest.mark.parametrize("seed", range(5))
def test_same_findings(spark, seed):
    result, oracle = (spark.createDataFrame(r, SCHEMA) for r in drawn(seed))
    for tolerance in (0, 0.25):
        wanted = records(quality.reconcile(result, oracle, KEYS, ["a", "b"], tolerance), *KEYS)
        found, compared = by_digest(result, oracle, tolerance)
        assert found == wanted
        assert compared == sorted(compared, reverse=True) and compared[0] == result.count() + oracle.count()


def test_only_differing_branches_are_compared(spark):
    rows = [(d, k, p, 1.0, None) for d in range(10) for k in "xyz" for p in range(20)]
    other = [(d, k, p, 2.0 if (d, k, p) == (4, "y", 7) else a, b) for d, k, p, a, b in rows]
    found, compared = by_digest(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA))
    assert [(r["day"], r["kind"], r["point"]) for r in found] == [(4, "y", 7)] and compared == [1200, 120, 40]


def test_values_that_change_places_are_seen(spark):
    """A null beside a value, two values exchanged, and two equal rows against two equal others."""
    one = spark.createDataFrame([(1, "x", 1, 1.0, None), (1, "x", 2, 2.0, None)], "day int, kind string, point int, a double, b double")
    for changed in ([(1, "x", 1, None, 1.0), (1, "x", 2, 2.0, None)], [(1, "x", 1, 2.0, None), (1, "x", 2, 1.0, None)]):
        assert by_digest(one, spark.createDataFrame(changed, one.schema))[0]
    twice = [spark.createDataFrame([(1, "x", p, 1.0, None)] * 2, one.schema) for p in (1, 2)]
    assert len(by_digest(*twice)[0]) == 2


def test_order_and_partitions_do_not_matter(spark):
    rows, _ = drawn(1)
    one = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    other = spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    assert by_digest(one, other) == ([], [120, 0, 0])
    assert by_digest(one.limit(0), other.limit(0)) == ([], [0, 0, 0])


def test_steps_are_needed(spark):
    with pytest.raises(ValueError, match="steps"):
        by_digest(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], SCHEMA), steps=[])
