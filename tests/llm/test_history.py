"""Versions against a day-by-day brute force: late corrections, deletes, ties, nulls, hot keys."""

import random

from glasshouse.llm.history import versions

SCHEMA = "key long, start long, kind string, days long, value string, h long, day string, released int"


def brute(changes):
    found = []
    for key in {c[0] for c in changes if c[0] is not None}:
        mine = [c for c in changes if c[0] == key and c[1] is not None]
        order = lambda c: (c[5], c[2] == "update", c[4] is not None, c[4] or "")
        runs, last = [], None
        for day in range(-5, 60):
            covering = [c for c in mine if c[2] == "correction" and c[3] and c[3] > 0 and c[1] <= day < c[1] + c[3]]
            base = [c for c in mine if c[2] in ("update", "delete") and c[1] <= day]
            c = max(covering, key=order) if covering else max(base, key=lambda c: (c[1], order(c)), default=None)
            state = None if c is None or c[2] == "delete" else (c[4],)
            if state != last:
                if last is not None:
                    runs[-1][1] = day
                if state is not None:
                    runs.append([day, None, state[0]])
            last = state
        found += [(key, i + 1, *run) for i, run in enumerate(runs)]
    return sorted(found, key=repr)


def got(spark, changes):
    df = versions(spark.createDataFrame(changes, SCHEMA), ["h"])
    assert df.columns == ["key", "version", "valid_from", "valid_to", "value"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_changes(spark):
    rng = random.Random(3)
    changes = []
    for _ in range(600):
        kind = rng.choice(["update", "delete", "correction", "correction", "other", None])
        changes.append((rng.choice([None, *range(25)]), rng.choice([None, *range(-3, 30)]), kind, rng.choice([None, 0, -2, 1, 4, 9]), rng.choice([None, "", "a", "b", "x" * 5000]), rng.randrange(40), "clash", 7))
    changes += changes[:50]  # repeated rows
    assert got(spark, changes) == brute(changes)


def test_one_key_has_most_changes(spark):
    rng = random.Random(4)
    changes = [(1, rng.randrange(40), rng.choice(["update", "delete", "correction"]), 5, rng.choice("abc"), h, "", 0) for h in range(3000)] + [(2, 3, "update", None, None, 1, "", 0)]
    assert got(spark, changes) == brute(changes)


def test_null_is_a_value_and_delete_is_none(spark):
    changes = [(1, 0, "update", None, None, 1, "", 0), (1, 5, "delete", None, "x", 2, "", 0), (1, 6, "correction", 2, None, 0, "", 0), (1, 9, "update", None, None, 3, "", 0)]
    assert got(spark, changes) == [(1, 1, 0, 5, None), (1, 2, 6, 8, None), (1, 3, 9, None, None)]


def test_adjoining_equal_values_are_one_version(spark):
    changes = [(1, 0, "update", None, "a", 1, "", 0), (1, 3, "correction", 2, "a", 9, "", 0), (1, 5, "update", None, "a", 3, "", 0), (1, 7, "update", None, "b", 2, "", 0)]
    assert got(spark, changes) == [(1, 1, 0, 7, "a"), (1, 2, 7, None, "b")]


def test_empty(spark):
    assert got(spark, []) == []
