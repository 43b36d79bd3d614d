"""Repair of conversations against a plain shortest-path search; fragments and whole conversations alike."""

import hashlib
import heapq
import random
from collections import defaultdict

import pytest
from glasshouse.llm.turns import damaged, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, i int"
SPACE = " \t\n\x0b\x0c\r"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(turns):
    """Least cost and least audit by a search over (turns done, state), edit by edit."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, out
        if (i, state) in done:
            continue
        done.add((i, state))
        other = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[other]
        heapq.heappush(heap, (cost + 2, audit + "I", i, other, (*out, (full, ""))))
        if i < len(turns):
            role, text, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[state, role[:1]], (*out, (role, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, other, (*out, (full, text))))
    raise AssertionError


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by[conv].append((turn is not None, turn or 0, f"{' ' if role is None else role}:{' ' if text is None else text}", " " if role is None else role, " " if text is None else text, turn))
    result = {}
    for conv, mine in by.items():
        turns, seen, n = [], set(), defaultdict(int)
        for *_, role, text, _ in sorted(mine, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode())):
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            n[fault] += 1
            turns.append((role, text, fault))
        legal = sum((a[0][:1] + b[0][:1]) in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [m[-1] for m in mine if m[-1] is not None]
        cost, audit, out = cheapest(turns)
        said = "\n".join(f"{r}:{t}" for r, t in out)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        result[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], len(turns) - 1 - legal, cost, audit, hashlib.sha256(said.encode()).hexdigest()), out
    return result


def conversations(seed, count=150, longest=9):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Assistant", "svc", "u:x"]
    texts = ["Yes.", "No!", "Why?", "so", "", None, " \t\n", "É. ", "a:b", "x" * 2000 + ".", "\x0b\x0c\r"]
    rows = []
    for conv in [None, *range(count)]:
        for turn in range(rng.randrange(1, longest)):
            row = (conv, rng.choice([turn, turn, turn, turn + 20, None]), rng.choice(roles[: rng.choice([3, 11])]), rng.choice([*texts, f"own {turn}.", f"own {turn}?"]), "clash", 1)
            rows += [row] * rng.choice([1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("fragment", [4096, 2])
def test_against_search(spark, fragment):
    rows = conversations(fragment)
    rows += [(1000, i, ["user", "assistant"][i % 2], f"Turn {i // (1 + i % 3)}.", "", 0) for i in range(300)]  # longer than a fragment of 2
    want = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair(spark, df, fragment=fragment).collect()}
    assert got == {k: v[0] for k, v in want.items()}


def test_turns_that_stand(spark):
    rows = conversations(9, 60)
    turns = defaultdict(list)
    for r in repaired_turns(spark, spark.createDataFrame(rows, SCHEMA), fragment=3).orderBy("part", "piece", "place").collect():
        turns[r.conv_id].append((r.role, r.text))
    assert dict(turns) == {k: list(v[1]) for k, v in brute(rows).items() if v[1]}


def test_turns_that_repeat_across_fragments_of_a_hot_conversation(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Said {i % 40}.", "", 0) for i in range(2000)] + [(2, 0, "user", "Hi.", "", 0)]
    got = {r[0]: tuple(r)[1:] for r in repair(spark, spark.createDataFrame(rows, SCHEMA), fragment=16).collect()}
    assert got == {k: v[0] for k, v in brute(rows).items()}


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", f"One. Two! {t}?", "", 0) for c in [None, *range(40)] for t in [None, 0, 1, 2]] + [(77, 0, None, None, "", 0)]
    got = sorted((tuple(r) for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    want = []
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else text.replace(".", "").replace("!", "").replace("?", "") if kind == 2 else text
        want.append((conv, turn, "user" if kind == 4 else role, text, {0: 0, 3: 2}.get(kind, 1)))
    assert got == sorted(want, key=repr)


def test_conversation_without_turns_and_empty_table(spark):
    rows = spark.createDataFrame([(5, 0, "user", "Gone.", 0), (6, 0, "user", "Hi.", 1)], "conv_id long, turn long, role string, text string, copies int")
    got = {r.conv_id: tuple(r)[1:] for r in repair(spark, rows).collect()}
    assert got[5] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[6][6] == "KI" and got[6][5] == 2
    assert repair(spark, rows.limit(0)).collect() == []
