"""Repair of conversations: the cheapest edits after which the roles read (system? (user assistant)+)?.

A dynamic program over four states (start, behind a system turn, behind a user turn, behind an assistant turn) runs time-major on
NumPy tensors: conversations are bucketed by length, a bucket's turns lie side by side, and each step of time updates the costs of all
states of all its conversations at once, from the last turn backward.  The backward costs are kept; the edits are traced forward by them, again
for all conversations of a bucket at once, and of equally cheap edits take the one whose initial comes first in ASCII (Delete,
Insert, Keep, Rerole).

Turns are range-partitioned by conversation and order, so a conversation of any length is spread over partitions and arrives in
order.  Conversations that lie within a partition are solved there.  The first and last of each partition, and what is longer than
FRAGMENT turns, is cut into fragments: a fragment's costs form a 4 x 4 matrix from state to state, and the matrices, 16 numbers for up to
FRAGMENT turns, are combined for each conversation; then fragments are traced side by side.  Only the digest of a
conversation's text is taken in one task, as a stream.

Order: by turn, null first; of one turn by `role:text`, then role.  Rows equal in all of these count as that many turns; they are added
up before the shuffle.  Null role or text: one space.  Blank: no character but white space [\\x20\\x09-\\x0D].  Duplicate: role and text were seen
earlier in the conversation.  Truncated: the last character that is no white space is none of `.!?`.  The first fault counts.  Blank
and duplicate turns must go; truncated ones that stay cost one more.  A role counts by its first letter (s, u, a); others, the empty one among them,
can only be rewritten or go.  A null conv_id is a conversation like any other.  Texts are read whole.  A conversation without turns has
zeros, an empty audit and the digest of nothing; an empty table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasshouse.llm.common import drop, join_hot, partitions, written

#: Turns and bytes of text of a fragment; cells (turns x conversations) of one tensor.
FRAGMENT, FRAGMENT_BYTES, CELLS = 4096, 4 << 20, 1 << 18
START, SYSTEM, USER, ASSISTANT, NOWHERE = range(5)
#: The state behind a user or assistant turn that is put in or rewritten.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state behind a kept turn, by state and by the role's initial (s, u, a, another).
KEPT = np.array([[SYSTEM, USER, NOWHERE, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE], [NOWHERE, NOWHERE, ASSISTANT, NOWHERE], [NOWHERE, USER, NOWHERE, NOWHERE]])
#: Which initials may stand behind which.
LEGAL = np.zeros((4, 4), dtype=bool)
LEGAL[[0, 1, 2], [1, 2, 1]] = True
DELETE, INSERT, REROLE = 3, 2, 2
FAR = 1 << 50
END = [0, FAR, FAR, 0]
_SPACE = b" \t\n\x0b\x0c\r"
_D, _I, _K, _R = b"DIKR"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "cost"]
_LONGS = [*_COUNTS, "low", "high", "turns", "first_turn", "last_turn", "first_role", "last_role"]


class Turns:
    """The turns of several conversations, one behind the other; `first` has where each begins and the end."""

    def __init__(self, roles: list[str], texts: list[str], copies: np.ndarray, first: np.ndarray, seen: np.ndarray | None = None):
        self.roles, self.texts, self.first = roles, texts, first
        self.extra = copies - 1
        self.role = np.array([{"s": 0, "u": 1, "a": 2}.get(r[:1], 3) for r in roles], dtype=np.int64)
        ends = [t.encode().rstrip(_SPACE)[-1:] for t in texts]
        self.blank = np.array([not e for e in ends], dtype=bool)
        self.again = self._seen() if seen is None else seen
        self.forced = self.blank | self.again
        self.cut = ~self.forced & ~np.array([e in b".!?" for e in ends], dtype=bool)

    def _seen(self) -> np.ndarray:
        again = np.zeros(len(self.roles), dtype=bool)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            known: set = set()
            for i in range(a, b):
                turn = self.roles[i], self.texts[i]
                again[i] = turn in known
                known.add(turn)
        return again


def _relaxed(costs: np.ndarray) -> np.ndarray:
    """With turns put in where that is cheaper."""
    user = np.minimum(costs[USER], costs[ASSISTANT] + INSERT)
    assistant = np.minimum(costs[ASSISTANT], costs[USER] + INSERT)
    return np.stack([np.minimum(costs[START], user + INSERT), np.minimum(costs[SYSTEM], user + INSERT), user, assistant])


class Tensors:
    """One bucket of runs of turns, time-major; shorter runs are padded behind their end."""

    def __init__(self, turns: Turns, start: np.ndarray, size: np.ndarray, ends: np.ndarray):
        self.length = int(size.max())
        at = np.arange(self.length)[:, None]
        self.live = at < size
        self.at = np.where(self.live, start + at, 0)
        self.role, self.cut, self.forced, self.extra = (x[self.at] if len(x) else np.zeros(self.at.shape, x.dtype) for x in (turns.role, turns.cut, turns.forced, turns.extra))
        self.ahead = np.full((self.length + 1, 5, len(size)), FAR, dtype=np.int64)
        self.ahead[-1, :4] = _relaxed(ends)
        for t in range(self.length - 1, -1, -1):
            after = self.ahead[t + 1]
            kept = np.take_along_axis(after, KEPT[:, self.role[t]], 0) + self.cut[t]
            best = _relaxed(np.minimum(after[:4] + DELETE, np.minimum(kept, after[NEXT] + REROLE + self.cut[t])))
            costs = np.where(self.forced[t], after[:4] + DELETE, best) + DELETE * self.extra[t]
            self.ahead[t, :4] = np.where(self.live[t], costs, after[:4])

    def trace(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Whether a turn is put in before each, the edit of each, the state before that edit; and the states at the end."""
        shape, who = self.role.shape, np.arange(self.role.shape[1])
        puts, edits, states = np.zeros(shape, bool), np.zeros(shape, np.uint8), np.zeros(shape, np.int64)
        for t in range(self.length):
            now, after, extra = self.ahead[t], self.ahead[t + 1], DELETE * self.extra[t]
            here, following = now[state, who], NEXT[state]
            gone = self.forced[t] | (after[state, who] + DELETE + extra == here)
            put = ~gone & (now[following, who] + INSERT == here)
            there = np.where(put, following, state)
            kept = KEPT[there, self.role[t]]
            keep = ~gone & (after[kept, who] + self.cut[t] + extra == now[there, who])
            live = self.live[t]
            puts[t], states[t] = put & live, there
            edits[t] = np.where(live, np.where(gone, _D, np.where(keep, _K, _R)), 0)
            state = np.where(live, np.where(gone, there, np.where(keep, kept, NEXT[there])), state)
        return puts, edits, states, state


def buckets(turns: Turns, start: np.ndarray, size: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, Tensors]]:
    """The runs of turns by length, and their tensors with costs; at most CELLS cells at once, or one run."""
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        longest = 1 << int(size[order[a]]).bit_length()
        b = int(np.searchsorted(size[order], longest))
        b = min(b, a + max(1, CELLS // longest))
        yield order[a:b], Tensors(turns, start[order[a:b]], size[order[a:b]], ends[:, order[a:b]])
        a = b


class Edits:
    """The cheapest edits of each conversation from a state to the costs of its end."""

    def __init__(self, turns: Turns, ends: np.ndarray, state: np.ndarray):
        self.turns, n, runs = turns, len(turns.roles), len(turns.first) - 1
        self.put, self.edit, self.before = np.zeros(n, bool), np.zeros(n, np.uint8), np.zeros(n, np.int64)
        self.after, self.cost = state.copy(), np.zeros(runs, np.int64)
        for which, tensors in buckets(turns, turns.first[:-1], np.diff(turns.first), ends):
            put, edit, before, after = tensors.trace(state[which])
            at = tensors.at[tensors.live]
            self.put[at], self.edit[at], self.before[at] = put[tensors.live], edit[tensors.live], before[tensors.live]
            who = np.arange(len(which))
            self.after[which], self.cost[which] = after, tensors.ahead[0, state[which], who] - tensors.ahead[-1, after, who]

    def audits(self) -> list[bytes]:
        letters = np.stack([np.full(len(self.edit), _I, np.uint8), self.edit, np.full(len(self.edit), _D, np.uint8)], 1).reshape(-1)
        many = np.stack([self.put.astype(np.int64), np.ones(len(self.edit), np.int64), self.turns.extra], 1)
        cuts = np.r_[0, np.cumsum(many.sum(1))][self.turns.first].tolist()
        data = np.repeat(letters, many.reshape(-1)).tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def repaired(self, run: int) -> list[tuple[str, str, str]]:
        """Edit, role and text of each turn that stands afterwards."""
        out = []
        for i in range(int(self.turns.first[run]), int(self.turns.first[run + 1])):
            if self.put[i]:
                out.append(("I", _name(self.before[i]), ""))
            if self.edit[i] == _K:
                out.append(("K", self.turns.roles[i], self.turns.texts[i]))
            elif self.edit[i] == _R:
                out.append(("R", _name(NEXT[self.before[i]]), self.turns.texts[i]))
        return out


def _name(state: int) -> str:
    return "user" if state == USER else "assistant"


#: What is put in behind the last turn, by the state there.
TAILS = {START: [], SYSTEM: [("I", "user", ""), ("I", "assistant", "")], USER: [("I", "assistant", "")], ASSISTANT: []}


def _lines(turns: list[tuple[str, str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for _, role, text in turns).encode()


def _counts(turns: Turns, when: list, run: int) -> dict[str, int | None]:
    a, b = int(turns.first[run]), int(turns.first[run + 1])
    blank, forced, extra, role = turns.blank[a:b], turns.forced[a:b], turns.extra[a:b], turns.role[a:b]
    known = [x for x in when[a:b] if x is not None]
    legal = LEGAL[role[:-1], role[1:]]
    return {
        "blank": int((extra[blank] + 1).sum()), "duplicate": int((extra[~blank] + forced[~blank]).sum()), "truncated": int(turns.cut[a:b].sum()),
        "illegal": int(extra.sum() + len(legal) - legal.sum()), "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
        "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "first_role": int(role[0]) if b > a else None, "last_role": int(role[-1]) if b > a else None,
    }


# --- the rows of a range partition: whole conversations, and fragments of those that may go on elsewhere ---


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch added up."""
    for batch in batches:
        names = ["conv_id", "turn", "role", "text"]
        added = pa.Table.from_batches([batch]).group_by(names).aggregate([("copies", "sum")])
        yield from added.select([*names, "copies_sum"]).rename_columns([*names, "copies"]).combine_chunks().to_batches()


def _schema(key: str, turns: bool) -> str:
    longs = ", ".join(f"{c} long" for c in _LONGS)
    stands = "stands array<struct<edit: string, role: string, text: string>>" if turns else "digest string"
    return f"conv_id {key}, part int, piece int, {longs}, audit string, {stands}"


_ROWS = "roles array<string>, texts array<string>, whens array<long>, copies array<long>"


def _table(rows: list[dict], like: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=like)


def _whole(key: list, table: pa.Table, first: np.ndarray, stands: bool) -> list[dict]:
    """Conversations that lie in one place, solved; `first` has where each begins, rows of no copies are none."""
    copies = table.column("copies").to_numpy()
    some = copies > 0
    bounds = np.r_[0, np.cumsum(some)][first]
    rest = table.filter(pa.array(some))
    turns = Turns(rest.column("role").to_pylist(), rest.column("text").to_pylist(), copies[some], bounds)
    runs = len(first) - 1
    edits = Edits(turns, np.tile(np.array(END)[:, None], runs), np.zeros(runs, np.int64))
    audits, when, out = edits.audits(), rest.column("turn").to_pylist(), []
    for i in range(runs):
        tail = TAILS[int(edits.after[i])]
        turn = edits.repaired(i) + tail
        row = {"conv_id": key[i], **_counts(turns, when, i), "cost": int(edits.cost[i]) + INSERT * len(tail), "audit": audits[i].decode() + "I" * len(tail)}
        out.append(row | ({"stands": [dict(zip(("edit", "role", "text"), x, strict=True)) for x in turn]} if stands else {"digest": hashlib.sha256(_lines(turn)).hexdigest()}))
    return out


def _fragments(arrow: pa.Schema, stands: bool, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, pieces = TaskContext.get().partitionId(), 0
        held, opened = None, None  # rows of the last conversation so far; the conversation that may have begun before them, in a list

        def fragment(rows: pa.Table) -> pa.RecordBatch:
            nonlocal pieces
            pieces += 1
            some = rows.filter(pa.array(rows.column("copies").to_numpy() > 0))
            lists = {"roles": "role", "texts": "text", "whens": "turn", "copies": "copies"}
            return _table([{"conv_id": rows.column("conv_id")[0].as_py(), "part": part, "piece": pieces, **{k: some.column(v).to_pylist() for k, v in lists.items()}}], arrow)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
            keys = held.column("conv_id").to_pylist()
            opened = opened or [keys[0]]
            first = np.flatnonzero([i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))])
            last = int(first[-1])
            begin = 0
            if keys[0] == opened[0] and last:  # goes on with a conversation that is open, and ends here
                begin = int(first[1])
                yield from (fragment(held.slice(a, min(most, begin - a))) for a in range(0, begin, most))
                first = first[1:]
            if begin < last:
                found = _whole([keys[i] for i in first[:-1]], held.slice(begin, last - begin), first - begin, stands)
                yield _table(found, arrow)
            held = held.slice(last)
            if held.num_rows > most or held.nbytes > FRAGMENT_BYTES:
                opened = [keys[-1]]
                yield from (fragment(held.slice(a, most)) for a in range(0, held.num_rows, most))
                held = None
        if held is not None and held.num_rows:
            yield from (fragment(held.slice(a, most)) for a in range(0, held.num_rows, most))

    return work


# --- fragments of one conversation, combined by their matrices ---


def _opened(batch: pa.RecordBatch, row: int) -> tuple[Turns, list]:
    value = {c: batch.column(c)[row].as_py() for c in ("roles", "texts", "whens", "copies", "seen")}
    seen = np.zeros(len(value["roles"]), dtype=bool)
    seen[value["seen"] or []] = True
    return Turns(value["roles"], value["texts"], np.array(value["copies"], dtype=np.int64), np.array([0, len(seen)]), seen), value["whens"]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's costs from each state (within) to each state."""
    for batch in batches:
        costs = []
        for row in range(batch.num_rows):
            turns, _ = _opened(batch, row)
            ends = np.where(np.eye(4, dtype=bool), 0, FAR)
            tensors = Tensors(turns, np.zeros(4, np.int64), np.full(4, len(turns.roles)), ends)
            costs.append(tensors.ahead[0, :4].T.reshape(-1).tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("piece"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "costs"])


def _ends(rows: pa.Table) -> pa.Table:
    """The costs from each fragment's end to the conversation's end, by state there."""
    rows = rows.sort_by([("part", "ascending"), ("piece", "ascending")])
    costs, ends = _relaxed(np.array(END)[:, None])[:, 0], []
    for matrix in rows.column("costs").to_pylist()[::-1]:
        ends.append(costs.tolist())
        costs = np.minimum((np.array(matrix).reshape(4, 4) + costs[:, None]).min(0), FAR)
    return pa.table({"part": rows.column("part"), "piece": rows.column("piece"), "ends": pa.array(ends[::-1], pa.list_(pa.int64()))})


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state behind a fragment, by the state before it."""
    for batch in batches:
        exits = []
        for row in range(batch.num_rows):
            turns, _ = _opened(batch, row)
            ends = np.tile(np.array(batch.column("ends")[row].as_py())[:, None], 4)
            tensors = Tensors(turns, np.zeros(4, np.int64), np.full(4, len(turns.roles)), ends)
            exits.append(tensors.trace(np.arange(4))[3].tolist())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("piece"), pa.array(exits, pa.list_(pa.int64()))], names=["conv_id", "part", "piece", "exits"])


def _entries(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("part", "ascending"), ("piece", "ascending")])
    state, entries = START, []
    for exits in rows.column("exits").to_pylist():
        entries.append(state)
        state = exits[state]
    is_last = [False] * (len(entries) - 1) + [True]
    return pa.table({"part": rows.column("part"), "piece": rows.column("piece"), "entry": pa.array(entries, pa.int64()), "is_last": pa.array(is_last)})


def _traced(arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                turns, when = _opened(batch, row)
                edits = Edits(turns, np.array(batch.column("ends")[row].as_py())[:, None], np.array([batch.column("entry")[row].as_py()]))
                tail = TAILS[int(edits.after[0])] if batch.column("is_last")[row].as_py() else []
                stands = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in edits.repaired(0) + tail]
                same = {c: batch.column(c)[row].as_py() for c in ("conv_id", "part", "piece")}
                yield _table([same | _counts(turns, when, 0) | {"cost": int(edits.cost[0]) + INSERT * len(tail), "audit": edits.audits()[0].decode() + "I" * len(tail), "stands": stands}], arrow)

    return work


def _joined(arrow: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Fragments in order, as one row a conversation: counts added up, the digest taken as a stream."""

    def begin(row: dict) -> dict:
        return {"conv_id": row["conv_id"], **dict.fromkeys(_LONGS), **dict.fromkeys(_COUNTS, 0), "turns": 0, "audit": [], "digest": hashlib.sha256(), "any": False}

    def add(of: dict, row: dict) -> None:
        for c in _COUNTS:
            of[c] += row[c]
        if row["first_role"] is not None:
            if of["last_role"] is not None:
                of["illegal"] += int(not LEGAL[of["last_role"], row["first_role"]])
            of["last_role"] = row["last_role"]
        if row["low"] is not None:
            of["turns"] += row["turns"] - (of["last_turn"] == row["first_turn"])
            of["low"] = row["low"] if of["low"] is None else of["low"]
            of["high"], of["last_turn"] = row["high"], row["last_turn"]
        of["audit"].append(row["audit"])
        if row["stands"]:
            of["digest"].update(b"\n" * of["any"] + _lines([(x["edit"], x["role"], x["text"]) for x in row["stands"]]))
            of["any"] = True

    def done(of: dict) -> pa.RecordBatch:
        return _table([{k: v for k, v in of.items() if k != "any"} | {"audit": "".join(of["audit"]), "digest": of["digest"].hexdigest()}], arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if now is None or now["conv_id"] != row["conv_id"]:
                    if now is not None:
                        yield done(now)
                    now = begin(row)
                add(now, row)
        if now is not None:
            yield done(now)

    return work


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _solved(spark: SparkSession, rows: DataFrame, stands: bool, most: int) -> tuple[DataFrame, DataFrame, str]:
    """Conversations that lie in one partition, solved; the solved fragments of the others; the type of conv_id."""
    key = rows.schema["conv_id"].dataType.simpleString()
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    some = copies > 0
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.when(some, F.coalesce(F.col(c).cast("string"), F.lit(" "))).alias(c) for c in ("role", "text")], F.when(some, copies).otherwise(0).alias("copies"))
    added = plain.mapInArrow(_added, f"conv_id {key}, turn long, role string, text string, copies long")
    line = F.concat_ws(":", "role", "text")
    ranged = added.repartitionByRange(partitions(spark), "conv_id", "turn", F.substring(line, 1, 64)).sortWithinPartitions("conv_id", "turn", line, "role")
    schema = f"{_schema(key, stands)}, {_ROWS}"
    found = written(spark, ranged.mapInArrow(_fragments(_arrow(schema), stands, most), schema), "conversations")

    fragments = found.where("roles IS NOT NULL").select("conv_id", "part", "piece", "roles", "texts", "whens", "copies")
    turn = fragments.select("conv_id", "part", "piece", F.posexplode(F.arrays_zip("roles", "texts")).alias("i", "turn"))
    place = F.struct("part", "piece", "i")
    keyed = turn.select("part", "piece", "i", F.sha2(F.to_json(F.struct("conv_id", "turn")), 256).alias("same"))
    known = written(spark, keyed.groupBy("same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    seen = join_hot(keyed, known, "same", "n").where(place > F.col("first")).groupBy("part", "piece").agg(F.collect_list("i").alias("seen"))
    marked = written(spark, fragments.join(seen, ["part", "piece"], "left"), "fragments")
    matrices = marked.mapInArrow(_matrices, f"conv_id {key}, part int, piece int, costs array<long>")
    ends = written(spark, matrices.groupBy("conv_id").applyInArrow(_ends, "part int, piece int, ends array<long>"), "ends")
    exits = marked.join(ends, ["part", "piece"]).mapInArrow(_exits, f"conv_id {key}, part int, piece int, exits array<long>")
    entries = exits.groupBy("conv_id").applyInArrow(_entries, "part int, piece int, entry long, is_last boolean")
    pieces = _schema(key, True)
    traced = marked.join(ends, ["part", "piece"]).join(entries, ["part", "piece"]).mapInArrow(_traced(_arrow(pieces)), pieces)
    drop(known)
    return found.where("roles IS NULL"), traced, key


def repair(spark: SparkSession, rows: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """One row a conversation from rows(conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    A column `copies` says how often a row stands there (0: its conversation counts, but has no such turn)."""
    whole, traced, key = _solved(spark, rows, False, fragment)
    schema = _schema(key, False)
    ordered = traced.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "part", "piece")
    joined = ordered.mapInArrow(_joined(_arrow(schema)), schema)
    both = whole.select(*joined.columns).unionByName(joined)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    return both.select("conv_id", gaps, *_COUNTS, "audit", F.col("digest").alias("repaired_sha256"))


def repaired_turns(spark: SparkSession, rows: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """The turns that stand afterwards: conv_id, part, piece and place (their order within the conversation), edit, role and text."""
    whole, traced, _ = _solved(spark, rows, True, fragment)
    names = ["conv_id", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("piece", F.lit(0)).alias("piece"), F.posexplode("stands").alias("place", "turn")]
    both = whole.select(*names).unionByName(traced.select(*names))
    return both.select("conv_id", "part", "piece", "place", "turn.edit", "turn.role", "turn.text")


def damaged(rows: DataFrame) -> DataFrame:
    """The damage of the contract: by a hash of conversation and turn a row is dropped, emptied, loses its ends of sentences, stands twice or turns into a user's."""
    plain = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(name) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return plain.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))
