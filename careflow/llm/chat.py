"""Chat formatting by minimum-cost role repair.

A legal conversation has at most one system turn, at its start, then user and assistant
turns that alternate, beginning with user and ending with assistant. Dynamic programming
over that automaton chooses, for every turn, whether to keep it, relabel it, or merge it
into the turn before, and where to insert an empty turn, at the least total cost.

A conversation may be long. Its turns are range-partitioned and sorted; every partition
sums up its first and its last conversation as a matrix of least costs between automaton
states. The matrices, one row per partition and conversation end, are chained, and each
partition then repairs its part between the states so found.
"""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from careflow.session import materialise

# The roles, and other names of them found in the wild.
ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
KEEP, RELABEL, MERGE, INSERT, UNKNOWN = 0, 3, 1, 2, 2
# States: before the first turn, and after a turn of each role.
START, STATES, FAR = 3, 4, 1 << 40


def role_of(role: str | None) -> int:
    """Place of a role in ROLES; -1 for null and unknown ones, which any relabel suits."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def _next(state: int, role: int) -> tuple[int, ...] | None:
    """Roles of the empty turns needed before `role` may follow; None if it never may."""
    if role == 0:
        return () if state == START else None
    if role == 1:
        return (2,) if state == 1 else ()
    return (1,) if state in (0, START, 2) else ()


def steps(state: int, role: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """What may be done with a turn of `role` in `state`: (next state, cost, action, inserted roles)."""
    out = []
    for new in range(3):
        inserted = _next(state, new)
        if inserted is not None:
            cost = KEEP if new == role else UNKNOWN if role < 0 else RELABEL
            out.append((new, cost + INSERT * len(inserted), "keep" if new == role else "relabel", inserted))
    if state != START and role in (state, -1):
        out.append((state, MERGE, "merge", ()))
    return out


STEPS = {(state, role): steps(state, role) for state in range(STATES) for role in (-1, 0, 1, 2)}
# Cost and inserted roles to end a conversation in each state.
END = {0: (2 * INSERT, (1, 2)), 1: (INSERT, (2,)), 2: (0, ()), START: (FAR, ())}


def walk(roles: list[int], entry: int) -> list[list[tuple[int, int]]]:
    """Least (cost, inserted turns) to reach each state after each turn, from `entry`."""
    rows = [[(FAR, 0)] * STATES]
    rows[0][entry] = (0, 0)
    for role in roles:
        row = [(FAR, 0)] * STATES
        for state, (cost, turns) in enumerate(rows[-1]):
            if cost < FAR:
                for new, more, _, inserted in STEPS[state, role]:
                    row[new] = min(row[new], (cost + more, turns + len(inserted)))
        rows.append(row)
    return rows


def actions(roles: list[int], entry: int, exit_state: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """(role, action, roles inserted before) per turn on a least path between the states."""
    rows, out, at = walk(roles, entry), [], exit_state
    for i in range(len(roles), 0, -1):
        goal = rows[i][at]
        for state, (cost, turns) in enumerate(rows[i - 1]):
            hit = next(
                (s for s in STEPS[state, roles[i - 1]] if s[0] == at and (cost + s[1], turns + len(s[3])) == goal), None
            ) if cost < FAR else None
            if hit:
                out.append((at, hit[2], hit[3]))
                at = state
                break
    return out[::-1]


def header(role: int) -> str:
    return f"<|im_start|>{ROLES[role]}\n"


CLOSE = "<|im_end|>\n"
SUMMARY = "part int, piece int, conv_id bigint, entry int, costs array<bigint>, turns array<bigint>, n bigint"
REPAIRED = "conv_id bigint, position bigint, turn bigint, role string, action string, rendered string"


def _fragments(batches):
    """(index in the partition, conv_id, [(turn, role, text)]) of sorted Arrow batches."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")))

    for i, (conv, turns) in enumerate(groupby(rows(), key=lambda r: r[0])):
        yield i, conv, ((turn, role, text) for _, turn, role, text in turns)


def summarise(batches):
    """Of the partition's first and last conversation: least cost and inserted turns from each entry to each exit.

    Only these two may go on in another partition.
    """
    part, ends = TaskContext.get().partitionId(), {}
    for i, conv, turns in _fragments(batches):
        ends[min(i, 1)] = (i, conv, [role_of(r) for _, r, _ in turns])
    for i, conv, roles in ends.values():
        found = [walk(roles, entry)[-1] for entry in range(STATES)]
        columns = (
            [part] * STATES, [i] * STATES, [conv] * STATES, range(STATES), [[c for c, _ in row] for row in found],
            [[t for _, t in row] for row in found], [len(roles)] * STATES,
        )
        counts = pa.list_(pa.int64())
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), counts, counts, pa.int64())
        names = [x.split()[0] for x in SUMMARY.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def chain(parts: list[dict]) -> list[tuple[int, int, int, bool]]:
    """(entry, exit, position before, last) of each part of one conversation, parts in order."""
    row, rows = [(FAR, 0)] * STATES, []
    row[START] = (0, 0)
    for p in parts:
        rows.append(row)
        new = [(FAR, 0)] * STATES
        for e, (cost, turns) in enumerate(row):
            for x in range(STATES):
                if cost < FAR and p["costs"][e][x] < FAR:
                    new[x] = min(new[x], (cost + p["costs"][e][x], turns + p["turns"][e][x]))
        row = new
    at = min(range(STATES), key=lambda s: (row[s][0] + END[s][0], row[s][1] + len(END[s][1]), s))
    goal, out = row[at], []
    for i in range(len(parts) - 1, -1, -1):
        p = parts[i]
        entry = next(
            e for e, (cost, turns) in enumerate(rows[i])
            if cost < FAR and (cost + p["costs"][e][at], turns + p["turns"][e][at]) == goal
        )
        before = rows[i][entry][1] + sum(q["n"] for q in parts[:i])
        out.append((entry, at, before, i == len(parts) - 1))
        at, goal = entry, rows[i][entry]
    return out[::-1]


def repair(plan: dict[tuple[int, int], tuple[int, int, int, bool]]):
    """Sorted Arrow batches to repaired turns. `plan` has the parts of conversations that partitions share."""

    def run(batches):
        part, out = TaskContext.get().partitionId(), []
        for i, conv, turns in _fragments(batches):
            turns = list(turns)
            roles = [role_of(r) for _, r, _ in turns]
            if (part, i) in plan:
                entry, leave, position, last = plan[part, i]
            else:
                matrix = {"costs": {}, "turns": {}, "n": len(roles)}
                for e in range(STATES):
                    row = walk(roles, e)[-1] if e == START else [(FAR, 0)] * STATES
                    matrix["costs"][e], matrix["turns"][e] = zip(*row)
                entry, leave, position, last = chain([matrix])[0]
            is_open = entry != START
            for (turn, _, text), (role, action, inserted) in zip(turns, actions(roles, entry, leave)):
                for extra in inserted:
                    out.append((conv, position, None, ROLES[extra], "insert", (CLOSE if is_open else "") + header(extra)))
                    position, is_open = position + 1, True
                head = "\n" if action == "merge" else (CLOSE if is_open else "") + header(role)
                out.append((conv, position, turn, ROLES[role], action, head + (text or "")))
                position, is_open = position + 1, True
            if last:
                for extra in END[leave][1]:
                    out.append((conv, position, None, ROLES[extra], "insert", CLOSE + header(extra)))
                    position += 1
                out[-1] = (*out[-1][:5], out[-1][5] + CLOSE)
            if len(out) > 5000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    names = [x.split()[0] for x in REPAIRED.split(", ")]
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def format_chats(turns: DataFrame) -> DataFrame:
    """Repaired turns: conv_id, position (from 0), turn (null where inserted), role, action, rendered.

    The `rendered` texts of a conversation, put together by position, are the whole chat.
    Turns are taken in the order of (turn, role, text), nulls first; repeated rows are turns
    of their own. A null role or one that is not known costs less to relabel. Null text is
    empty. Null conv_id is a conversation like any other. No rows give no rows; other
    columns are not read.
    """
    wanted = turns.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    # The row's own number lets equal turns of one conversation fall to several partitions.
    order = ["conv_id", "turn", "role", "text", "__row"]
    wanted = wanted.withColumn("__row", F.monotonically_increasing_id())
    staged = materialise(wanted.repartitionByRange(*order).sortWithinPartitions(*order).drop("__row"))
    # At most eight rows per partition.
    rows = staged.mapInArrow(summarise, SUMMARY).orderBy("part", "piece", "entry").collect()
    shared: dict = {}
    for r in rows:
        part = shared.setdefault(r["conv_id"], {}).setdefault((r["part"], r["piece"]), {"costs": {}, "turns": {}, "n": r["n"]})
        part["costs"][r["entry"]], part["turns"][r["entry"]] = r["costs"], r["turns"]
    plan = {}
    for parts in shared.values():
        plan |= dict(zip(parts, chain(list(parts.values()))))
    return staged.mapInArrow(repair(plan), REPAIRED)
