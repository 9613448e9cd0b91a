"""Chat formatting with minimum-cost role repair.

The legal-turn automaton has a state per last role: after the start a system or user turn may
follow, after system a user turn, then assistant and user turns by turns.  A turn may keep its
role, take another (``RELABEL``), join the turn before it (``MERGE``) or have empty turns put
before it (``INSERT`` each).  Each turn is thus a cost matrix between states and a conversation's
repair a shortest path.

Shortest paths compose by min-plus products, so no conversation has to fit one task: rows are
dealt by range of (conversation, turn), each partition reduces its part of a conversation to one
matrix, a conversation cut by partition borders is decided from those matrices (at most one per
partition), and each part then fills in its own path between the states found at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fbrank.llm.frames import column, settled

ROLES = ("system", "user", "assistant")
START = 0  # state; the others are 1 + the index of the last role
STATES = 1 + len(ROLES)
MERGE, RELABEL, INSERT = 1, 2, 3
#: a turn becomes a system turn only where nothing else is nearly as cheap
TO_SYSTEM = 2
FAR = 10**9
_LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

OUT = "conv_id {0}, turn {1}, place long, role string, new_role string, action string, inserted array<string>, cost int, rendered string"


def _between() -> dict[tuple[int, int], tuple[int, ...]]:
    """Fewest empty turns that lead legally from a state to a turn's state (the turn itself left out)."""
    paths = {(s, t): () for s, t in _LEGAL}
    for _ in range(STATES):
        for (s, t), way in list(paths.items()):
            for u in range(1, STATES):
                if (t, u) in _LEGAL and len(way) + 1 < len(paths.get((s, u), range(99))):
                    paths[s, u] = (*way, t)
    return paths


BETWEEN = _between()


def step(role: str | None, s: int, t: int) -> tuple[int, str, tuple[int, ...]]:
    """Cheapest way for a turn of ``role`` to lead from state ``s`` to ``t``: cost, action, empty turns before it."""
    if t == START:
        return FAR, "", ()
    relabel = 0 if role == ROLES[t - 1] else RELABEL + (TO_SYSTEM if t == 1 else 0)
    name = "relabel" if relabel else "keep"
    ways = [(relabel + INSERT * len(BETWEEN[s, t]), name, BETWEEN[s, t])] if (s, t) in BETWEEN else []
    if s == t:
        ways.append((relabel + MERGE, "merge+relabel" if relabel else "merge", ()))
    return min(ways, default=(FAR, "", ()), key=lambda w: w[0])


_COST = {r: np.array([[step(r, s, t)[0] for t in range(STATES)] for s in range(STATES)], np.int64) for r in (*ROLES, None)}


def _matrix(role: str | None) -> np.ndarray:
    return _COST.get(role, _COST[None])


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def best_path(roles: list[str | None], s: int, t: int | None) -> list[int]:
    """States after each turn of a cheapest path from ``s`` (to ``t`` if given); ties go to the lower state."""
    cost = np.full(STATES, FAR)
    cost[s] = 0
    back = []
    for r in roles:
        ways = cost[:, None] + _matrix(r)
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    at = int(cost.argmin()) if t is None else t
    path = [at]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    return path[::-1] if roles else []


def safe(text: str | None) -> str:
    """Text whose ``<|`` cannot pass for a mark."""
    return (text or "").replace("<|", "< |")


def render(role: str | None, text: str | None, s: int, t: int, last: bool) -> tuple[str, list[str], int, str]:
    """Action, inserted roles, cost and this turn's part of the rendered conversation."""
    cost, action, empty = step(role, s, t)
    if action.startswith("merge"):
        out = "\n" + safe(text)
    else:
        out = ("\n" + CLOSE if s != START else "") + "".join(OPEN.format(ROLES[e - 1]) + "\n" + CLOSE for e in empty) + OPEN.format(ROLES[t - 1]) + safe(text)
    return action, [ROLES[e - 1] for e in empty], cost, out + ("\n" + CLOSE if last else "")


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, parts, flat, turns, kind = [], [], [], [], None
    for batch in batches:
        kind = batch.schema.field(0).type
        key = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), strict=True))
        role = batch.column(2).to_pylist()
        for (part, c), run in groupby(range(len(key)), key=key.__getitem__):
            m, n = None, 0
            for i in run:
                n += 1
                m = _matrix(role[i]) if m is None else min_plus(m, _matrix(role[i]))
            if parts and parts[-1] == part and conv[-1] == c:
                flat[-1] = min_plus(np.array(flat[-1]).reshape(STATES, STATES), m).ravel().tolist()
                turns[-1] += n
            else:
                conv.append(c), parts.append(part), flat.append(m.ravel().tolist()), turns.append(n)
    if conv:
        yield pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(parts, pa.int32()), pa.array(flat, pa.list_(pa.int64())), pa.array(turns, pa.int64())],
                                         names=["conv_id", "part", "m", "turns"])


def _ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """States before and after each part of one conversation on a cheapest whole path, and the turns before it."""
    table = table.sort_by("part")
    mats = [np.array(m).reshape(STATES, STATES) for m in table.column("m").to_pylist()]
    cost, back = np.full(STATES, FAR), []
    cost[START] = 0
    for m in mats:
        ways = cost[:, None] + m
        back.append(ways.argmin(axis=0))
        cost = np.minimum(ways.min(axis=0), FAR)
    after = [int(cost.argmin())]
    for b in reversed(back):
        after.append(int(b[after[-1]]))
    after.reverse()
    n = len(mats)
    return pa.table({"part_conv": pa.array([key[0].as_py()] * n, table.schema.field("conv_id").type), "part": table.column("part"),
                     "before": pa.array(after[:-1], pa.int32()), "after": pa.array(after[1:], pa.int32()),
                     "ends": pa.array([i == n - 1 for i in range(n)], pa.bool_()),
                     "earlier": pa.array(np.cumsum([0, *table.column("turns").to_pylist()[:-1]]), pa.int64())})


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``conv, turn, role, text, part, before, after, ends, earlier`` of a sorted partition to the result's."""
    kinds = None

    def rows():
        nonlocal kinds
        for b in batches:
            kinds = kinds or (b.schema.field(0).type, b.schema.field(1).type)
            yield from zip(*(b.column(i).to_pylist() for i in range(9)), strict=True)

    def flush(out):
        cols = list(zip(*out, strict=True))
        types = [*kinds, pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
        names = ["conv_id", "turn", "place", "role", "new_role", "action", "inserted", "cost", "rendered"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    out: list[tuple] = []
    for _, run in groupby(rows(), key=lambda r: (r[4], r[0])):
        turns = list(run)
        before, after, ends, earlier = turns[0][5:9]
        s = START if before is None else before
        path = best_path([r[2] for r in turns], s, after)
        for i, (r, t) in enumerate(zip(turns, path, strict=True)):
            action, inserted, cost, text = render(r[2], r[3], s, t, i == len(turns) - 1 and ends is not False)
            out.append((r[0], r[1], (earlier or 0) + i, r[2], ROLES[t - 1], action, inserted, cost, text))
            s = t
        if len(out) >= 2000:
            yield flush(out)
            out = []
    if out:
        yield flush(out)


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per row of ``turns``: ``conv_id, turn, place, role, new_role, action, inserted, cost, rendered``.

    ``rendered`` is the turn's part: the parts of a conversation in order of ``place``, which counts its
    rows from 0, are its formatted text.  Rows are placed by turn, then role; rows that tie in both get some
    order, and equal rows are told apart by their places alone.  Turns that are null come last; a null or unknown role must be relabelled;
    a null text is rendered empty, a very long one whole; repeated rows are turns of their own.  Rows whose
    conversation is null form one conversation.  Other columns are not read."""
    c = {n: column(turns, x) for n, x in (("conv_id", conv_col), ("turn", turn_col), ("role", role_col), ("text", text_col))}
    rows = turns.select(c["conv_id"].alias("conv_id"), c["turn"].alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.xxhash64("text").asc()]
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # equal rows too are dealt to several partitions
    dealt = settled(numbered.repartitionByRange(*order, F.col("row").asc()).sortWithinPartitions(*order, F.col("row").asc())
                    .select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part")))
    kinds = [f.dataType.simpleString() for f in dealt.schema.fields]
    reduced = dealt.select("conv_id", "part", "role").mapInArrow(_reduced, f"conv_id {kinds[0]}, part int, m array<bigint>, turns long")
    reduced = settled(reduced)
    cut = reduced.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("cut_conv"))
    parts = reduced.join(cut, F.col("conv_id").eqNullSafe(F.col("cut_conv"))).drop("cut_conv")
    ends = parts.groupBy("conv_id").applyInArrow(_ends, f"part_conv {kinds[0]}, part int, before int, after int, ends boolean, earlier long")
    # bounded: a partition border cuts one conversation, so there are less than two rows a partition
    joined = dealt.alias("d").join(F.broadcast(ends.withColumnRenamed("part", "of_part")),
                                   F.col("conv_id").eqNullSafe(F.col("part_conv")) & (F.col("part") == F.col("of_part")), "left")
    return joined.select("conv_id", "turn", "role", "text", "part", "before", "after", "ends", "earlier").mapInArrow(_filled, OUT.format(*kinds[:2]))
