"""Chat formatting: minimum-cost repair of turn roles, then rendering.

A legal conversation has at most one system message, at its start, then user and assistant messages in turn, user
first, where an assistant message may be followed by tool messages that another assistant message follows; it ends
with an assistant message. A turn may keep its role, be relabelled, or be merged into the message before it; empty
messages may be inserted. Each has a cost, and the repair of least total cost is found by dynamic programming over the
automaton whose state is the role of the last message.

One step of it is a (min, +) product with a 5 x 5 matrix, so a conversation can be cut anywhere: turns are sorted over
ranges, each range multiplies the matrices of its first and last conversation, the products meet on the driver (two
for each range), and what they say of the borders lets each range trace its own part back. A conversation of any
length is so spread over as many tasks as it has rows for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, shuffle_partitions, small_batches

START, SYSTEM, USER, ASSISTANT, TOOL = range(5)
NAMES = ("", "system", "user", "assistant", "tool")
#: Messages that may follow a message; the start may have none before it.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER, TOOL), TOOL: (ASSISTANT,)}
#: Costs: an empty message; joining a turn to the message before it; a turn read as another role, and as another one with an unknown role.
INSERT, MERGE, RELABEL, UNKNOWN = 3, 1, 2, 1
#: Messages begin and end with these.
OPEN, CLOSE = "<|{}|>\n", "\n<|end|>\n"

_FAR = 10**9


def _ways() -> tuple[np.ndarray, list[list[tuple[int, ...]]]]:
    """Cost and roles of the fewest empty messages after which a state may be followed by a role; by role where equal."""
    cost = np.full((5, 5), _FAR)
    path: list[list[tuple[int, ...]]] = [[()] * 5 for _ in range(5)]
    for s in range(5):
        edge, seen = [(s, ())], {s}
        for depth in range(5):
            for at, way in edge:
                for role in NEXT[at]:
                    if cost[s, role] > depth * INSERT:
                        cost[s, role], path[s][role] = depth * INSERT, way
            edge = [(r, (*way, r)) for at, way in edge for r in NEXT[at] if r not in seen and not seen.add(r)]
    return cost, path


INSERTED, WAY = _ways()
#: Roles as read: the five states, START standing for an unknown one.
_READ = np.array([[_FAR] + [(UNKNOWN if role == START else 0 if role == r else RELABEL) for r in range(1, 5)] for role in range(5)])
#: Step matrices by read role: from the state before a turn to the state after it.
STEP = np.stack([np.minimum(INSERTED, np.where(np.eye(5, dtype=bool) & (np.arange(5) != START), MERGE, _FAR)) + _READ[role][None, :] for role in range(5)])
STEP = np.minimum(STEP, _FAR)
#: What the end costs in each state: nothing after an assistant's message, else the empty messages up to one.
FINISH = np.array([0 if s in (ASSISTANT, START) else INSERTED[s, ASSISTANT] + 0 + INSERT for s in range(5)])
FINISH_WAY = [() if s in (ASSISTANT, START) else (*WAY[s][ASSISTANT], ASSISTANT) for s in range(5)]


def code(role: str | None) -> int:
    """A role as a number; case and surrounding space don't count; null and other names are unknown."""
    name = (role or "").strip().lower()
    return NAMES.index(name) if name in NAMES[1:] else START


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def over(roles: np.ndarray) -> np.ndarray:
    """The matrix of a run of turns: pairs are multiplied until one is left."""
    m = STEP[roles]
    while len(m) > 1:
        odd = m[-1:] if len(m) % 2 else m[:0]
        pairs = m[: len(m) // 2 * 2]
        m = np.concatenate([np.minimum((pairs[::2, :, :, None] + pairs[1::2, None, :, :]).min(axis=2), _FAR), odd])
    return m[0]


def repaired(roles: np.ndarray, first: int = START, last: int | None = None) -> tuple[np.ndarray, int]:
    """The state after each turn on a cheapest way from state first to state last (None: to the end), and the cost of the turns.

    Of equally cheap ways the one that ends in the smaller state, looking back from the end, is taken.
    """
    cost = np.full(5, _FAR)
    cost[first] = 0
    back = np.zeros((len(roles), 5), np.int8)
    for i, role in enumerate(roles.tolist()):
        both = cost[:, None] + STEP[role]
        back[i] = both.argmin(axis=0)
        cost = np.minimum(both.min(axis=0), _FAR)
    state = int((cost + FINISH).argmin()) if last is None else last
    out, total = np.zeros(len(roles), np.int64), int(cost[state])
    for i in range(len(roles) - 1, -1, -1):
        out[i] = state
        state = int(back[i, state])
    return out, total


#: Turns in a range on average, at most.
RANGE = 50_000
_BORDER = "range int, side int, conv long, whole boolean, matrix array<int>"
_REPAIRED = "conv_id long, turn long, role string, new_role string, action string, inserted string, rendered string"


def _in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A range's rows in their order, their roles, and where each conversation starts and ends."""
    table = table.take(pa.array(np.argsort(np.array(table.column("place")))))
    conv = np.array(table.column("conv_key"))
    cut = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
    return table, np.array(table.column("role_code"), np.int64), cut, np.append(cut[1:], len(conv))


def _borders(table: pa.Table) -> pa.Table:
    """The first and the last conversation of a range, with the matrix of their turns in it."""
    table, roles, cut, ends = _in_order(table)
    sides = [(side, int(cut[k]), over(roles[cut[k] : ends[k]]).ravel().tolist()) for side, k in ((0, 0), (1, len(cut) - 1))]
    return pa.table({
        "range": table.column("range")[:1].combine_chunks().take(pa.array([0, 0])),
        "side": pa.array([x[0] for x in sides], pa.int32()),
        "conv": table.column("conv_key").take(pa.array([x[1] for x in sides])),
        "whole": pa.array([len(cut) == 1] * 2),
        "matrix": pa.array([x[2] for x in sides], pa.list_(pa.int32())),
    })


def border_states(rows: list[tuple[int, int, int, bool, list[int]]]) -> dict[tuple[int, int], tuple[int, int | None]]:
    """For the first (0) and last (1) conversation of each range: the state in which it comes in and the one in which it goes out.

    rows: range, side, conversation, whether it fills the range, matrix. None: it ends there.
    """
    parts = []  # the pieces in order: conversation, keys, matrix
    for where, side, conv, whole, matrix in sorted(rows):
        if side and whole:
            parts[-1][1].append((where, side))
        else:
            parts.append((conv, [(where, side)], np.array(matrix).reshape(5, 5)))
    out = {}
    i = 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j][0] == parts[i][0]:
            j += 1
        forward = [np.where(np.arange(5) == START, 0, _FAR)]
        for _, _, matrix in parts[i:j]:
            forward.append(np.minimum((forward[-1][:, None] + matrix).min(axis=0), _FAR))
        state = int((forward[-1] + FINISH).argmin())
        for k in range(j - 1, i - 1, -1):
            before = int((forward[k - i] + parts[k][2][:, state]).argmin())
            for key in parts[k][1]:
                out[key] = (before, None if k == j - 1 else state)
            state = before
        i = j
    return out


def _repairer(states):
    def run(table: pa.Table) -> pa.Table:
        table, roles, cut, ends = _in_order(table)
        where = table.column("range")[0].as_py()
        texts = table.column("text").to_pylist()
        new, actions, inserted, rendered = [], [], [], []
        empty = {r: OPEN.format(NAMES[r]) + CLOSE for r in range(1, 5)}
        for k, (i, j) in enumerate(zip(cut.tolist(), ends.tolist(), strict=True)):
            state, last = START, None
            if k in (0, len(cut) - 1):
                state, last = states.value[(where, 0 if k == 0 else 1)]
            for t, to in enumerate(repaired(roles[i:j], state, last)[0].tolist(), i):
                merge = to == state
                way = () if merge else WAY[state][to]
                tail = FINISH_WAY[to] if last is None and t == j - 1 else ()
                piece = "\n" if merge else ("" if state == START else CLOSE) + "".join(empty[r] for r in way) + OPEN.format(NAMES[to])
                piece += texts[t] or ""
                if last is None and t == j - 1:
                    piece += CLOSE + "".join(empty[r] for r in tail)
                new.append(NAMES[to])
                actions.append(("merge" if merge else "keep") + ("+relabel" if to != roles[t] else ""))
                inserted.append(",".join([NAMES[r] for r in way] + ["end:" + NAMES[r] for r in tail]))
                rendered.append(piece)
                state = to
        return pa.table({"conv_id": table.column("conv_id"), "turn": table.column("turn"), "role": table.column("role"), "new_role": pa.array(new), "action": pa.array(actions), "inserted": pa.array(inserted), "rendered": pa.array(rendered)})

    return run


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, new_role, action, inserted and rendered for each row of turns.

    turns needs conv_id, turn (integers), role and text; other columns are ignored. A conversation's formatted text is
    its rows' rendered pieces in the order of turn. action is keep or merge, with +relabel where the role changes;
    inserted names the empty messages before the turn and, as end:role, after the last one. A null conv_id is one
    conversation of its own; null turns come first; turns of one number are ordered by role, then by a hash of the text, and repeated
    rows stand one after the other. A null text is empty; null and unknown roles take whatever is cheapest. An empty
    table gives no rows.
    """
    spark = turns.sparkSession
    small_batches(spark)
    name = F.lower(F.trim("role"))
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in ((n, k) for k, n in enumerate(NAMES) if n) for x in pair)), F.coalesce(name, F.lit(""))), F.lit(START))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", number.cast("int").alias("role_code"), F.coalesce(F.col("conv_id").cast("long"), F.lit(-(1 << 63))).alias("conv_key"), F.xxhash64(F.monotonically_increasing_id()).alias("tie"))
    by = ["conv_key", "turn", "role", F.xxhash64("text")]
    ranges = max(shuffle_partitions(spark), -(-turns.count() // RANGE))
    ranged = rows.repartitionByRange(ranges, *by, "tie").sortWithinPartitions(*by, "text", "tie")
    # both passes have to see the same ranges and order: they are written down
    kept = materialize(ranged.withColumns({"range": F.spark_partition_id(), "place": F.monotonically_increasing_id()}).drop("tie"), "turns")
    found = kept.select("range", "place", "conv_key", "role_code").groupBy("range").applyInArrow(_borders, _BORDER).collect()
    states = spark.sparkContext.broadcast(border_states([tuple(r) for r in found]))
    return kept.groupBy("range").applyInArrow(_repairer(states), _REPAIRED)
