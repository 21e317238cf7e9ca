"""Chat formatting with role repair of least cost.

A conversation is legal if it is an optional system turn, then user and
assistant turns in alternation, the last one the assistant's.  Every turn is
given an output role; it may be merged into the turn before, be relabelled, or
have empty turns inserted before it, each at a cost.  Dynamic programming over
the automaton's four states (nothing yet, system, user, assistant) finds the
cheapest repair, and the result is rendered turn by turn: a conversation's text
is its rows' ``rendered``, in order.

No conversation has to fit into one task.  Turns are dealt out by ranges of
(conv_id, turn, role, text hash), so one conversation may span many partitions.
A run of turns is a 4 x 4 matrix of least costs; each partition gives those of
its first and last conversation (a row a partition goes to the driver), which
are chained there into the states at the partition borders; between fixed
borders each partition finds its part of the path.

Null and unknown roles fit any output role at cost 1.  Null and empty texts are
empty turns.  Turns with equal numbers are ordered by role and text hash, and
repeated rows are turns of their own.  Null conversation ids form one
conversation, null turn numbers come first.  An empty table gives an empty
table; very long texts pass whole; columns other than conv_id, turn, role and
text are not read.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import shared_dir
from .common import table

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
RELABEL, RELABEL_UNKNOWN, RELABEL_SYSTEM = 3, 1, 5
MERGE, MERGE_LONG, LONG = 2, 5, 1000  # merging a turn of over LONG characters costs more
INSERT = 4
REAL = 64  # bits below a cost that break ties, by turn and not by partition
INF = 1 << 200
# state before, output role -> roles of the empty turns that make the step legal
STEPS = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
CLOSE = {SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: (), START: ()}


def moves(state: int, role: str | None, size: int, turn: object = None):
    """(cost, output role, merged, inserted) of each way to take a turn in ``state``.

    Costs are shifted by ``REAL`` bits; the low bits make the cheapest path the
    same one however a conversation is cut.
    """
    own = ROLES.index(role) + 1 if role in ROLES else None
    for out in (SYSTEM, USER, ASSISTANT):
        label = 0 if out == own else RELABEL_UNKNOWN if own is None else RELABEL_SYSTEM if SYSTEM in (out, own) else RELABEL
        if state == out:
            yield label + (MERGE_LONG if size > LONG else MERGE) << REAL | zlib.crc32(f"{turn} {out} merged".encode()), out, True, ()
        if (state, out) in STEPS:
            cost = label + INSERT * len(STEPS[state, out])
            yield cost << REAL | zlib.crc32(f"{turn} {state} {out}".encode()), out, False, STEPS[state, out]


def ending(state: int) -> int:
    return INSERT * len(CLOSE[state]) << REAL


def matrix(turns) -> list[list[int]]:
    """Least cost from each state to each, over ``turns`` of (role, size, turn)."""
    best = [[0 if a == b else INF for b in range(4)] for a in range(4)]
    for role, size, turn in turns:
        new = [[INF] * 4 for _ in range(4)]
        for s in range(4):
            for cost, out, _, _ in moves(s, role, size, turn):
                for a in range(4):
                    if best[a][s] + cost < new[a][out]:
                        new[a][out] = best[a][s] + cost
        best = new
    return best


def path(turns, first: int = START, last: int | None = None):
    """The cheapest moves for ``turns`` from state ``first`` (to ``last``, or to a legal end), and their cost."""
    best, back = [0 if s == first else INF for s in range(4)], []
    for role, size, turn in turns:
        new, came = [INF] * 4, [None] * 4
        for s in range(4):
            if best[s] < INF:
                for move in moves(s, role, size, turn):
                    if best[s] + move[0] < new[move[1]]:
                        new[move[1]], came[move[1]] = best[s] + move[0], (s, move)
        best = new
        back.append(came)
    end = last if last is not None else min(range(4), key=lambda s: (best[s] + ending(s), s))
    out, state = [], end
    for came in reversed(back):
        state, move = came[state]
        out.append(move)
    return out[::-1], best[end] + (ending(end) if last is None else 0)


def _open(role: int) -> str:
    return f"<|{ROLES[role - 1]}|>\n"


END = "\n<|end|>\n"


def borders(parts: list[dict]) -> dict[int, dict]:
    """The states at which the conversations that cross partitions enter and leave each of them.

    ``parts``: in order, ``part``, ``first`` and ``last`` (conversation keys),
    and ``head`` and ``tail``, the matrices of their turns there (``head`` alone
    if the partition has one conversation only).
    """
    fixed = {p["part"]: {"enter": START, "leave": None} for p in parts}
    i = 0
    while i < len(parts):
        key, chain, j = parts[i]["last"], [], i
        while j < len(parts) and parts[j]["first" if j > i else "last"] == key:
            chain.append(parts[j]["head"] if j > i or parts[j]["first"] == parts[j]["last"] else parts[j]["tail"])
            j += 1
            if parts[j - 1]["last"] != key:
                break
        if len(chain) > 1:
            costs, back = [0, INF, INF, INF], []
            for m in chain:
                got = [min((costs[a] + m[a][b], a) for a in range(4)) for b in range(4)]
                costs = [c for c, _ in got]
                back.append([a for _, a in got])
            state = min(range(4), key=lambda s: (costs[s] + ending(s), s))
            states = [state]
            for b in reversed(back):
                states.append(b[states[-1]])
            states.reverse()
            for k in range(len(chain)):
                if k:
                    fixed[parts[i + k]["part"]]["enter"] = states[k]
                if k < len(chain) - 1:
                    fixed[parts[i + k]["part"]]["leave"] = states[k + 1]
            i += len(chain) - 1
        else:
            i += 1
    return fixed


def _segments(batches, columns):
    """(key, rows) of each run of one conversation in a sorted partition."""
    key, rows = None, []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in columns]):
            if rows and row[0] != key:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row)
    if rows:
        yield key, rows


def format_chats(turns: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, turn, role, new_role, merged, inserted, cost, rendered."""
    spark = turns.sparkSession
    shared_dir(spark)  # for checkpoint()
    columns = ["conv_id", "turn", "role", "text"]
    order = ["conv_id", "turn", "role", "_c_hash"]
    chats = turns.select(*columns, F.xxhash64("text").alias("_c_hash"))
    ordered = chats.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()  # partitions keep their numbers

    def summary(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first = last = head = tail = None
        for key, rows in _segments(batches, columns):
            if head is None:
                first, head = key, matrix((r, len(x or ""), n) for _, n, r, x in rows)
            last, held = key, rows
        if head is not None:
            tail = matrix((r, len(x or ""), n) for _, n, r, x in held)
            flat = lambda m: pa.array([" ".join(str(x) for row in m for x in row)])
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([repr(first)]), pa.array([repr(last)]), flat(head), flat(tail)],
                ["part", "first", "last", "head", "tail"],
            )

    parts = ordered.mapInArrow(summary, "part int, first string, last string, head string, tail string").collect()  # a row a partition
    square = lambda m: [[int(x) for x in m.split()][4 * a : 4 * a + 4] for a in range(4)]
    parts = sorted(({**r.asDict(), "head": square(r["head"]), "tail": square(r["tail"])} for r in parts), key=lambda r: r["part"])
    fixed = borders(parts)

    def render(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        at = fixed.get(TaskContext.get().partitionId())
        names = ["conv_id", "turn", "role", "new_role", "merged", "inserted", "cost", "rendered"]
        types = [pa.string()] * 2 + [pa.bool_(), pa.string(), pa.int64(), pa.string()]

        def result(rows, enter, leave):
            made, _ = path(((r, len(x or ""), n) for _, n, r, x in rows), enter, leave)
            out = []
            for k, ((_, _, role, text), (cost, state, merged, inserted)) in enumerate(zip(rows, made)):
                before = "" if (k == 0 and enter == START) or merged else END
                piece = before + "".join(_open(x) + END for x in inserted) + ("\n\n" if merged else _open(state)) + (text or "")
                if k == len(rows) - 1 and leave is None:
                    piece += END + "".join(_open(x) + END for x in CLOSE[state])
                    cost, inserted = cost + ending(state), (*inserted, *CLOSE[state])
                out.append((role, ROLES[state - 1], merged, ",".join(ROLES[x - 1] for x in inserted), cost >> REAL, piece))
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kinds[0]), pa.array([r[1] for r in rows], kinds[1]), *[pa.array(c, t) for c, t in zip(cols, types)]], names
            )

        kinds: list = []

        def seen(batches):
            for b in batches:
                kinds[:] = [b.column("conv_id").type, b.column("turn").type]
                yield b

        enter, held = at["enter"] if at else START, None
        for _, rows in _segments(seen(batches), columns):
            if held is not None:
                yield result(held, enter, None)
                enter = START
            held = rows
        if held is not None:
            yield result(held, enter, at["leave"])

    schema = turns.select("conv_id", "turn", F.lit(None).cast("string").alias("role"), *[F.lit(None).cast(t).alias(c) for c, t in (
        ("new_role", "string"), ("merged", "boolean"), ("inserted", "string"), ("cost", "long"), ("rendered", "string"))]).schema
    return ordered.mapInArrow(render, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
