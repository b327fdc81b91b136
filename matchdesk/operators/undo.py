"""Undo/redo stacks per session (M12), as a distributed fold.

Model. A session's history is a list of positions with a cursor c and a
floor b. `do(a)` writes a at position c, truncates everything above, moves c
up, and when the undo stack (positions b..c-1) exceeds 50 raises b by one
(the action at the old floor is pushed off: still applied, no longer
undoable). `undo` moves c down if c > b; `redo` moves c up if the
position above c still holds an action; otherwise they are no-ops.

Then, at the end: applied actions = the last action written to each
position p < c; undo stack = those with b <= p < c.

An undo or redo acts on the action last written to its position, so the changes that a
history makes are a signed log: an action's new values when it is done or redone, its old
values when it is undone. The last entry per cell is the cell's value (`applied`).

Only the cursor walk is sequential. It streams through `mapInPandas` over
session-partitioned, seq-sorted rows -- bounded state (three integers) --
and emits one (kind, position, seq, action) row per effective event plus the final state.
The stacks are then plain DataFrame aggregation and a join, so no session's
actions are ever collected into one row or one pandas frame.

A hot session (more than HOT_SESSION_ACTIONS actions) is not walked by one
task: the pair (undo size, redo size) has at most 1,326 values under the cap
of 50, so each seq-range chunk of the session computes, in parallel and
vectorized over all those start values, where it ends and how far it moves
the cursor. Composing the small per-chunk tables in chunk order gives each
chunk's start state, and the chunks are then walked in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchdesk import schema as S
from matchdesk.operators import edits as E

WALK_SCHEMA = ("session long, chunk long, kind string, pos long, seq long, action_id long, "
               "cursor long, undo_size long, redo_size long")

# Sessions with more actions than this are split into chunks of about
# CHUNK_ACTIONS actions that are walked in parallel (see `_hot_chunk_starts`).
HOT_SESSION_ACTIONS = 2_000_000
CHUNK_ACTIONS = 1_000_000


def _walk(cap: int):
    """Cursor walk over one partition: (session, chunk) runs contiguous, each in
    seq order, each starting from the state in its start_* columns."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        c = top = b = 0
        last_seq = None
        ends: list[tuple] = []
        for pdf in batches:
            if pdf.empty:
                continue
            out: list[tuple] = []
            cols = [pdf[x].to_numpy() for x in ("session", "chunk", "op", "seq", "action_id",
                                                 "start_c", "start_k", "start_r")]
            for sess, chunk, op, seq, aid, c0, k0, r0 in zip(*cols):
                if (sess, chunk) != key:
                    if key is not None:
                        ends.append((key[0], key[1], c, c - b, top - c))
                    key = (sess, chunk)
                    c, top, b, last_seq = int(c0), int(c0 + r0), int(c0 - k0), None
                if last_seq is not None and seq < last_seq:
                    raise RuntimeError("undo fold: actions of a session out of seq order")
                last_seq = seq
                if op == "do":
                    out.append((sess, chunk, op, c, seq, aid))
                    c += 1
                    top = c
                    if c - b > cap:
                        b += 1
                elif op == "undo" and c > b:
                    c -= 1
                    out.append((sess, chunk, op, c, seq, None))
                elif op == "redo" and c < top:
                    out.append((sess, chunk, op, c, seq, None))
                    c += 1
            if out:
                df = pd.DataFrame(out, columns=["session", "chunk", "kind", "pos", "seq", "action_id"])
                yield df.assign(cursor=None, undo_size=None, redo_size=None)
        if key is not None:
            ends.append((key[0], key[1], c, c - b, top - c))
        if ends:
            n = len(ends)
            yield pd.DataFrame({"session": [e[0] for e in ends], "chunk": [e[1] for e in ends],
                                "kind": ["end"] * n, "pos": [None] * n, "seq": [None] * n,
                                "action_id": [None] * n, "cursor": [e[2] for e in ends],
                                "undo_size": [e[3] for e in ends], "redo_size": [e[4] for e in ends]})
    return walk


def _states(cap: int):
    """All (undo size k, redo size r) with k + r <= cap, as index arrays."""
    ks, rs = [], []
    for k in range(cap + 1):
        for r in range(cap + 1 - k):
            ks.append(k); rs.append(r)
    return np.array(ks, dtype=np.int64), np.array(rs, dtype=np.int64)


def _chunk_tables(cap: int):
    """Per (session, chunk): where each possible start state ends, and the
    cursor's net move -- vectorized over all states, one pass over the chunk."""
    k0, r0 = _states(cap)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = None
        k = r = dc = None
        done = []
        for pdf in batches:
            for sess, chunk, op in zip(pdf["session"].to_numpy(), pdf["chunk"].to_numpy(), pdf["op"].to_numpy()):
                if (sess, chunk) != key:
                    if key is not None:
                        done.append((key[0], key[1], k.tolist(), r.tolist(), dc.tolist()))
                    key = (sess, chunk)
                    k, r, dc = k0.copy(), r0.copy(), np.zeros_like(k0)
                if op == "do":
                    k = np.minimum(k + 1, cap); r[:] = 0; dc += 1
                elif op == "undo":
                    m = k > 0
                    k = k - m; r = r + m; dc = dc - m
                elif op == "redo":
                    m = r > 0
                    k = k + m; r = r - m; dc = dc + m
            if len(done) > 64:
                yield pd.DataFrame(done, columns=["session", "chunk", "end_k", "end_r", "dc"]); done = []
        if key is not None:
            done.append((key[0], key[1], k.tolist(), r.tolist(), dc.tolist()))
        if done:
            yield pd.DataFrame(done, columns=["session", "chunk", "end_k", "end_r", "dc"])
    return tables


def _compose(cap: int):
    """Per hot session: chunk tables in chunk order -> each chunk's start state."""
    k0, r0 = _states(cap)
    index = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(k0, r0))}

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        c = k = r = 0
        out = []
        for sess, chunk, ek, er, dc in pdf[["session", "chunk", "end_k", "end_r", "dc"]].itertuples(index=False):
            out.append((sess, chunk, c, k, r))
            i = index[(k, r)]
            c, k, r = c + int(dc[i]), int(ek[i]), int(er[i])
        return pd.DataFrame(out, columns=["session", "chunk", "start_c", "start_k", "start_r"])
    return compose


def _with_chunks(a: DataFrame, hot_limit: int, chunk_actions: int) -> tuple[DataFrame, DataFrame | None]:
    """Chunk column: 0 for ordinary sessions; for hot sessions a seq-range
    bucket holding about `chunk_actions` actions. The hot-session table has at
    most total/hot_limit rows, a proven bound for its broadcast."""
    stats = a.groupBy("session").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"),
                                     F.max("seq").alias("hi"))
    hot = stats.filter(F.col("n") > hot_limit)
    if hot.limit(1).count() == 0:
        return a.withColumn("chunk", F.lit(0).cast("bigint")), None
    width = F.greatest(F.lit(1.0), (F.col("hi") - F.col("lo") + 1) * F.lit(float(chunk_actions)) / F.col("n"))
    hot = hot.select("session", "lo", width.alias("width"))
    chunked = (a.join(F.broadcast(hot), "session", "left")
               .withColumn("chunk", F.coalesce(F.floor((F.col("seq") - F.col("lo")) / F.col("width")),
                                               F.lit(0)).cast("bigint"))
               .drop("lo", "width"))
    return chunked, hot.select("session")


def walk(actions: DataFrame, cap: int = S.UNDO_MAX, hot_limit: int = HOT_SESSION_ACTIONS,
         chunk_actions: int = CHUNK_ACTIONS) -> DataFrame:
    """Per-`do` positions and per-(session, chunk) end states.

    Rows are hash-partitioned by (session, chunk) and sorted by (session,
    chunk, seq) within partitions; `mapInPandas` streams each partition in
    that order, so every run is walked with constant memory and no per-group
    Python call. Hot sessions are cut into chunks whose start states come
    from composing per-chunk transition tables; their chunks are then walked
    in parallel like any other run.
    """
    a = actions.select("session", "seq", "op", "action_id")
    a, hot = _with_chunks(a, hot_limit, chunk_actions)
    zero = {"start_c": F.lit(0).cast("bigint"), "start_k": F.lit(0).cast("bigint"),
            "start_r": F.lit(0).cast("bigint")}
    if hot is None:
        a = a.withColumns(zero)
    else:
        hot_rows = a.join(F.broadcast(hot), "session", "left_semi")
        tables = (hot_rows.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "seq")
                  .mapInPandas(_chunk_tables(cap),
                               "session long, chunk long, end_k array<long>, end_r array<long>, dc array<long>"))
        starts = tables.groupBy("session").applyInPandas(
            _compose(cap), "session long, chunk long, start_c long, start_k long, start_r long")
        a = (a.join(starts, ["session", "chunk"], "left")
             .withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items()}))
    ordered = a.repartition("session", "chunk").sortWithinPartitions("session", "chunk", "seq")
    return ordered.mapInPandas(_walk(cap), WALK_SCHEMA)


def stacks(actions: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """(session, pos, action_id, undoable): every applied action at the end.

    undoable = still on the undo stack; false = pushed off by the cap. The
    final state of a session is the end state of its last chunk.
    """
    w = walk(actions, cap, **kw)
    dos = w.filter(F.col("kind") == "do")
    last = (w.filter(F.col("kind") == "end")
            .groupBy("session").agg(F.max_by(F.struct("cursor", "undo_size"), "chunk").alias("e")))
    ends = last.select("session", F.col("e.cursor").alias("cursor"),
                       (F.col("e.cursor") - F.col("e.undo_size")).alias("floor"))
    written = dos.groupBy("session", "pos").agg(F.max_by("action_id", "seq").alias("action_id"))
    j = written.join(ends, "session").filter(F.col("pos") < F.col("cursor"))
    return j.select("session", "pos", "action_id", (F.col("pos") >= F.col("floor")).alias("undoable"))


def undo_stack(actions: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """The undo stack of every session (session, action_id)."""
    return stacks(actions, cap, **kw).filter("undoable").select("session", "action_id")


def effective(actions: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """Actions in effect: the undo stack plus those pushed off by the cap."""
    return stacks(actions, cap, **kw).select("session", "action_id")


def acted(actions: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """(session, seq, action_id, undone): the action that each effective event does, undoes or
    redoes. Events on an empty stack are not in it."""
    events = walk(actions, cap, **kw).filter(F.col("kind") != "end")
    before = Window.partitionBy("session", "pos").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.select("session", "seq", F.last("action_id", ignorenulls=True).over(before).alias("action_id"),
                         (F.col("kind") == "undo").alias("undone"))


def change_log(actions: DataFrame, changes: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """The signed log (seq, id, field, new_value) of what sessions do to the table.
    `changes` (action_id, id, field, old_value, new_value) holds what each action changes."""
    value = F.when(F.col("undone"), F.col("old_value")).otherwise(F.col("new_value"))
    return (acted(actions, cap, **kw).join(changes, "action_id")
            .select("seq", "id", "field", value.alias("new_value")))


def applied(actions: DataFrame, changes: DataFrame, cap: int = S.UNDO_MAX, **kw) -> DataFrame:
    """The cells' values after all sessions: (id, field, seq, new_value), the last entry of
    the signed log per cell."""
    return E.last_values(change_log(actions, changes, cap, **kw), ["id", "field"])
