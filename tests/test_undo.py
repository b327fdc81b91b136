"""Undo/redo fold vs a direct simulation of the two-stack semantics."""

import random

from pyspark.sql import functions as F

from matchdesk.operators import undo as U
from matchdesk.sources import inputs as IN
from tests.conftest import SF_MID


def simulate(ops, cap=50):
    """Two stacks as the reviewed client keeps them; returns (undo, dropped)."""
    undo, redo, dropped = [], [], []
    for op, a in ops:
        if op == "do":
            undo.append(a)
            if len(undo) > cap:
                dropped.append(undo.pop(0))
            redo.clear()
        elif op == "undo" and undo:
            redo.append(undo.pop())
        elif op == "redo" and redo:
            undo.append(redo.pop())
    return undo, dropped


def _actions(spark, sessions):
    rows = []
    seq = 0
    for s, ops in sessions.items():
        for op, a in ops:
            seq += 1
            rows.append((s, seq, op, a))
    return spark.createDataFrame(rows, "session long, seq long, op string, action_id long")


def test_fold_matches_simulation_random(spark):
    rnd = random.Random(7)
    sessions = {}
    for s in range(12):
        n = rnd.choice([0, 1, 5, 60, 180])
        ops = []
        for i in range(n):
            op = rnd.choices(["do", "undo", "redo"], [5, 3, 2])[0]
            ops.append((op, s * 1000 + i if op == "do" else None))
        sessions[s] = ops
    sessions[99] = [("undo", None), ("redo", None)] + [("do", 99000 + i) for i in range(120)] + [("undo", None)] * 130
    df = _actions(spark, sessions)
    got_stack = {}
    for r in U.undo_stack(df).collect():
        got_stack.setdefault(r.session, set()).add(r.action_id)
    got_eff = {}
    for r in U.effective(df).collect():
        got_eff.setdefault(r.session, set()).add(r.action_id)
    for s, ops in sessions.items():
        undo, dropped = simulate(ops)
        assert got_stack.get(s, set()) == set(undo), s
        assert got_eff.get(s, set()) == set(undo) | set(dropped), s


def test_fixture_counts(spark):
    acts = IN.actions(spark, SF_MID)
    assert U.undo_stack(acts).count() == 4452
    assert U.effective(acts).count() == 4456


def test_walk_has_one_exchange_and_no_extra_sort(spark):
    acts = IN.actions(spark, SF_MID)
    plan = U.walk(acts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.count("Sort [") == 1


def test_hot_sessions_split_into_chunks(spark):
    rnd = random.Random(11)
    sessions = {}
    for s in range(5):
        n = [400, 900, 30, 0, 260][s]
        ops = []
        for i in range(n):
            op = rnd.choices(["do", "undo", "redo"], [4, 3, 3] if s != 1 else [6, 2, 2])[0]
            ops.append((op, s * 10000 + i if op == "do" else None))
        sessions[s] = ops
    df = _actions(spark, sessions)
    kw = {"hot_limit": 100, "chunk_actions": 37}  # sessions 0, 1, 4 are hot, cut in ~10-25 chunks
    w = U.walk(df, **kw)
    assert w.filter("kind = 'end' and session = 1").count() > 10
    got_stack, got_eff = {}, {}
    for r in U.undo_stack(df, **kw).collect():
        got_stack.setdefault(r.session, set()).add(r.action_id)
    for r in U.effective(df, **kw).collect():
        got_eff.setdefault(r.session, set()).add(r.action_id)
    for s, ops in sessions.items():
        undo, dropped = simulate(ops)
        assert got_stack.get(s, set()) == set(undo), s
        assert got_eff.get(s, set()) == set(undo) | set(dropped), s
