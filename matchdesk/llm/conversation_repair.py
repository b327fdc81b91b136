"""Conversation structure repair by a persistent audit DP.

Every row of a conversation is kept (K), given the role user or assistant (R) or deleted
(D), and empty turns may be inserted (I), so that the role initials become
``(s?(ua)+)?``. Of all cheapest repairs the one whose letters (the *audit*) come first
in ASCII order is taken.

The DP walks the rows with one cell per automaton state: E nothing yet, S after a
system turn, U after a user turn, A after an assistant turn. A cell is a cost and the
last node of a persistent list of letters: cells share their prefixes, a step adds one
node, and each node has the rolling hash of its letters and its ancestors at the powers
of two. Two cells of equal cost are compared by their longest common prefix, searched
over those ancestors by hash; equal hashes of different nodes are verified letter by
letter. From one start the letters fix state and cost, so two audits of equal cost and
state never are prefixes of each other and the smaller prefix stays the smaller whole.

Rows stream through in order and are never held as a group: cells that no continuation
can make the cheapest are dropped, and what all other cells share is final, is given
out and forgotten. A conversation leaves in memory its audit, one short digest per row
(for duplicates) and the undecided end, a few rows.

A conversation is one sequence and its digest a sequential hash, so its rows go through
one task, however many they are; other conversations are dealt out over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

E, S, U, A = range(4)
ROLE = {U: "user", A: "assistant"}
NEXT_ROLE = {E: U, S: U, U: A, A: U}   # the state that an inserted or renamed turn leads to
KEPT = {(E, "s"): S, (E, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
ACCEPTED = (E, A)
LEGAL = {"su", "ua", "au"}
RENAME, DELETE, INSERT, CUT = 2, 3, 2, 1

# MIMIC[p][q]: what a repair that stands in p pays at most beyond one that stands in q
# to follow it to its end (p inserts a turn, deletes a kept system turn, or adds the
# pair that an end needs).
MIMIC = {E: {S: 0, U: 2, A: 0}, S: {E: 4, U: 2, A: 4}, U: {E: 5, S: 2, A: 2}, A: {E: 3, S: 0, U: 2}}

SPACE = " \t\n\x0b\x0c\r"
BASE, PRIME = 1_000_003, (1 << 61) - 1
SETTLE = 32  # undecided rows from which on the shared prefix is looked for


class Node:
    """One letter of an audit; ``up[k]`` is the ancestor 2**k letters earlier."""

    __slots__ = ("letter", "state", "depth", "hash", "up")

    def __init__(self, parent: Node | None, letter: str, state: int):
        self.letter, self.state = letter, state
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth, self.hash = parent.depth + 1, (parent.hash * BASE + ord(letter)) % PRIME
        up, k = [parent], 0
        while len(up[k].up) > k:
            up.append(up[k].up[k])
            k += 1
        self.up = up


def at_depth(x: Node, depth: int) -> Node:
    gap = x.depth - depth
    while gap:
        k = gap.bit_length() - 1
        x = x.up[k]
        gap -= 1 << k
    return x


def same(x: Node, y: Node) -> bool:
    """Whether two nodes of one depth spell the same letters."""
    if x is y:
        return True
    if x.hash != y.hash:
        return False
    while x is not y:  # equal hashes are no proof
        if x.letter != y.letter:
            return False
        x, y = x.up[0], y.up[0]
    return True


def fork(x: Node, y: Node) -> tuple[Node, Node] | None:
    """The first nodes in which two audits differ; None if one begins the other."""
    depth = min(x.depth, y.depth)
    x, y = at_depth(x, depth), at_depth(y, depth)
    if same(x, y):
        return None
    for k in reversed(range(len(x.up))):
        if k < len(x.up) and not same(x.up[k], y.up[k]):
            x, y = x.up[k], y.up[k]
    return x, y


def less(x: Node, y: Node) -> bool:
    at = fork(x, y)
    return x.depth < y.depth if at is None else at[0].letter < at[1].letter


def _offer(cells: dict, state: int, cost: int, parent: Node, letter: str) -> None:
    old = cells.get(state)
    if old is None or cost < old[0]:
        cells[state] = (cost, Node(parent, letter, state))
    elif cost == old[0]:
        node = Node(parent, letter, state)
        if less(node, old[1]):
            cells[state] = (cost, node)


def _inserted(cells: dict) -> dict:
    """The cells after any number of inserted turns (a cycle of them never pays)."""
    out = dict(cells)
    for q in (E, S, A, U):  # U last: it may itself come from an insertion
        if q in out:
            _offer(out, NEXT_ROLE[q], out[q][0] + INSERT, out[q][1], "I")
    return out


def _pruned(cells: dict) -> dict:
    return {q: c for q, c in cells.items() if not any(c[0] > d[0] + MIMIC[p][q] for p, d in cells.items() if p != q)}


class Repair:
    """The repair of one conversation, row by row; ``turns`` receives what is final as
    (edit, role, text, turn of the source row)."""

    def __init__(self, turns):
        self.turns = turns
        self.cells = {E: (0, Node(None, "", E))}
        self.waiting: list[tuple] = []      # (role, text, turn) of undecided rows, in order
        self.audit: list[str] = []
        self.seen: set[bytes] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.n_turns = 0
        self.first = self.last = self.initial = None

    def add(self, turn, role: str, text: str, blank: bool, truncated: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.n_turns += turn != self.last
            self.last = turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        body = text.encode("utf-8", "surrogatepass")
        mark = hashlib.blake2b(role.encode("utf-8", "surrogatepass") + b"\0%d\0" % len(body) + body, digest_size=16).digest()
        repeated = mark in self.seen
        self.seen.add(mark)
        cut = 0
        if blank:
            self.blank += 1
        elif repeated:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
            cut = CUT
        cells = {}
        for q, (cost, node) in _inserted(self.cells).items():
            _offer(cells, q, cost + DELETE, node, "D")
            if not blank and not repeated:
                if (q, initial) in KEPT:
                    _offer(cells, KEPT[q, initial], cost + cut, node, "K")
                _offer(cells, NEXT_ROLE[q], cost + RENAME + cut, node, "R")
        self.cells = _pruned(cells)
        self.waiting.append((role, text, turn))
        if len(self.waiting) >= SETTLE:
            self._settle()

    def _settle(self) -> None:
        """Give out what all cells share and start anew behind it."""
        nodes = [c[1] for c in self.cells.values()]
        common = nodes[0]
        for x in nodes[1:]:
            at = fork(common, x)
            common = at[0].up[0] if at else at_depth(common, min(common.depth, x.depth))
        if common.depth == 0:
            return
        made: dict = {}
        root = Node(None, "", common.state)
        fresh = {}
        for q, (cost, node) in self.cells.items():
            y = root
            for d in range(common.depth + 1, node.depth + 1):
                letter, state = (x := at_depth(node, d)).letter, x.state
                if (y, letter) not in made:
                    made[y, letter] = Node(y, letter, state)
                y = made[y, letter]
            fresh[q] = (cost, y)
        self._emit(common)
        self.cells = fresh

    def _emit(self, node: Node) -> None:
        used = 0
        for d in range(1, node.depth + 1):
            x = at_depth(node, d)
            self.audit.append(x.letter)
            if x.letter == "I":
                self.turns("I", ROLE[x.state], "", None)
                continue
            role, text, turn = self.waiting[used]
            used += 1
            if x.letter != "D":
                self.turns(x.letter, role if x.letter == "K" else ROLE[x.state], text, turn)
        del self.waiting[:used]

    def end(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit."""
        cells = _inserted(self.cells)
        best = None
        for q in ACCEPTED:
            c = cells.get(q)
            if c and (best is None or c[0] < best[0] or (c[0] == best[0] and less(c[1], best[1]))):
                best = c
        self._emit(best[1])
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.n_turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, best[0], "".join(self.audit)


def damage(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the planted faults, by crc32("conv_id:turn") % 20
    (nulls read as one space): 0 drops the row, 1 empties its text, 2 removes ``[.!?]``
    from it, 3 repeats it, 4 makes its role user. A dropped row stays with
    ``present`` false, so that its conversation is still known."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    text = (F.when(k.isin(0, 1), "").when(k == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text")))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (conversations.select("conv_id", "turn", F.when(k == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"),
                                 (k != 0).alias("present"), copies.alias("copies"))
            .withColumn("copy", F.explode("copies")).drop("copies", "copy"))


def _ordered(rows: DataFrame, present: str | None) -> DataFrame:
    """conv_id, turn, role, text, present, blank, truncated: conversations whole in one
    partition, in order of turn (nulls first; ties by role, then text)."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))  # empty if there is white space only
    flag: Column = F.lit(True) if present is None else F.col(present)
    src = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), flag.alias("present"))
    return (src.select("*", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"))
            .repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text"))


def _conversations(batches: Iterator[pa.RecordBatch], make, done, schema: pa.Schema, so_far=None) -> Iterator[pa.RecordBatch]:
    """Feed rows to one ``make()`` per conversation and give out the rows of ``done``, and
    after each batch those that ``so_far`` has of an unfinished conversation."""
    def table(rows: list) -> pa.RecordBatch:
        types = [id_type, *schema.types[1:]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

    current, key, out = None, None, []
    for batch in batches:
        id_type = batch.schema.types[0]
        cols = [c.to_pylist() for c in batch.columns]
        for conv, turn, role, text, present, blank, truncated in zip(*cols):
            if current is None or conv != key:
                if current is not None:
                    out += done(key, current)
                current, key = make(), conv
            if present:
                current.add(turn, role, text, blank, truncated)
        if so_far is not None and current is not None:
            out += so_far(key, current)
        if out:
            yield table(out)
            out = []
    if current is not None:
        out += done(key, current)
    if out:
        yield table(out)


class _Digest:
    def __init__(self):
        self.sha, self.n = hashlib.sha256(), 0
        self.repair = Repair(self.turn)
        self.add = self.repair.add

    def turn(self, edit: str, role: str, text: str, turn) -> None:
        self.sha.update((("\n" if self.n else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.n += 1


class _Turns:
    def __init__(self):
        self.out: list[tuple] = []
        self.repair = Repair(self.turn)
        self.add = self.repair.add
        self.n = 0

    def turn(self, edit: str, role: str, text: str, turn) -> None:
        self.out.append((self.n, edit, turn, role, text))
        self.n += 1


def _schemas(rows: DataFrame, names: str) -> tuple[str, pa.Schema]:
    """The output's schema for Spark and for Arrow; the first column is the id as it came."""
    kinds = {"long": pa.int64(), "string": pa.string()}
    rest = [n.split() for n in names.split(", ")]
    id_type = rows.select("conv_id").schema[0].dataType.simpleString()
    return f"conv_id {id_type}, {names}", pa.schema([("conv_id", pa.null())] + [(n, kinds[t]) for n, t in rest])


def repair(rows: DataFrame, present: str | None = None) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256, the digest of the repaired
    ``role:text`` lines.

    ``present`` names a boolean column that marks rows that are there; a conversation none
    of whose rows is has zeros, an empty audit and the digest of nothing. Null roles and
    texts read as one space, so a null role fits nowhere and a null text is blank; an
    empty role fits nowhere either. Null turns come first and do not count as gaps; a null
    conv_id is a conversation of its own. Rows of one turn follow by role, then text; equal
    rows are duplicates. Other columns are not read; an empty table gives no rows."""
    ddl, schema = _schemas(rows, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                                 "audit string, repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _conversations(batches, _Digest, lambda key, one: [(key, *one.repair.end(), one.sha.hexdigest())], schema)

    return _ordered(rows, present).mapInArrow(run, ddl)


def repaired_turns(rows: DataFrame, present: str | None = None) -> DataFrame:
    """The repaired conversations themselves: conv_id, pos (from 0), edit (K, R or I), turn of
    the source row (null for an inserted one), role and text. Nulls, ties and empty tables
    as in ``repair``; a conversation that is deleted whole has no rows."""
    ddl, schema = _schemas(rows, "pos long, edit string, turn long, role string, text string")

    def so_far(key, one):
        out, one.out[:] = [(key, *t) for t in one.out], []
        return out

    def done(key, one):
        one.repair.end()
        return so_far(key, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _conversations(batches, _Turns, done, schema, so_far)

    return _ordered(rows, present).mapInArrow(run, ddl)
