"""Conversation structure repair by a dynamic program that conversations share in a trie.

A conversation's rows, in order of turns, become a signature: one letter a row
for its role and what is wrong with it. Distinct signatures are range-sorted, so
each task walks a part of their prefix trie: the program's layer of a prefix is
computed once and serves all signatures below it, and each signature's end gives
the cheapest edits. Texts never meet the program. Only the repaired text's hash
needs a conversation's texts in order; they stream through, none is held.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, join_hot, stored, table

#: Costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: ASCII white space, the only characters that a blank text holds.
BLANKS = " \t\n\x0b\x0c\r"
#: Places in the pattern (s?(ua)+)?: before anything, after s, after u, after a (where it may end).
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Where a user or assistant row leads to from each place; there is one choice from each.
ALTERNATE = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
NEVER = 1 << 60
#: Signature letters by (role class, fault): s, u, a, other; a capital is truncated; x has to go.
LETTERS = ("sxxS", "uxxU", "axxA", "oxxO")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def faults(text: Column) -> tuple[Column, Column]:
    """(blank, truncated): no character but white space; last other character not ``.``, ``!`` or ``?``."""
    trimmed = F.rtrim(text, F.lit(BLANKS))
    return trimmed == "", ~F.right(trimmed, F.lit(1)).isin(".", "!", "?")


def damage(df: DataFrame) -> DataFrame:
    """The test damage: crc32 of ``conv_id:turn`` modulo 20 drops a row, empties its text, takes its
    full stops out, repeats it or makes it the user's. Null ids, roles and texts count as one space."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind, space = F.crc32(F.encode(name, "UTF-8")) % 20, F.lit(" ")
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    return df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Adds ``same``, which names a conversation's rows of one role and text, in 128 bits."""
    whole = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role"), F.lit(":"), "role", "text")
    return rows.withColumn("same", F.unhex(F.md5(F.encode(whole, "UTF-8"))))


@cache
def step(layer: tuple[int, ...], letter: str) -> tuple[tuple[int, ...], int]:
    """The next layer, less its smallest cost, and that cost."""
    out = [c + DELETE for c in layer]
    for p, q, w in _edges(letter):
        out[q] = min(out[q], layer[p] + w)
    return _lowered(out)


@cache
def _edges(letter: str) -> tuple[tuple[int, int, int], ...]:
    """(from, to, cost) of keeping or reroling a row; deletion is apart."""
    return (*_kept(letter), *_reroled(letter))


@cache
def _kept(letter: str) -> tuple[tuple[int, int, int], ...]:
    extra = TRUNCATED if letter.isupper() else 0
    leads = {"s": ((START, AFTER_S),), "u": ((START, AFTER_U), (AFTER_S, AFTER_U), (AFTER_A, AFTER_U)), "a": ((AFTER_U, AFTER_A),)}
    return tuple((p, q, extra) for p, q in leads.get(letter.lower(), ()))


@cache
def _reroled(letter: str) -> tuple[tuple[int, int, int], ...]:
    extra = TRUNCATED if letter.isupper() else 0
    return () if letter == "x" else tuple((p, q, REROLE + extra) for p, q in enumerate(ALTERNATE))


def _lowered(costs: list[int]) -> tuple[tuple[int, ...], int]:
    """Closes a layer under insertions and takes out what can't be part of any cheapest way."""
    c = list(costs)
    c[AFTER_U] = min(c[AFTER_U], min(c[START], c[AFTER_S], c[AFTER_A]) + INSERT)
    c[AFTER_A] = min(c[AFTER_A], c[AFTER_U] + INSERT)
    # Whatever follows s also follows a; whatever follows the start does so after one deletion.
    if c[AFTER_S] > c[AFTER_A]:
        c[AFTER_S] = NEVER
    if c[START] > c[AFTER_A] + DELETE:
        c[START] = NEVER
    low = min(c)
    return tuple(x - low if x < NEVER else NEVER for x in c), low


@cache
def _inserted(layer: tuple[int, ...], marks: int) -> int:
    """Marks, and the places from which a cheapest insertion leads to a marked one."""
    for _ in range(3):
        for p, q in enumerate(ALTERNATE):
            if marks >> q & 1 and layer[p] < NEVER and layer[p] + INSERT == layer[q]:
                marks |= 1 << p
    return marks


@cache
def _before(layer: tuple[int, ...], letter: str, marks: int) -> int:
    """The places of a layer from which a cheapest edit of the next row leads to a marked place."""
    after, low = step(layer, letter)
    out = 0
    for p, q, w in (*((k, k, DELETE) for k in range(4)), *_edges(letter)):
        if marks >> q & 1 and layer[p] < NEVER and layer[p] + w == after[q] + low:
            out |= 1 << p
    return _inserted(layer, out)


@cache
def _choice(layer: tuple[int, ...], letter: str, place: int, marks: int, next_marks: int) -> tuple[str, int]:
    """The ASCII-least edit on a cheapest way, and where it leads. ``letter`` is empty after the last row."""
    cost = layer[place]
    if letter:
        after, low = step(layer, letter)
        if next_marks >> place & 1 and cost + DELETE == after[place] + low:
            return "D", place
    q = ALTERNATE[place]
    if marks >> q & 1 and cost + INSERT == layer[q]:
        return "I", q
    for name, edges in (("K", _kept(letter)), ("R", _reroled(letter))) if letter else ():
        for p, q, w in edges:
            if p == place and next_marks >> q & 1 and cost + w == after[q] + low:
                return name, q
    return "", place


class Trie:
    """The path from the root to the signature that was read last: one layer a letter."""

    def __init__(self):
        first, low = _lowered([0, NEVER, NEVER, NEVER])
        self.letters, self.layers, self.totals = "", [first], [low]

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, audit); signatures in order share the layers of their common prefixes."""
        shared = _common_prefix(self.letters, signature)
        del self.layers[shared + 1 :], self.totals[shared + 1 :]
        for letter in signature[shared:]:
            layer, low = step(self.layers[-1], letter)
            self.layers.append(layer)
            self.totals.append(self.totals[-1] + low)
        self.letters = signature
        layers = self.layers
        best = min(layers[-1][START], layers[-1][AFTER_A])
        marks = [_inserted(layers[-1], sum(1 << q for q in (START, AFTER_A) if layers[-1][q] == best))]
        for k in range(len(signature) - 1, -1, -1):
            marks.append(_before(layers[k], signature[k], marks[-1]))
        marks.reverse()
        out, k, place = [], 0, START
        while True:
            last = k == len(signature)
            edit, place = _choice(layers[k], "" if last else signature[k], place, marks[k], 0 if last else marks[k + 1])
            if not edit:
                return self.totals[-1] + best, "".join(out)
            out.append(edit)
            k += edit != "I"


def _common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a and b agree before low, not on all before high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def cheapest_edits(signatures: DataFrame) -> DataFrame:
    """signature, convs, cost, audit for a table of distinct signatures (signature, convs)."""

    def run(batches):
        trie = Trie()
        for b in batches:
            found = [trie.answer(s) for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "convs", "cost", "audit"])

    parts = max(int(signatures.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ordered = signatures.select("signature", "convs").repartitionByRange(parts, "signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(run, "signature string, convs long, cost long, audit string")


class _Conversation:
    """What the rows of one conversation that came by add up to."""

    def __init__(self, conv: int | None):
        self.conv, self.letters = conv, bytearray()
        self.low = self.high = self.last_turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last_role = -1

    def add(self, turn, role, fault) -> None:
        """Rows in order: turns (NaN-free arrays with a mask), role classes, faults (0 none, 1 blank, 2 duplicate, 3 truncated)."""
        self.letters += _LETTER_BYTES[role, fault].tobytes()
        counts = np.bincount(fault, minlength=4)
        self.blank, self.duplicate, self.truncated = self.blank + int(counts[1]), self.duplicate + int(counts[2]), self.truncated + int(counts[3])
        before = np.append(self.last_role, role[:-1])
        self.illegal += int((~_LEGAL[before, role] & (before >= 0)).sum())
        self.last_role = int(role[-1])
        known = turn[0][turn[1]]
        if len(known):
            fresh = 1 + int((known[1:] != known[:-1]).sum()) - (self.last_turn is not None and int(known[0]) == self.last_turn)
            self.turns, self.last_turn = self.turns + fresh, int(known[-1])
            self.low = int(known[0]) if self.low is None else self.low
            self.high = int(known[-1])

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, 2**63 - 1)
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.letters.decode()


_LETTER_BYTES = np.array([[ord(c) for c in row] for row in LETTERS], np.uint8)
#: Role classes s, u, a, other; su, ua and au may stand side by side.
_LEGAL = np.zeros((5, 4), bool)
_LEGAL[[0, 1, 2], [1, 2, 1]] = True


def signatures_of(rows: DataFrame) -> DataFrame:
    """conv_id, the counts of its faults, and its signature, for every conversation of keyed rows.

    A row counts as a duplicate where the same role and text came at a smaller
    turn; that is looked up among repeated texts only, the frequent ones apart.
    Rows then stream by conversation in order; a task holds a letter a row.
    """
    blank, cut = faults(F.col("text"))
    first = F.left("role", F.lit(1))
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    fault = F.when(blank, 1).when(cut, 3).otherwise(0)
    cells = rows.select("conv_id", "turn", "same", role.cast("byte").alias("role"), fault.cast("byte").alias("fault"), "copies")
    cells = stored(cells.groupBy("conv_id", "turn", "same", "role", "fault").agg(F.sum("copies").alias("copies")), "cells")
    repeats = cells.where("copies > 0").groupBy("same").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("cells")).where("cells > 1")
    marked = join_hot(cells, stored(repeats, "repeats"), "same", "cells", how="left")
    marked = marked.withColumn("early", F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")) | F.col("first").isNull(), F.lit(False)))

    def run(batches):
        open_, out = None, []
        for b in batches:
            if not b.num_rows:
                continue
            known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
            conv = b.column(0).fill_null(0).to_numpy()
            turn = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            role, fault, copies = (b.column(k).to_numpy().astype(np.int64) for k in (2, 3, 4))
            early = b.column(5).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (known[1:] != known[:-1])))
            for i, j in zip(cut.tolist(), [*cut[1:].tolist(), b.num_rows], strict=True):
                name = int(conv[i]) if known[i] else None
                if open_ is None or open_.conv != name:
                    if open_ is not None:
                        out.append(open_.row())
                    open_ = _Conversation(name)
                n = copies[i:j]
                if not n.any():
                    continue
                at = np.repeat(np.arange(i, j), n)
                leads = np.zeros(len(at), bool)
                leads[(np.cumsum(n) - n)[n > 0]] = early[i:j][n > 0]
                kind = np.where((fault[at] != 1) & ~leads, 2, fault[at])
                open_.add((turn[0][at], turn[1][at]), role[at], kind)
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out, strict=True), strict=True)), schema)
                out = []
        if open_ is not None:
            yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(schema.names, open_.row(), strict=True)}, schema)
        give_back()

    schema = pa.schema([(n, pa.int64()) for n in ("conv_id", *COUNTS[:-1])] + [("signature", pa.string())])
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    ordered = marked.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "same").select("conv_id", "turn", "role", "fault", "copies", "early")
    return ordered.mapInArrow(run, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string")


#: The role that a new or reroled row gets at each place.
_GIVEN = ("user", "user", "assistant", "user")
_KEPT = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}


class Repair:
    """Applies an audit to the rows of one conversation as they come by: yields (role, text, edit) of what stays."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, START

    def _new(self, text: str, edit: str):
        role = _GIVEN[self.place]
        self.place = ALTERNATE[self.place]
        return role, text, edit

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new("", "I")

    def row(self, role: str, text: str):
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.place = _KEPT[role[0]]
            yield role, text, "K"
        elif edit == "R":
            yield self._new(text, "R")


def _stream(rows: DataFrame, audits: DataFrame, start, row, end, schema: str) -> DataFrame:
    """Streams each conversation's audit and then its rows in order through
    ``start(audit row)``, ``row(state, role, text)``, ``end(state)``; each gives output tuples."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    nulls = [F.lit(None).cast("long").alias(c) for c in COUNTS]
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), "turn", "same", "role", "text", "copies", *nulls)
    head = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("same"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(1).alias("copies"), *COUNTS)
    both = body.unionByName(head).repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "turn", "same")

    def run(batches):
        state = None
        for b in batches:
            columns, out = b.to_pydict(), []
            for k in range(b.num_rows):
                if columns["part"][k] == 0:
                    if state is not None:
                        out += end(state)
                    state, got = start({c: columns[c][k] for c in ("conv_id", "text", *COUNTS)})
                    out += got
                else:
                    for _ in range(columns["copies"][k]):
                        out += row(state, columns["role"][k], columns["text"][k])
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), types)
        if state is not None and (out := list(end(state))):
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)), types)
        give_back()

    kinds = {"long": pa.int64(), "string": pa.string()}
    types = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    names = types.names
    return both.select("conv_id", "part", "role", "text", "copies", *COUNTS).mapInArrow(run, schema)


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of keyed rows."""
    per = stored(signatures_of(rows), "signatures")
    answers = stored(cheapest_edits(per.groupBy("signature").agg(F.count("*").alias("convs"))), "answers")
    return stored(join_hot(per, answers, "signature", "convs").select("conv_id", *COUNTS, "audit"), "audits")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (K, R or I): the rows of repaired conversations.

    ``rows`` as for ``repair_report``.
    """
    rows = keyed(rows)

    def start(a):
        return [a["conv_id"], Repair(a["text"]), 0], ()

    def emit(state, found):
        for role, text, edit in found:
            yield state[0], state[2], role, text, edit
            state[2] += 1

    return _stream(rows, audits(rows), start, lambda s, role, text: emit(s, s[1].row(role, text)), lambda s: emit(s, s[1].inserted()), "conv_id long, place long, role string, text string, edit string")


def repair_report(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows``: conv_id, turn, role, text and copies (how often the row stands
    there; 0 for one that was lost, which still names its conversation). Rows go
    by turn, nulls first; different rows of one turn in the order of a hash of
    role and text, equal ones side by side. A null conv_id is a conversation of
    its own. A role that starts with none of s, u, a can only be reroled or
    deleted. A conversation without rows has zeros, an empty audit and the empty
    string's hash; an empty table gives no rows.
    """
    rows = keyed(rows)

    def start(a):
        return [a, Repair(a["text"]), hashlib.sha256(), False], ()

    def take(state, found):
        for role, text, _ in found:
            state[2].update((("\n" if state[3] else "") + f"{role}:{text}").encode())
            state[3] = True
        return ()

    def end(state):
        take(state, state[1].inserted())
        a = state[0]
        yield (a["conv_id"], *(a[c] for c in COUNTS), a["text"], state[2].hexdigest())

    schema = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
    return _stream(rows, audits(rows), start, lambda s, role, text: take(s, s[1].row(role, text)), end, schema)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))
