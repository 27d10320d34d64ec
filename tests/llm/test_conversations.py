"""Conversation repair against a plain fold and a search over all edits."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from folioscope.llm import conversations as C

PATTERN = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, gaps string, audit string, same string, copies string"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, has to go, truncated), by uniform-cost search."""
    heap, best = [(0, "", 0, "", ())], None
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if best and cost > best[0]:
            break
        if i == len(rows) and PATTERN.fullmatch(roles) and (best is None or (cost, audit) < best[:2]):
            best = cost, audit, lines
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 3, audit + "I", i, roles + role[0], (*lines, f"{role}:")))
        if i == len(rows):
            continue
        role, text, gone, cut = rows[i]
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, lines))
        if not gone:
            heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, roles + (role[:1] or "-"), (*lines, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, roles + new[0], (*lines, f"{new}:{text}")))
    return best


def brute(table):
    """The report of a list of rows (conv_id, turn, role, text), after the damage."""
    convs = {c: [] for c, *_ in table}
    for conv, turn, role, text in table:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            convs[conv] += [row] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = [t for t, *_ in rows if t is not None]
        seen, judged, blank, duplicate, truncated = set(), [], 0, 0, 0
        for _, role, text in rows:
            ink = re.findall(r"[^\x20\x09-\x0D]", text)
            gone = not ink or (role, text) in seen
            cut = not gone and ink[-1] not in ".!?"
            blank, duplicate, truncated = blank + (not ink), duplicate + (bool(ink) and gone), truncated + cut
            seen.add((role, text))
            judged.append((role, text, gone, cut))
        initials = [r[:1] for _, r, _ in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(judged)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def frame(spark, table):
    """Rows with extra columns whose names clash with results and working columns."""
    return spark.createDataFrame([(*r, "x", "y", "z", "7") for r in table], SCHEMA)


def report(df):
    return {r.conv_id: tuple(r[1:]) for r in df.select("conv_id", *C.COUNTS, "audit", "repaired_sha256").collect()}


def random_table(seed, conversations=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "so it goes", "", " \n", None, "fine?", "ok .", "end. ", "Done. \t"]
    table = []
    for conv in [None, *range(conversations)]:
        for turn in rng.sample(range(12), rng.randint(1, 5)):
            table.append((conv, None if turn == 11 else turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts)))
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_report(spark, seed):
    table = random_table(seed)
    assert report(C.repair_report(C.damage(frame(spark, table)))) == brute(table)


def test_signatures_share_a_trie():
    """Answers don't depend on what was read before, in any order."""
    rng = random.Random(3)
    names = sorted({"".join(rng.choices("xsSuUaAoO", k=rng.randint(0, 7))) for _ in range(400)})
    trie, back = C.Trie(), C.Trie()
    forward = [trie.answer(n) for n in names]
    assert forward == [back.answer(n) for n in reversed(names)][::-1] == [C.Trie().answer(n) for n in names]
    for name, got in zip(names[::8], forward[::8], strict=True):
        role = {"x": "", "s": "system", "u": "user", "a": "assistant", "o": "tool"}
        assert got == cheapest([(role[c.lower()], "t", c == "x", c.isupper()) for c in name])[:2]


def test_empty_table(spark):
    assert C.repair_report(C.damage(frame(spark, []))).count() == 0


def test_a_long_conversation_and_repeated_rows(spark):
    """A conversation with most rows, one of its rows often repeated; the edits themselves."""
    table = [(7, k, "user" if k % 2 == 0 else "assistant", f"t{k}." if k % 5 else "again.") for k in range(6000)]
    table += [(8, 1, "user", "twice."), (8, 1, "user", "twice."), (8, 2, "assistant", "yes.")]
    df = C.damage(frame(spark, table))
    got = report(C.repair_report(df))
    made = {}
    for r in C.repaired_rows(df).orderBy("conv_id", "place").collect():
        made.setdefault(r.conv_id, []).append(r)
    for conv, rows in made.items():
        assert PATTERN.fullmatch("".join(r.role[0] for r in rows))
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == got[conv][-1]
        assert "".join(r.edit for r in rows) == got[conv][-2].replace("D", "")
    # Repeated texts are looked up apart: 1,200 rows of one text, two roles, all but the first of each are duplicates.
    seen = {(r, t) for _, _, r, t in table[:6000]}
    kinds = [zlib.crc32(f"7:{k}".encode()) % 20 for k in range(6000)]
    assert got[7][2] >= sum(k != 0 for k in kinds) - len(seen) - kinds.count(1) and got[8][0] == 0


def test_conversations_without_rows(spark):
    lost = next(c for c in range(10**4) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert report(C.repair_report(C.damage(frame(spark, [(lost, 1, "user", "a.")])))) == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
