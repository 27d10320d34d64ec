"""Scans and rounds against plain walks in reading order."""

import random

import pytest

from folioscope.operators import chunking, structure

BLOCKS = "book string, pos int, block_id string, type string, author_role string, text string, continues_from_prev boolean, starts boolean, ends boolean, attached_to string"


def walk(rows, most):
    """{block: (chunk, kind, chapter, on)} of one book, from the rules as they are told."""
    out, made, open_kind, open_no, size, ended = {}, 0, None, None, 0, False
    chapter, last, names = None, None, {}
    for _, _, bid, kind, role, text, goes, starts, ends, attached in sorted(rows, key=lambda r: r[1]):
        if kind in ("page_header", "page_number", "footnote") or attached:
            continue
        text = text or ""
        if kind == "heading":
            open_kind = open_no = None
            if "باب" in text or not chapter:
                chapter = " ".join(text.split())
            continue
        if role == "editor" or kind == "editor_commentary":
            if open_kind != "editor_commentary":
                open_kind, open_no, names[made] = "editor_commentary", made, (chapter, last)
                made += 1
        elif open_kind == "editor_commentary" and goes and not starts and last is not None:
            open_kind, open_no = "matn", last
        elif open_kind != "matn" or (starts and not goes) or (size > most and ended and not goes):
            open_kind, open_no, last, size, names[made] = "matn", made, made, 0, (chapter, None)
            made += 1
        if open_kind == "matn":
            size, ended = size + len(text), bool(ends)
        out[bid] = (open_no, open_kind, *names[open_no])
    return out


@pytest.mark.parametrize(("seed", "stretch"), [(1, 4096), (2, 7), (3, 3)])
def test_chunks_are_those_of_a_walk(spark, seed, stretch):
    """Books of many stretches, long runs without an opener, notes between, blank headings, nulls."""
    rng = random.Random(seed)
    rows = []
    for book in ("a", "b", "c"):
        calm = book == "c"  # mostly cuts by size
        for k in range(160):
            kind = rng.choices(["body", "hadith", "heading", "editor_commentary", "footnote", "page_number", "poetry"], [6, 3, 0.1 if calm else 1, 0.3 if calm else 1.5, 1, 0.5, 1])[0]
            text = rng.choice(["باب x", "Part  one", "", " ", None, "Two"]) if kind == "heading" else "x" * rng.choice([0, 1, 5, 9, 30])
            rows.append((book, k * 2 + rng.randint(0, 1), f"{book}{k}", kind, rng.choice(["matn", "matn", "matn", None] if calm else ["matn", "matn", "editor", None]), text, rng.choice([True, False, False, None]), rng.random() < (0.02 if calm else 0.2), rng.random() < 0.5, rng.choice([None] * 8 + ["x"])))
    df = spark.createDataFrame(rows, BLOCKS)
    got = {r.block_id: (r.chunk, r.kind, r.chapter, r.commentary_on) for r in chunking.structural_chunks(df, most=40, stretch=stretch).collect()}
    want = {}
    for book in ("a", "b", "c"):
        want |= walk([r for r in rows if r[0] == book], 40)
    assert got == want
    assert chunking.structural_chunks(df.where("false")).count() == 0


def test_tables_of_a_stretch():
    """A table gives what a walk gives, whatever size is open before; tables of two stretches compose."""
    import numpy as np

    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 25)
        sizes = [rng.choice([0, 1, 3, 10]) for _ in range(n)]
        opens = [rng.random() < 0.1 for _ in range(n)]
        may = [rng.random() < 0.4 for _ in range(n)]

        def after(size, a, b):
            for k in range(a, b):
                size = sizes[k] if opens[k] or (may[k] and size > 12) else size + sizes[k]  # noqa: B023
            return size

        cut = rng.randint(0, n)
        table = lambda a, b: chunking.cut_table(np.array(sizes[a:b], np.int64), np.array(opens[a:b], bool), np.array(may[a:b], bool), 12)  # noqa: B023, E731
        for before in range(0, 30):
            assert chunking.open_size(before, table(0, n)) == after(before, 0, n)
            assert chunking.open_size(chunking.open_size(before, table(0, cut)), table(cut, n)) == after(before, 0, n)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_duplicates_are_those_of_a_fold(spark, seed):
    rng = random.Random(seed)
    phrases = [[f"p{k}w{j}" for j in range(rng.choice([2, 3, 4, 6]))] for k in range(12)]
    rows = []
    for page in ("p", "q"):
        for k in range(45):
            words = [w for _ in range(rng.randint(0, 4)) for w in rng.choice(phrases)] + [f"own{k}"] * rng.randint(0, 3)
            rows.append((page, rng.randint(0, 60) if seed == 3 else k, 100 + k, words))
    want = []
    for page in ("p", "q"):
        owner = {}
        for _, _, me, words in sorted((r for r in rows if r[0] == page), key=lambda r: (r[1], r[2])):
            for i in range(len(words) - 2):
                if (first := owner.setdefault(tuple(words[i : i + 3]), me)) != me:
                    want.append((page, me, first))
                    break
    df = spark.createDataFrame(rows, "page string, pos int, id int, words array<string>")
    assert sorted(map(tuple, structure.duplicate_runs(df, n=3).collect())) == sorted(want) and want
    assert structure.duplicate_runs(df.where("false"), n=3).count() == 0


def test_copies_need_no_rounds(spark, monkeypatch):
    """All runs are moved once, only shared ones are written, and copies are settled before any round."""
    written = {}

    def noted(df, label):
        df = df.cache()
        written[label] = df.count()
        return df

    monkeypatch.setattr(structure, "scratch", noted)
    text = [f"w{k}" for k in range(30)]
    rows = [("p", k, k, text[:10] + ([f"own{k}"] if k % 3 else []) + text[10:]) for k in range(20)] + [("p", 90 + k, 90 + k, [f"single{k}.{j}" for j in range(50)]) for k in range(20)]
    df = spark.createDataFrame(rows, "page string, pos int, id int, words array<string>")
    assert sorted(map(tuple, structure.duplicate_runs(df, n=3).collect())) == [("p", k, 0) for k in range(1, 20)]
    assert max(written.values()) <= 20 * 28 and written["open-runs"] == 0 and "stops" not in written
