"""Fuzzy scores against all windows, and the blocks against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import fuzzy


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def all_windows(a, b):
    if not a or not b:
        return 0.0 if a or b else 100.0
    if len(a) > len(b):
        a, b = b, a
    sides = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
    return max(200 * common(s, t[max(i, 0) : i + len(s)]) / (len(s) + len(t[max(i, 0) : i + len(s)])) for s, t in sides for i in range(1 - len(s), len(t)))


def test_best_window_is_the_best_of_all():
    rng = random.Random(1)
    for k in range(500):
        letters = rng.choice(["ab", "abcd", "abcdefgh ", "كتبم "])
        a, b = ("".join(rng.choices(letters, k=rng.randint(0, n))) for n in (20, 45))
        assert fuzzy.best_window(a, b) == pytest.approx(all_windows(a, b)), (a, b)
        if k % 50 == 0:
            a, b = ("".join(rng.choices("abcdef", k=rng.randint(60, n))) for n in (150, 200))
            assert fuzzy.best_window(a, b) == pytest.approx(all_windows(a, b)), (a, b)
    assert fuzzy.best_window(None, "") == 100 and fuzzy.best_window("a", None) == 0


def test_word_sets():
    score = lambda u, v: 200 * common(u, v) / (len(u) + len(v)) if u or v else 100
    rng = random.Random(2)
    for _ in range(300):
        a, b = (" ".join(rng.choices(["x", "yy", "zab", "abz", "q", "qxy"], k=rng.randint(0, 6))) for _ in range(2))
        p, q = set(a.split()), set(b.split())
        both = " ".join(sorted(p & q))
        left, right = " ".join(sorted(p - q)), " ".join(sorted(q - p))
        join = lambda x: f"{both} {x}".strip()  # noqa: B023, E731
        if not p or not q:
            want = 0
        elif p & q and (not left or not right):
            want = 100
        else:
            gap = len(both) + bool(both)
            want = 100 * (1 - (len(left) + len(right) - 2 * common(left, right)) / (2 * gap + len(left) + len(right)))
            want = max(want, score(both, join(left)), score(both, join(right))) if both else want
        assert fuzzy.word_sets(a, b) == pytest.approx(want), (a, b)
    assert fuzzy.word_sets(None, "a") == 0


def test_no_pair_is_lost(spark, monkeypatch):
    """Typos in every second word and more; small blocks; titles longer than texts; repeated and null rows."""
    monkeypatch.setattr(fuzzy, "TEXT_BLOCK", 8)
    monkeypatch.setattr(fuzzy, "TITLE_BLOCK", 5)
    rng = random.Random(3)
    words = ["deed", "intent", "man", "migrate", "heart", "lawful", "clear", "doubt", "faith", "ab"]
    titles, texts = [], []
    for k in range(24):
        w = rng.choices(words, k=rng.choice([2, 3, 5, 9]))
        titles.append((k, " ".join(w), " ".join(w)))
        t = list(" ".join(rng.choices(words, k=3) + w + rng.choices(words, k=rng.choice([0, 4]))))
        for _ in range(rng.choice([0, 1, 3, 6])):
            at = rng.randrange(len(t))
            t[at : at + 1] = rng.choice([[], ["q"], [t[at], "z"]])
        texts.append((k, "".join(t)))
    titles += [(90, None, "x"), (91, "", "x")]
    texts += [(90, None), (91, ""), texts[0]]
    left, right = spark.createDataFrame(texts, "id int, key string"), spark.createDataFrame(titles, "ext_id int, title_key string, text_key string")
    for least in (60.0, 80.0):
        got = sorted((r.id, r.ext_id, round(r.score, 6)) for r in fuzzy.fuzzy_titles(left.where("key <> ''"), right.where("title_key <> ''"), least).collect())
        assert got == sorted((i, e, round(s, 6)) for i, key in texts if key for e, title, _ in titles if title and (s := all_windows(title, key)) >= least)
    best = fuzzy.match_external(left, right).collect()
    want = set()
    for i, key in texts:
        hits = sorted(((all_windows(t, key), e, x) for e, t, x in titles if t and len(t) >= 10), reverse=True) if key and len(key) >= 15 else []
        want |= {(i, e) for s, e, x in [h for h in hits if h[0] >= 80][:3] if max(all_windows(x, key), fuzzy.word_sets(x, key)) >= 70}
    assert {(r.id, r.ext_id) for r in best} == want and want


def test_titles_of_few_words(spark):
    """One word, two words with a typo, three with one in the middle: all meet, and the larger score confirms."""
    reports = spark.createDataFrame([(1, "whoever shows unforgivingness to men"), (2, "the best of you are the patient ones"), (3, "seek knowledge evermore in every land"), (4, "too short")], "id int, key string")
    entries = spark.createDataFrame([(10, "unforgivingness", "whoever shows unforgivingness"), (11, "the pataent ones", "patient ones are the best of you"), (12, "seek knowlidge evermore", "other words seek knowledge evermore in every land"), (13, "by the", "x"), (14, "patient ones", "zzzz qqqq wwww")], "ext_id int, title_key string, text_key string")
    assert {(r.id, r.ext_id) for r in fuzzy.match_external(reports, entries).collect()} == {(1, 10), (2, 11), (3, 12)}
    both = spark.createDataFrame([("a b c", "c b a x")], "a string, b string").select(fuzzy.wording_score(F.col("a"), F.col("b")).alias("s"), fuzzy.partial_ratio(F.col("a"), F.col("b")).alias("p")).first()
    assert both.s == 100 and both.p < 100
