"""The labelled sample: its size, and the words that reach the driver."""

from collections import Counter

import numpy as np

from folioscope.llm import toxicity as X


def test_only_common_words_reach_the_driver(spark):
    texts = [f"shared{k % 9} own{chr(97 + k % 26)}{chr(97 + k // 26)} every" for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(60)], "doc_id long, low_quality int, toxic int")
    rows, vocabulary = X.labelled_sample(docs, labels, list(X.CATEGORIES))
    memo = X.Memo(X.word_features)
    df = Counter(w for t in texts for w in X.hashed(t, memo).tolist())
    for r in rows:
        want = [w for w in X.hashed(texts[r.doc_id], memo).tolist() if df[w] >= X.LEAST_DOCS]
        assert vocabulary[np.frombuffer(r.words, "<i4")].tolist() == want
    assert len(rows) == 60 and X.SAMPLE == 12_000


def test_a_plain_fit_on_the_same_documents(spark):
    """The operator's probabilities and verdicts against one process that sees all documents."""
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}xyz" for i in range(12) for j in range(12)]
    texts, marks = [], []
    for k in range(400):
        w = list(rng.choice(words, rng.integers(3, 40)))
        toxic = k % 5 == 0
        if toxic:
            w += ["rotten", "vermin"][: 1 + k % 2]
        texts.append(" ".join(w) if k % 50 else None)
        marks.append((k, int(k % 3 == 0), int(toxic)))
    texts.append("w" * 300_000 + " rotten vermin")
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[5])], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, low_quality int, toxic int")
    chain = X.fit_chain(docs, labels, list(X.CATEGORIES))
    memo = X.Memo(X.word_features)
    hashed = [X.hashed(t, memo) for t in texts]
    df = Counter(w for h in hashed[:400] for w in h.tolist())
    vocabulary = np.array(sorted(w for w, n in df.items() if n >= X.LEAST_DOCS), np.uint64)
    place = {int(w): i for i, w in enumerate(vocabulary)}
    places = [np.array([place[w] for w in h.tolist() if w in place], np.int32) for h in hashed]
    form = np.array([X.form_of(t) for t in texts])
    plain = X.Chain.fit(np.arange(400), places[:400], form[:400], {c: np.array([m[i] for m in marks], float) for i, c in ((1, "low_quality"), (2, "toxic"))}, vocabulary)
    want = plain.predict(hashed, form)
    got = {r.doc_id: r for r in X.classify(docs, chain).collect()}
    assert np.allclose([[got[k].p_low_quality, got[k].p_toxic] for k in range(401)], want, atol=2e-6)
    assert [got[k].toxic for k in range(401)] == (want[:, 1] > plain.thresholds[1]).tolist()
    assert got[None].p_toxic == got[5].p_toxic
    said = np.array([got[k].toxic for k in range(400)])
    true = np.array([m[2] for m in marks], bool) & np.array([t is not None for t in texts[:400]])
    assert (said & true).sum() >= 0.95 * true.sum() and (said & ~true).sum() <= 12


def test_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(1, f"text number {k % 7} of many") for k in range(5000)] + [(k, f"words of {k}") for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(1, 40)], "doc_id long, low_quality int, toxic int")
    rows, _ = X.labelled_sample(docs, labels, list(X.CATEGORIES), most=10)
    assert len(rows) == 10
    again, _ = X.labelled_sample(docs.repartition(5), labels, list(X.CATEGORIES))
    assert [r.doc_id for r in again] == list(range(1, 40)) and len({bytes(r.words) for r in again if r.doc_id == 1}) == 1


def test_the_sample_is_never_collected_at_once(spark, monkeypatch):
    """The driver's JVM holds one partition of the sample, not all of it several times."""
    docs = spark.createDataFrame([(k, f"some words here w{chr(97 + k % 7)}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 // 2) for k in range(40)], "doc_id long, low_quality int, toxic int")

    def refuse(self):
        raise AssertionError("the whole sample at once")

    monkeypatch.setattr(type(docs), "collect", refuse)
    rows, _ = X.labelled_sample(docs, labels, list(X.CATEGORIES))
    assert [r.doc_id for r in rows] == list(range(40))
