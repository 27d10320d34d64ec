"""Token counts, token files and packing against the libraries themselves."""

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioscope.llm import packing, token_counts, token_files, tokens
from folioscope.llm.tokens import Encoder, encoder, tokenizer_path


def library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_librarys_ids(name, odd_texts):
    ids, mine = library(name), encoder(tokenizer_path(name)).ids
    for t in odd_texts:
        assert mine(t).tolist() == ids(t)


def test_counts(docs, odd_texts):
    ids = library("byte_bpe_50k.json")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs(odd_texts), tokenizer_path("byte_bpe_50k.json")).collect()}
    for k, t in enumerate(odd_texts):
        n = len(ids(t))
        assert (got[k].n_bytes, got[k].n_tokens, got[k].over_limit) == (len((t or "").encode()), n, n > 512)


def test_counts_of_sentencepiece(docs):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello there", "", None, "a b  c"]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs(texts), path).collect()}
    assert got == {k: len(sp.encode(t or "")) for k, t in enumerate(texts)}


def test_whole_tokens_are_proved():
    whole = token_counts.whole_tokens(tokenizer_path("byte_bpe_50k.json"))
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


def test_file_round_trip():
    rng = np.random.default_rng(3)
    ids = [rng.integers(0, 2**k, n).astype(np.uint32) for k, n in ((32, 50), (8, 1000), (17, 3), (1, 0), (25, 777))]
    keys = [None, -5, 7, 7, 2**40]
    got_keys, counts, flat = token_files.decode_file(token_files.encode_file(keys, ids))
    assert got_keys == keys and counts.tolist() == [len(x) for x in ids]
    assert flat.tolist() == np.concatenate(ids).tolist()
    small = [x % 5000 for x in ids]
    table, blob = token_files.COUNTED_IDS, token_files.encode_file(keys, small)
    try:
        token_files.COUNTED_IDS = 0
        assert token_files.encode_file(keys, small) == blob
    finally:
        token_files.COUNTED_IDS = table
    many = np.arange(70_000, dtype=np.uint32)[::-1] * 3
    assert token_files.decode_file(token_files.encode_file([1], [many]))[2].tolist() == many.tolist()


def test_token_files(docs, odd_texts):
    ids = library("word_bpe_49k.json")
    files = token_files.write_token_files(docs(odd_texts).repartition(3), tokenizer_path("word_bpe_49k.json"), end_id=2, file_ids=500)
    got = {r.doc_id: r for r in token_files.read_token_files(files).collect()}
    start = 0
    for k, t in enumerate(odd_texts):
        want = [*ids(t), 2]
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(want), crc(want))
        start += len(want)


def best_fit_decreasing(lengths, capacity):
    """Sequences of plain best fit, piece by piece."""
    gaps, opened = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, n)
        if k == len(gaps):
            opened += 1
            bisect.insort(gaps, capacity - n)
        else:
            bisect.insort(gaps, gaps.pop(k) - n)
    return opened


@pytest.mark.parametrize(("seed", "capacity", "rows"), [(1, 64, 40), (2, 2048, 100), (3, 2048, 10**6), (4, 100, 7)])
def test_supersteps_pack_as_well_as_best_fit(spark, monkeypatch, seed, capacity, rows):
    """Every piece once, gapless sequences, hardly more of them than plain best fit; many partitions and few."""
    monkeypatch.setattr(packing, "TASK_ROWS", rows)
    monkeypatch.setattr(packing, "TASK_SEQUENCES", 4)
    rng = np.random.default_rng(seed)
    n = 400 if rows < 10 else 1500
    lengths = np.clip((rng.lognormal(np.log(capacity / 5), 1.2, n)).astype(int), 1, capacity).tolist() + [capacity] * 5 + [1] * 30
    pieces = spark.createDataFrame([(k % 97, 0, 0, v, k) for k, v in enumerate(lengths)], packing.PIECES)
    got = packing.pack_pieces(pieces.repartition(5), capacity).collect()
    assert sorted((r.ids_crc32, r.length) for r in got) == sorted(enumerate(lengths))
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(by_seq) <= best_fit_decreasing(lengths, capacity) * 1.02 + 2


def test_resolve_takes_the_nearest_larger_gaps():
    assert packing.resolve([(0, 2, 3), (1, 0, 2), (2, 4, 0), (5, 9, 1)]).tolist() == [[2, 0, 2, 1, 0, 0], [2, 2, 2, 0, 0, 2], [5, 0, 1, 0, 2, 4]]
    assert packing.resolve([]).tolist() == []


def test_packing(docs, odd_texts):
    ids = library("byte_bpe_50k.json")
    rows = packing.pack_documents(docs(odd_texts), tokenizer_path("byte_bpe_50k.json"), capacity=2048).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for k, t in enumerate(odd_texts):
        want, at = [*ids(t), 0], 0
        pieces = sorted(by_doc[k], key=lambda r: r.piece)
        assert len(pieces) == -(-len(want) // 2048)
        for p, r in enumerate(pieces):
            assert (r.piece, r.start, r.ids_crc32) == (p, at, crc(want[at : at + r.length]))
            assert r.length == 2048 or p == 0
            at += r.length
        assert at == len(want)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= sum(r.length for r in rows) / 2048 * 1.1 + 1


def test_empty_tables(docs):
    none = docs([])
    byte = tokenizer_path("byte_bpe_50k.json")
    assert token_counts.count_tokens(none, byte).count() == 0
    assert packing.pack_documents(none, byte).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(none, byte, 2)).count() == 0


def test_files_can_be_read_without_spark(docs):
    """Real files in the shared folder, in order of their names; a second write leaves the first alone."""
    from pathlib import Path

    word = tokenizer_path("word_bpe_49k.json")
    texts = [f"some words of text {k} " * (k % 7) for k in range(60)]
    files = token_files.write_token_files(docs(texts), word, 2, file_ids=100)
    token_files.write_token_files(docs(["other"]), word, 2)
    names = sorted(Path(files.folder.removeprefix("file://")).glob("*.fsv"))
    assert [p.name for p in names] == sorted(r.name for r in files.collect()) and len(names) > 3
    ids = library("word_bpe_49k.json")
    keys, flat = [], []
    for p in names:
        k, _, x = token_files.decode_file(p.read_bytes())
        keys += k
        flat += x.tolist()
    assert keys == list(range(60)) and flat == [i for t in texts for i in [*ids(t), 2]]


def test_null_ids(docs):
    byte = tokenizer_path("byte_bpe_50k.json")
    df = docs(["a", "b", "a"], ids=[None, None, 5])
    assert packing.pack_documents(df, byte).count() == 3
    got = token_files.read_token_files(token_files.write_token_files(df, byte, 2)).collect()
    assert sorted(r.start for r in got) == [0, 2, 4] and max(got, key=lambda r: r.start).doc_id == 5


def test_addresses_of_stores():
    import pyarrow.fs

    from folioscope.llm.token_files import arrow_address

    assert arrow_address("s3a://bucket/x/y") == "s3://bucket/x/y" and arrow_address("file:///tmp/x") == "file:///tmp/x"
    assert arrow_address("/tmp/x") == "/tmp/x" and arrow_address("hdfs://host/x") == "hdfs://host/x"
    assert pyarrow.fs.FileSystem.from_uri(arrow_address("file:///tmp/x"))[1] == "/tmp/x"


def test_a_resting_memo_gives_the_same_ids():
    from folioscope.llm.tokens import Encoder, Memo, tokenizer_path

    one = Encoder(tokenizer_path("byte_bpe_50k.json"))
    texts = [f"word{k} and other{k % 7} things, {k}!" for k in range(300)]
    first = [one.raw(t) for t in texts]
    for m in vars(one).values():
        if isinstance(m, Memo):
            m.rest(5)
            assert len(m) <= 5 and not m.old
    one.rest()
    assert [one.raw(t) for t in texts] == first


def test_packing_holds_few_texts_and_chunks_at_once(spark, monkeypatch):
    """The pipeline's packing: small batches, small memos, the session's setting untouched, the same pieces."""
    from folioscope.llm import packing, tokens

    assert tokens.SHARED_CHUNKS * 8 <= tokens.MEMO_CHUNKS
    small = tokens.Encoder(tokenizer_path("byte_bpe_50k.json"), 3)
    text = " ".join(f"word{i} other" for i in range(50))
    assert small.raw(text) == encoder(tokenizer_path("byte_bpe_50k.json")).raw(text)
    assert all(len(m) <= 3 and len(m.old) <= 3 for m in vars(small).values() if isinstance(m, tokens.Memo))
    name, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", [], packing.stored
    monkeypatch.setattr(packing, "stored", lambda df, label: (seen.append((label, spark.conf.get(name))), real(df, label))[1])
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, text) for i in range(5)], "doc_id long, text string")
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), memo=3).collect()
    assert ("numbered-pieces", "1000") in seen and spark.conf.get(name) == before
    assert len({r.ids_crc32 for r in rows}) == 1 and len(rows) == 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_give_the_librarys_ids_and_ask_once_for_a_word(name, odd_texts, monkeypatch):
    monkeypatch.setattr(tokens, "SLICE_BYTES", 200)
    more = ["Wört, wört. WÖRT; zebraıİŸ K µm ª\nnext line\nŸes", "\n first", "ends \n", " a ", "x" * 70 + ", " + "y" * 64 + "." * 70, "it's don't’s a--b 12,5 naïve…"]
    texts = [*odd_texts, *more, None, "", *odd_texts]
    ids, own = library(name), Encoder(tokenizer_path(name), most=20)
    assert [x.tolist() for x in own.batch(pa.array(texts))] == [ids(t) for t in texts]
    assert list(own.batch(pa.array([], pa.string()))) == [] and [len(x) for x in own.batch(pa.array([None, ""]))] == [0, 0]
    asked = []
    own, pieces = Encoder(tokenizer_path(name)), own._pieces
    own.cores.answers = lambda words: asked.extend(words) or pieces(words)
    words = "zebrix zebrix, zebrix. zebrix;! zebrix"
    assert [x.tolist() for x in own.batch(pa.array([f"{words} {words}\n{words}"] * 30))] == [ids(f"{words} {words}\n{words}")] * 30
    assert asked == ["zebrix"]


def test_a_full_pool_keeps_the_first_words_and_stays_right():
    pool = tokens.Pool(lambda words: (np.frombuffer("".join(words).encode("utf-32-le"), "<u4"), np.array([len(w) for w in words])), 4)
    for words in (["ab", "c"], ["c", "def", "gh"], ["i", "ab"], ["jkl", "gh", "c", "ab"], []):
        start, length = pool.runs(pa.array(words, pa.string()))
        assert ["".join(map(chr, pool.ids[s : s + n])) for s, n in zip(start, length, strict=True)] == words
    assert len(pool.numbers) <= 6 and list(pool.numbers)[:2] == ["ab", "c"]
