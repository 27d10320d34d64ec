"""Image formats and resizing against direct computations; mixing against its contract."""

import hashlib
import io
import math
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import media, mixing


def bmp(depth, pixels, palette=b"", top_down=False):
    h, w = pixels.shape[:2]
    row = (w * depth + 31) // 32 * 4
    body = b""
    for y in range(h) if top_down else reversed(range(h)):
        p = pixels[y]
        raw = p.astype(np.uint8).tobytes() if depth >= 8 else np.packbits(((p[:, None] >> np.arange(depth)[::-1]) & 1).astype(np.uint8).reshape(-1)).tobytes()
        body += raw.ljust(row, b"\0")
    head = struct.pack("<IiiHHIIiiII", 40, w, -h if top_down else h, 1, depth, 0, len(body), 0, 0, len(palette) // 4, 0)
    return b"BM" + struct.pack("<IHHI", 54 + len(palette) + len(body), 0, 0, 54 + len(palette)) + head + palette + body


def test_netpbm():
    assert media.decode_image(b"P2\n# c\n3 2\n9\n1 2 3\n4 5 6\n").tolist() == [[1, 2, 3], [4, 5, 6]]
    assert media.decode_image(b"P5 2 1 255\n\x07\xff").tolist() == [[7, 255]]
    assert media.decode_image(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert media.decode_image(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    assert media.decode_image(b"P3 1 1 255 9 8 7").tolist() == [[[9, 8, 7]]]
    assert media.decode_image(b"P1 3 1\n101").tolist() == [[0, 255, 0]]
    assert media.decode_image(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    with pytest.raises(ValueError):
        media.decode_image(b"P5 9 9 255\nx")


@pytest.mark.parametrize("top_down", [False, True])
@pytest.mark.parametrize("depth", [1, 4, 8, 24, 32])
def test_bmp(depth, top_down):
    rng = np.random.default_rng(depth)
    palette = rng.integers(0, 256, (min(1 << depth, 256), 4)).astype(np.uint8) if depth <= 8 else np.empty((0, 4), np.uint8)
    shape = (3, 5) if depth <= 8 else (3, 5, depth // 8)
    px = rng.integers(0, 1 << min(depth, 8), shape)
    want = palette[px][:, :, 2::-1] if depth <= 8 else px[:, :, 2::-1]
    assert media.decode_image(bmp(depth, px, palette.tobytes(), top_down)).tolist() == want.tolist()


def test_area_resize_is_the_mean_of_areas():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (12, 18)).astype(np.uint8)
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.kron(x, np.ones((7, 5)))  # the same picture on a grid that both sizes divide
    assert np.allclose(media.area_resize(x, 7, 5), fine.reshape(7, 12, 5, 18).mean(axis=(1, 3)))
    assert media.area_resize(x, 30, 40).mean() == pytest.approx(x.mean())


def test_stripes_give_the_same_means(monkeypatch):
    x = np.random.default_rng(4).integers(0, 256, (1000, 64)).astype(np.uint8)
    whole = media.area_resize(x, 8, 9)
    monkeypatch.setattr(media, "STRIPE", 200)
    assert np.allclose(media.area_resize(x, 8, 9), whole, atol=1e-9)


def stored_form(text):
    """The NPY tiles and the difference hash of a text, with numpy's own writer and plain means."""
    raw = (text or "").encode()
    rows = max(1, -(-len(raw) // 64))
    image = np.frombuffer(raw.ljust(rows * 64, b"\0"), np.uint8).reshape(rows, 64)
    out = io.BytesIO()
    np.save(out, np.array([rows, 64, media.TILE], np.int64))
    for y in range(0, rows, media.TILE):
        for x in range(0, 64, media.TILE):
            np.save(out, np.ascontiguousarray(image[y : y + media.TILE, x : x + media.TILE]))
    fine = np.repeat(np.repeat(image.astype(float), 8, axis=0), 9, axis=1)  # a grid that 8 by 9 cells divide
    cells = fine.reshape(8, rows, 9, 64).mean(axis=(1, 3))
    return out.getvalue(), np.packbits(np.round(cells[:, 1:], 6) > np.round(cells[:, :-1], 6)).tobytes().hex()


def test_stored_form_of_texts(docs):
    texts = [None, "", "short", "x" * 64, "y z " * 3000, "é" * 5000, "a\nb" * 70_000]
    got = {r.doc_id: r for r in media.text_features(media.store_texts(docs(texts))).collect()}
    for k, t in enumerate(texts):
        data, feature = stored_form(t)
        assert (got[k].media_bytes, got[k].media_sha256, got[k].feature) == (len(data), hashlib.sha256(data).hexdigest(), feature)
    null = media.text_features(media.store_texts(docs(["a", "a"], ids=[None, None]))).collect()
    assert [r.doc_id for r in null] == [None, None] and null[0].media_sha256 == null[1].media_sha256


@pytest.mark.parametrize("shape", [(5, 7), (130, 64), (64, 129, 3), (1, 1)])
def test_tiles_round_trip(shape):
    x = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (media.read_tiles(media.write_tiles(x, 64)) == x).all()


def test_texts_as_media(docs, odd_texts):
    got = {r.doc_id: r for r in media.text_features(media.store_texts(docs(odd_texts))).collect()}
    assert len(got) == len(odd_texts)
    seen = {}
    for k, t in enumerate(odd_texts):
        raw = (t or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 64)) * 64, b"\0")
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert seen.setdefault(t or "", (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)
    assert media.text_features(media.store_texts(docs([]))).count() == 0


def test_images_of_a_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\x07\xff")), (2, None), (3, bytearray(b"junk"))], "doc_id long, content binary")
    got = {r.doc_id: r.media for r in media.store_images(df).collect()}
    assert media.read_tiles(bytes(got[1])).tolist() == [[7, 255]] and got[2] is None and got[3] is None


def targets(sizes):
    """Water filling, one source after the other."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    out, active, rest = {}, set(order), float(sum(sizes.values()))
    while active:
        level = rest / sum(weight[s] for s in active)
        over = {s for s in active if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
            rest -= out[s]
        active -= over
    return out | {s: weight[s] * level for s in active}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixing(docs, seed):
    rng = random.Random(seed)
    texts = [" ".join("w" * rng.choice([1, 5, 20, 60])) for _ in range(900)] + [None, "", "  x"]
    names = ["b", "a", "Z", "é", None, "hot"]
    sources = {k: rng.choices(names, [1, 5, 10, 20, 3, 60])[0] for k in range(len(texts))}
    rows = mixing.mix(docs(texts, sources)).collect()
    size = {k: len((t or "").replace("\n", " ").split(" ")) - ((t or "").split(" ").count("")) for k, t in enumerate(texts)}
    per, taken = {}, {}
    for k, s in sources.items():
        per[s] = per.get(s, 0) + size[k]
    want = targets(per)
    assert len(rows) == len(texts)
    for r in rows:
        s = sources[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], per[s]) and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] = taken.get(s, 0) + r.taken
    for s in per:
        assert abs(taken[s] - want[s]) <= 30  # half of the longest document
    again = {r.doc_id: r.taken for r in mixing.mix(docs(texts, sources).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def drawn(rows, target, most, start):
    """One source's copies by plain order sampling. rows: (u, id, twin, size)."""
    m = lambda s: 1 + math.log2(s)
    low, high = 0.0, 1e9
    for _ in range(300):  # the level by bisection
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most, level * m(s)) * s for _, _, _, s in rows) < target else (low, level)
    strata = {}
    for row in rows:
        r = min(most, high * m(row[3]))
        whole = math.floor(r + 1e-7)
        strata.setdefault(math.floor(math.log2(row[3]) * 4), []).append((row, whole, max(r - whole, 0.0)))
    copies, upto, before = {}, 0.0, math.floor(start)
    for k in sorted(strata, reverse=True):
        upto += sum(p for _, _, p in strata[k])
        n, before = math.floor(upto + start + 1e-7) - before, math.floor(upto + start + 1e-7)
        order = sorted(strata[k], key=lambda x: (x[0][0] / (1 - x[0][0]) / (x[2] / (1 - x[2])) if x[2] > 1e-7 else math.inf, x[0][1]))
        for i, (row, whole, _) in enumerate(order):
            copies[row[1]] = whole + (i < n)
    gap = target - sum(copies[i] * s for _, i, _, s in rows)
    able = [i for _, i, _, s in rows if abs(abs(gap) - s) < abs(gap) - 1e-9]
    return copies, gap, able


@pytest.mark.parametrize("seed", [3, 4])
def test_the_draw_against_plain_order_sampling(spark, docs, seed):
    rng = random.Random(seed)
    texts = [" ".join(["w"] * rng.choice([1, 2, 3, 5, 9, 17, 40, 41, 43, 90, 200])) + f" {k}" for k in range(700)]
    sources = {k: rng.choices(["a", "b", "c", "d"], [1, 2, 40, 9])[0] for k in range(len(texts))}
    df = docs(texts, sources)
    u = {r.doc_id: r.u for r in df.select("doc_id", mixing.random_number(42, F.col("doc_id"), F.xxhash64("text"), mixing.word_count(F.col("text"))).alias("u")).collect()}
    starts = {r.s: r.u for r in spark.createDataFrame([(f"s{s}",) for s in "abcd"], "s string").select("s", mixing.random_number(42, F.col("s"), F.lit("start")).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    probabilities = set()
    for s in "abcd":
        rows = [(u[k], k, 0, got[k].size) for k in sources if sources[k] == s]
        target = got[rows[0][1]].target
        want, gap, able = drawn(rows, target, 3, starts[f"s{s}"])
        differ = {k for _, k, _, size in rows if got[k].taken != want[k] * size}
        assert len(differ) <= 1 and differ <= set(able)
        left = target - sum(got[k].taken for _, k, _, _ in rows)
        assert abs(left) <= abs(gap)
        probabilities |= {got[k].taken // size for _, k, _, size in rows}
    assert len(probabilities) >= 3


def test_mixing_of_odd_tables(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([None, ""])).collect()] == [0, 0]
    # Three sources of three two-word documents, targets 3, 6 and 9: 9 lies between two whole numbers of documents.
    same = mixing.mix(docs(["a b"] * 9, ids=[1] * 9)).collect()
    assert len(same) == 9
    for target in (3.0, 6.0, 9.0):
        own = [r.taken for r in same if r.target == target]
        assert len(own) == 3 and abs(sum(own) - target) <= 1 and max(own) <= 6
    nulls = mixing.mix(docs(["a b", "a b", "c d e", None], ids=[None] * 4, sources={k: "s" for k in range(4)})).collect()
    assert sorted((r.size, r.taken) for r in nulls) == [(0, 0), (2, 2), (2, 2), (3, 3)]


def test_a_very_long_text_is_mixed_whole(docs):
    rows = mixing.mix(docs(["w " * 300_000, "a b c"], sources={0: "a", 1: "b"})).collect()
    assert {r.size for r in rows} == {300_000, 3}
