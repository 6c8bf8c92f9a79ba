import struct
import time
import zlib

import numpy as np
import pytest

from tessera.llm import media as M
from tessera.llm.queries import queries


def png(pixels, kinds):
    """8-bit PNG of (h, w, planes) with the given filter per row."""
    h, w, planes = pixels.shape
    flat = pixels.reshape(h, -1).astype(int)
    out = b""
    for y in range(h):
        left = np.concatenate([np.zeros(planes, int), flat[y, :-planes]])
        up = flat[y - 1] if y else np.zeros(w * planes, int)
        corner = np.concatenate([np.zeros(planes, int), up[:-planes]])
        kind, p = kinds[y % len(kinds)], left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = [0 * left, left, up, (left + up) // 2, paeth][kind]
        out += bytes([kind]) + ((flat[y] - guess) & 255).astype(np.uint8).tobytes()

    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    colour = {1: 0, 2: 4, 3: 2, 4: 6}[planes]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("planes", [1, 2, 3, 4])
def test_png(planes):
    pixels = np.random.default_rng(planes).integers(0, 256, (9, 7, planes))
    want = pixels[:, :, : planes - (planes in (2, 4))].mean(2)
    assert np.allclose(M.decode(png(pixels, [0, 1, 2, 3, 4])), want, atol=0.01)


def test_netpbm_and_damage():
    image = np.arange(60).reshape(6, 10)
    assert (M.decode(M.pgm(image)) == image).all()
    assert M.decode(b"P6 # note\n2 1 255\n" + bytes([0, 3, 6, 9, 9, 9])).tolist() == [[3.0, 9.0]]
    assert all(M.decode(x) is None for x in (None, b"", b"P5", b"P5 9 9 255\nx", b"GIF89a", b"\x89PNG\r\n\x1a\n", M.pgm(image)[:20]))


def pictures(n, seed):
    rng = np.random.default_rng(seed)
    return [M.draw(rng.normal(size=64)) for _ in range(n)]


def test_copies_are_found_and_others_left_alone(spark):
    images = pictures(40, 1)
    rows, want = [], {}
    for i, image in enumerate(images):
        rows.append((10 * i, M.pgm(image)))
        want[10 * i] = 10 * i
        if i % 2 == 0:
            made = [image[12:, 8:], 255 - 0.6 * (255 - image), np.rot90(image), image][i // 2 % 4]
            rows.append((10 * i + 1, M.pgm(made)))
            want[10 * i + 1] = 10 * i
    found = M.find_copies(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert {r["media_id"]: r["component_id"] for r in found} == want


def test_odd_rows(spark):
    same = M.pgm(pictures(1, 2)[0])
    rows = [(1, None), (2, b""), (3, b"junk"), (4, M.pgm(np.zeros((50, 50)))), (5, M.pgm(np.zeros((2, 2)))), (6, same), (7, same), (7, same), (None, same)]
    df = spark.createDataFrame(rows, "media_id long, data binary").selectExpr("*", "1 AS id", "2 AS component_id", "'x' AS digest", "3 AS v", "4 AS c", "5 AS class_id", "6 AS feats")
    found = M.find_copies(df).collect()
    assert len(found) == len(rows)
    other = M.pgm(pictures(1, 4)[0])
    twice = M.find_copies(spark.createDataFrame([(4, same), (4, other), (2, same), (3, other), (4, None), (9, None)], "media_id long, data binary")).collect()
    assert sorted((r["media_id"], r["component_id"]) for r in twice) == [(2, 2), (3, 2), (4, 2), (4, 2), (4, 2), (9, 9)]
    assert {r["media_id"]: r["component_id"] for r in found} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, None: None}
    assert M.find_copies(df.where("false")).count() == 0


def turned(image, degrees):
    h, w = image.shape
    a, (y, x) = np.radians(degrees), np.mgrid[0:h, 0:w]
    cy, cx = (h - 1) / 2, (w - 1) / 2
    sx, sy = np.cos(a) * (x - cx) + np.sin(a) * (y - cy) + cx, np.cos(a) * (y - cy) - np.sin(a) * (x - cx) + cy
    return image[np.clip(np.rint(sy).astype(int), 0, h - 1), np.clip(np.rint(sx).astype(int), 0, w - 1)]


EDITS = {
    "scaled to 0.85": (lambda i, r: M.shrink(i, 1 / 0.85), 0.9),
    "scaled to 1.2": (lambda i, r: M.shrink(i, 1 / 1.2), 0.9),
    "cropped to 0.73": (lambda i, r: i[15:97, 15:97], 0.7),
    "turned by 10": (lambda i, r: turned(i, 10), 0.9),
    "noise": (lambda i, r: i + r.normal(0, 6, i.shape), 0.95),
    "gamma": (lambda i, r: 255 * (i / 255) ** 0.8, 0.95),
}


def test_links_against_all_pairs(spark):
    """Of the links that the consensus would find among all pairs the words bring together 0.95; of the copies planted most are linked, of the others none."""
    rng = np.random.default_rng(6)
    images = pictures(150, 3)
    made = {(i, k): M.decode(M.pgm(edit(images[i], rng))) for k, (edit, _) in enumerate(EDITS.values()) for i in range(150) if i % len(EDITS) == k}
    packed = {i: M.pack(image) for i, image in enumerate(images)} | {1000 + i: M.pack(image) for (i, _), image in made.items()}
    assert all(packed.values())
    linked = {(a, b) for a in packed for b in packed if a < b and (b < 1000 or b - 1000 == a or a < 40) and M.consensus(packed[a], packed[b]) > 0}
    feats = spark.createDataFrame([(i, bytearray(x)) for i, x in packed.items()], "id long, feats binary").repartition(5)
    met = {tuple(r) for r in M.candidates(feats).collect()}
    found = {(r["a"], r["b"]) for r in M.agree(spark.createDataFrame(list(met), "a long, b long"), feats).collect()}
    assert len(found & linked) >= 0.95 * len(linked)
    assert all(b - 1000 == a for a, b in linked | found)
    for k, (_, least) in enumerate(EDITS.values()):
        own = [i for i, e in made if e == k]
        assert sum((i, 1000 + i) in found for i in own) >= least * len(own), list(EDITS)[k]


def test_rows_meet_in_the_shortest_prefix_that_few_share():
    rng = np.random.default_rng(5)
    keys = np.sort(np.concatenate([rng.integers(0, 4, 200) << 32 | rng.integers(0, 6, 200) << 16 | rng.integers(0, 3, 200), np.full(30, 9 << 32 | 5)]).astype(np.uint64))
    ids = rng.permutation(len(keys)).astype(np.int64)
    want = set()
    for i in range(len(keys)):
        for j in range(i):
            for shift in M.LEVELS:
                share = np.flatnonzero(keys >> np.uint64(shift) == keys[i] >> np.uint64(shift))
                if j not in share:
                    break
                if len(share) <= M.MOST:
                    want.add(tuple(sorted((int(ids[i]), int(ids[j])))))
                    break
            else:
                if j == share[0] or j == i - 1:
                    want.add(tuple(sorted((int(ids[i]), int(ids[j])))))
    assert set(map(tuple, M.meet(keys, ids).tolist())) == want
    assert M.meet(keys[:0], ids[:0]).shape == (0, 2)
    # a run in two parts: the second goes on from the first's head
    same, own = np.full(40, 7, np.uint64), np.arange(40)
    parts = [*M.meet(same[:25], own[:25]).tolist(), *M.meet(same[25 - M.MOST :], own[25 - M.MOST :], (7, 0)).tolist()]
    assert set(map(tuple, parts)) == set(map(tuple, M.meet(same, own).tolist()))


def test_a_run_longer_than_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(M, "RUN", 50)
    packed = [bytearray(M.pack(i)) for i in pictures(2, 9)]
    feats = spark.createDataFrame([(i, packed[i % 2]) for i in range(120)], "id long, feats binary").repartition(4)
    met = [tuple(r) for r in M.candidates(feats).collect()]
    root = list(range(120))
    for a, b in sorted(met):
        root[b] = min(root[b], root[a])
    assert all(a % 2 == b % 2 for a, b in met) and root == [i % 2 for i in range(120)] and len(met) < 120 * 2 * M.MOST


def test_many_pairs_at_once_agree_as_one_does():
    rng = np.random.default_rng(8)
    images = pictures(12, 8)
    packed = [M.pack(M.decode(M.pgm(edit(i, rng)))) for i in images for edit in (lambda i, r: i, EDITS["cropped to 0.73"][0], EDITS["turned by 10"][0], EDITS["scaled to 1.2"][0])]
    one, two = (c.ravel() for c in np.indices((len(packed), len(packed))))
    every = M.grid(packed)
    want = np.array([M.consensus(packed[i], packed[j]) > 0 for i, j in zip(one, two)])
    assert 100 < want.sum() < len(want) / 2 and (M.may_agree(every, every, one, two) == want).all()


def test_pairs_that_share_words_cost_little(monkeypatch):
    """Their number grows as the square of the images: 25 of them are held against each other in the time that the features of one image take."""
    images = pictures(500, 13)
    began = time.process_time()
    packed = [M.pack(i) for i in images]
    features = (time.process_time() - began) / len(images)
    own, of = [M.words(M.unpack(x)[1]) for x in packed], np.arange(len(images))
    met = [(k, int(j)) for k, found in M.shared(own, own, of, of) for j in found]
    monkeypatch.setattr(M, "AT_ONCE", 1000)
    assert {(k, int(j)) for k, found in M.shared(own, own, of, of) for j in found} == set(met) and len(met) > 200
    one, two = np.array(met * (1000 // len(met) + 1)).T
    every = M.grid(packed)
    assert M.may_agree(every, every, one[: len(met)], two[: len(met)]).tolist() == [M.consensus(packed[i], packed[j]) > 0 for i, j in met]
    took = []
    for _ in range(5):
        began = time.process_time()
        for at in range(0, len(one), M.PAIRS):
            M.may_agree(every, every, one[at : at + M.PAIRS], two[at : at + M.PAIRS])
        took.append((time.process_time() - began) / len(one))
    assert 25 * min(took) < features


@pytest.mark.parametrize("kind", [np.complex64, np.complex128])
def test_places_of_many_runs_are_those_of_one(kind):
    rng = np.random.default_rng(14)
    points, worth, run = (rng.integers(0, 400, 900) + 1j * rng.integers(0, 400, 900)).astype(kind), rng.integers(1, 22, 900) / 21, rng.integers(0, 5, 900)
    assert np.allclose(M._places_of(run, points, worth, 6), [M._places(points[run == k], worth[run == k]) for k in range(6)])


def sketched(rng, own, logo):
    """Features of a picture: places of its own and a logo's, all in one scale."""
    rows = np.zeros(len(own[0]) + len(logo[0]), M.FEATURE)
    rows["x"], rows["y"] = np.concatenate([own[0], logo[0]]).T
    rows["bits"] = np.concatenate([own[1], logo[1]])
    return struct.pack("<ii", 400, 400) + rows.tobytes()


def test_a_link_whose_words_are_all_crowded(spark):
    """Twelve pictures share a logo too small to link them. Two are copies whose other features differ in each word: all words that they share are shared by all."""
    rng = np.random.default_rng(10)

    def some(n, low, high):
        return rng.integers(low, high, (n, 2)) * 9.0, rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64)

    logo = some(5, 40, 43)
    own = [some(40, 3, 36) for _ in range(12)]
    flip = np.zeros(M.BITS, np.uint8)
    flip[[part[0] for part in M.chunks()]] = 1
    own[9] = own[4][0], own[4][1] ^ np.packbits(flip).view(np.uint64)
    packed = [sketched(rng, o, logo) for o in own]
    assert {(i, j) for i in range(12) for j in range(i + 1, 12) if M.consensus(packed[i], packed[j]) > 0} == {(4, 9)}
    rows = [(i, bytearray(x), bytearray(M.words(M.unpack(x)[1]).tobytes())) for i, x in enumerate(packed)]
    frame = spark.createDataFrame(rows, "id long, feats binary, words binary")
    for blocks in (1, 3):
        feats = M.materialize(frame.repartition(blocks, "id"), "test")
        assert (4, 9) not in {tuple(r) for r in M.candidates(feats).collect()}
        none = spark.createDataFrame([], "v long, c long")
        assert [tuple(r) for r in M.rest(feats, none, blocks).collect()] == [(4, 9)]
        assert M.rest(feats, spark.createDataFrame([(4, 4), (9, 4)], "v long, c long"), blocks).count() == 0


def test_a_component_passes_by_its_own_crowd(monkeypatch):
    monkeypatch.setattr(M, "CROWD", 3)
    rng = np.random.default_rng(12)
    words = [np.unique(rng.integers(0, 60, 20).astype(np.uint64)) for _ in range(40)]
    of = rng.integers(0, 8, 40)
    got = {(k, int(j)) for k, found in M.shared(words, words, of, of) for j in found}
    assert got == {(i, j) for i in range(40) for j in range(40) if of[i] != of[j] and len(np.intersect1d(words[i], words[j])) >= M.MEETINGS}


def test_op7(spark, small, tmp_path):
    found = {r["media_id"]: r["component_id"] for r in queries()["op7_media"](spark, small).collect()}
    copies = [i for i in found if i % 2]
    assert copies and sum(found[i] == found[i - 1] for i in copies) >= 0.97 * len(copies)
    vectors = [r["embedding"] for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    equal = {}
    for i in found:
        equal.setdefault(tuple(vectors[i // 2]), []).append(i)
    first = {i: min(ids) for ids in equal.values() for i in ids}
    assert sum(found[i] != first[i] for i in found if i % 2 == 0) <= 0.005 * len(found)
    rows = [(None, [1.0, 2.0, 3.0, 4.0]), (4, None), (4, [0.5, None, 1.0, 2.0]), (5, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    odd = queries()["op7_media"](spark, f"file://{tmp_path}").collect()
    assert len(odd) == 6 and {r["component_id"] for r in odd if r["media_id"] is None} == {None}
