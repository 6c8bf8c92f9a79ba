import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, common, packing, separator_scan, token_files
from tessera.llm.common import tokenizer_path
from tessera.llm.files import new_folder
from tessera.llm.queries import queries
from tests.llm.conftest import ODD, prose

tokenizers = pytest.importorskip("tokenizers")
TEXTS = [*[t for t in ODD if t], "Hello WORLD's it's foo_bar ÀÉ 1234", "ΑΣ İ \x1c a\x1cb", "é" * 70 + "ab" * 100, "'''s 'S don'T   ​ x \x85 y", "ﬁ ǅ ß ẞ", "<|ENDOFTEXT|>", "x<|endoftext|><|endoftext|> ", " lead  two\t\ttabs\n\nnl ", " \n", "a \nb", "the" * 90]


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def path(request):
    return tokenizer_path(request.param)


def library(path):
    return tokenizers.Tokenizer.from_file(path)


@pytest.mark.parametrize("kind", [bpe.Codec, bpe.LibraryCodec])
def test_codec_equals_the_library(path, kind):
    own, theirs, rng = kind(path), library(path), random.Random(4)
    pieces = ["the", "ing", " ", "  ", "\n", "É", "ß", "'s", "1", "!", "日", "\t", "Q", "_", "́"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(400)]
    many = own.encode_many([None, *texts, ""])
    assert len(many[0]) == len(many[-1]) == 0
    for text, both, want in zip(texts, many[1:], theirs.encode_batch(texts, add_special_tokens=False)):
        got = own.encode(text).tolist()
        assert got == both.tolist()
        assert got == want.ids, repr(text)
        assert own.decode(got) == theirs.decode(got, skip_special_tokens=False)
    assert len(own.encode(None)) == 0 and own.decode([]) == ""


def test_every_code_point_is_split_as_by_the_library(path):
    own, theirs = bpe.Codec(path), library(path)
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (i < 0x3400 or i % 5 == 0 or unicodedata.category(chr(i)) == "Cn" and i < 0x40000)]
    for at in range(0, len(points), 20_000):
        texts = [f"a{chr(i)}b" for i in points[at : at + 20_000]]
        assert [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)) if own.encode(t).tolist() != e.ids] == []


def test_blocks_of_words_leave_texts_whole(path, monkeypatch):
    texts = [*TEXTS, prose(700), None, "", "y" * 900 + " y " + "y" * 900, prose(40, 2)]
    want = [x.tolist() for x in bpe.Codec(path).encode_many(texts)]
    for block in (1, 7, 300):
        monkeypatch.setattr(bpe, "BLOCK", block)
        own = bpe.Codec(path)
        assert [x.tolist() for x in own.encode_many(texts)] == want
        assert max(map(len, own.words)) <= bpe.SHORT


def test_columns_of_bytes_equal_the_library(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    theirs, rng = library(path), random.Random(6)
    pieces = ["a", "Foo", "x1", " ", " ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x7f", ".", ",", "!", "'s", "é", "É,", "×.", "÷", "日", "ж", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "—", "’", "\u2029", "\u202f", "\u205f", "\u3000", "😀", "<|", "<|endoftext|>", "y" * 70]
    texts = ["", *TEXTS, *["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(1200)], "\n", "", ""]
    want = [e.ids for e in theirs.encode_batch(texts, add_special_tokens=False)]
    column = pa.array([None, "left out", *texts, None])
    for block in (3, 64, bpe.BLOCK_BYTES):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", block)
        for type_ in (pa.string(), pa.large_string()):
            ids, ends = bpe.LibraryCodec(path).encode_column(column.cast(type_).slice(2))
            assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [*want, []]
    for empty in ([], [None], ["", None]):
        ids, ends = bpe.LibraryCodec(path).encode_column(pa.array(empty, pa.string()))
        assert len(ids) == 0 and ends.tolist() == [0] * len(empty)


def test_each_distinct_word_is_split_once_whatever_stands_between_words():
    path = tokenizer_path("byte_bpe_50k.json")
    own, seen = bpe.LibraryCodec(path), []
    split = own.pieces
    own.pieces = lambda text: seen.append(text) or split(text)
    text = "One  two,\n\nthree\tfour <|endoftext|> five. \x02\n" * 500
    assert own.encode(text).tolist() == library(path).encode(text, add_special_tokens=False).ids
    assert sum(map(len, seen)) < 200


def test_caches_stay_within_their_bytes(path):
    own, rng = bpe.LibraryCodec(path), random.Random(3)
    own.known.most, own.most_words = 500, 500
    for _ in range(60):
        own.encode_many([" ".join("".join(rng.choices("abcdefghijklmnop", k=9)) + rng.choice(["", ",", "7!"]) for _ in range(200))])
        assert len(own.words) <= 500 and max(len(own.known), len(own.known.old)) <= 500
    assert bpe.WORDS + 2 * bpe.REMEMBERED <= 64 << 20


def test_long_words_merge_alike(path):
    own, rng = bpe.Codec(path), random.Random(2)
    letters = [i for t, i in own.vocab.items() if len(t) == 1][:40]
    for _ in range(60):
        parts = rng.choices(letters, k=rng.randint(1, bpe.SHORT))
        assert own.merge(list(parts)) == own.merge_long(list(parts))


def test_remembered_pieces_survive_a_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3 * bpe.ENTRY)
    made = []
    cache = bpe.Remembered(lambda p: made.append(p) or p.encode())
    assert [cache[p] for p in "abcdabcd"] == [p.encode() for p in "abcdabcd"] and made == list("abcd")


def test_encode_decode_frames(spark, odd, none):
    path = tokenizer_path("byte_bpe_50k.json")
    ids = bpe.encode(odd, path)
    assert ids.columns == ["doc_id", "lang", "source", "n_tokens", "kept", "ids"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(ids, path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    assert bpe.encode(none, path).count() == 0
    assert bpe.decode(ids.withColumn("ids", F.lit(None).cast("array<int>")), path).where("text <> ''").count() == 0


def test_op2(spark, small):
    theirs = library(tokenizer_path("word_bpe_49k.json"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries()["op2_bpe"](spark, small).collect():
        ids = theirs.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = theirs.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, small):
    theirs, want, start = library(tokenizer_path("byte_bpe_50k.json")), [], 0
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*theirs.encode(r["text"], add_special_tokens=False).ids, 0]
        want.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    got = queries()["op3_token_files"](spark, small)
    assert [tuple(r) for r in got.orderBy("doc_id").select("doc_id", "start", "n_tokens", "ids_crc32").collect()] == want


@pytest.mark.parametrize("n", [0, 1, token_files.CHUNK_IDS - 1, token_files.CHUNK_IDS, 3 * token_files.CHUNK_IDS + 5])
def test_plane_files_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 1 << (8 * (n % 4 + 1)), n, dtype=np.uint32)
    counts = [n // 3, n - n // 3] if n else []
    data = token_files.pack_file(ids, [4, None][: len(counts)], counts, 3, 17)
    stream, start, chunks, keys, found = token_files.read_index(data)
    assert (stream, start, found.tolist()) == (3, 17, counts) and keys.tolist() == [4, token_files.NO_KEY][: len(counts)]
    assert (token_files.read_ids(data, chunks) == ids).all()
    for a, b in ((0, min(n, 5)), (n // 3, n), (max(n - 2, 0), n)):
        assert (token_files.read_ids(data, chunks, a, b) == ids[a:b]).all()
    with pytest.raises(ValueError):
        token_files.read_index(data[:-30] + b"x" + data[-29:])


def test_token_files_of_odd_rows(spark, odd, none, monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    folder = new_folder(spark, "test-files")
    manifest = token_files.write_files(odd, path, folder)
    rows = token_files.read_files(spark, folder, manifest, with_ids=True).orderBy("start").collect()
    keys = [r["doc_id"] for r in rows]
    assert keys == [None, *sorted(k for k in keys if k is not None)] and len(rows) == odd.count()
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    assert all(len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 0 for r in rows)
    folder = new_folder(spark, "test-files")
    assert token_files.read_files(spark, folder, token_files.write_files(none, path, folder)).count() == 0


def test_long_texts_are_encoded_alone(monkeypatch):
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["abc", None, "é" * 4, "x" * 50, "", "x" * 10, "yy", "zzz"]
    parts = [p.column(1).to_pylist() for p in common.text_slices(pa.record_batch({"k": list(range(10)), "t": [*texts, None, "é" * 30]}), 1)]
    assert parts == [["abc", None], ["é" * 4], ["x" * 50], ["", "x" * 10], ["yy", "zzz", None], ["é" * 30]]
    assert list(common.text_slices(pa.record_batch({"k": pa.array([], pa.int64()), "t": pa.array([], pa.string())}), 1)) == []


def test_streams_follow_the_key(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"))
    rows = df.withColumn("s", token_files.range_stream(df, "k", 8, F.col("k"))).orderBy("k").collect()
    streams = [r["s"] for r in rows]
    assert streams == sorted(streams) and len(set(streams)) == 8 and max(streams.count(s) for s in set(streams)) < 300


def test_a_key_of_many_rows_has_streams_of_its_own(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, F.lit(500)).otherwise(F.col("id") % 1000).alias("k"), "id")
    rows = df.withColumn("s", token_files.range_stream(df, "k", 8, F.col("id"))).orderBy("s", "k").collect()
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)
    assert len({r["s"] for r in rows if r["k"] == 500}) >= 3 and max(sum(r["s"] == s for r in rows) for s in range(8)) < 900
    path, folder = tokenizer_path("byte_bpe_50k.json"), new_folder(spark, "test-files")
    docs = df.select(F.col("k").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    back = token_files.read_files(spark, folder, token_files.write_files(docs, path, folder)).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted(r["k"] for r in rows) and [r["start"] for r in back] == np.cumsum([0, *(r["n_tokens"] for r in back)])[:-1].tolist()


def test_op9_and_blocks_of_any_size(spark, small):
    theirs = library(tokenizer_path("byte_bpe_50k.json"))
    want = {r["doc_id"]: len(theirs.encode(r["text"], add_special_tokens=False).ids) + 1 for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = queries()["op9_token_counts"](spark, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(want)
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(3)
    folder = new_folder(spark, "test-flat")
    keys = separator_scan.write_flat(docs, tokenizer_path("byte_bpe_50k.json"), folder, end_id=50256, file_ids=3000)
    for block in (7, 1000, 1 << 20):
        counts = separator_scan.count_tokens(separator_scan.scan_blocks(spark, folder, end_id=50256, block_ids=block))
        assert {r["key"]: r["n_tokens"] for r in keys.join(counts, ["stream", "ordinal"]).collect()} == want


def test_op9_on_odd_rows(spark, odd, tmp_path):
    path = tokenizer_path("byte_bpe_50k.json")
    (tmp_path / "sf").mkdir()
    odd.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").coalesce(1).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    theirs, rows = library(path), odd.collect()
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len(theirs.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in rows)
    got = queries()["op9_token_counts"](spark, f"file://{tmp_path}/sf").collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == want
    for r in {(r["stream"]) for r in got}:
        own = sorted((x["ordinal"], x["start"], x["n_tokens"]) for x in got if x["stream"] == r)
        assert [x[1] for x in own] == np.cumsum([0, *(x[2] for x in own)])[:-1].tolist()


def test_ends_that_do_not_match_the_documents_are_errors(spark, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    with pytest.raises(Exception, match="yields the end id"):
        separator_scan.write_flat(odd, path, new_folder(spark, "test-flat"), end_id=50256)
    keys = spark.createDataFrame([(7, 0, 0), (8, 0, 1)], "key long, stream int, ordinal long")
    counts = "stream int, ordinal long, start long, n_tokens long, ended boolean"
    rows = [(0, 0, 0, 4, True), (0, 1, 4, 2, True), (0, 2, 6, 1, True)]
    assert separator_scan.match(keys, spark.createDataFrame(rows[:2], counts)).select("key", "n_tokens").orderBy("key").collect() == [(7, 4), (8, 2)]
    for odd_rows in (rows, rows[:1], [rows[0], (*rows[1][:4], False)]):
        with pytest.raises(Exception, match="documents and segments differ"):
            separator_scan.match(keys, spark.createDataFrame(odd_rows, counts)).select("n_tokens").collect()


def test_scan_of_plain_files(spark, tmp_path):
    streams = {0: [5, 9, 9, 1, 2, 3, 9], 1: [1, 2], 2: [9], 3: []}
    (tmp_path / "f").mkdir()
    for s, ids in streams.items():
        for k in range(0, max(len(ids), 1), 3):
            (tmp_path / f"f/{s:06d}-{k // 3:06d}.bin").write_bytes(np.array(ids[k : k + 3], "<u2").tobytes())
    blocks = separator_scan.scan_blocks(spark, f"file://{tmp_path}/f", end_id=9, block_ids=2)
    got = [tuple(r) for r in separator_scan.count_tokens(blocks).orderBy("stream", "ordinal").collect()]
    assert got == [(0, 0, 0, 2, True), (0, 1, 2, 1, True), (0, 2, 3, 4, True), (1, 0, 0, 2, False), (2, 0, 0, 1, True)]


def check_packing(rows, capacity):
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_op4(spark, small):
    theirs, want = library(tokenizer_path("word_bpe_49k.json")), []
    for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = [*theirs.encode(r["text"], add_special_tokens=False).ids, 0]
        want += [(r["doc_id"], k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    rows = queries()["op4_packing"](spark, small).orderBy("doc_id", "piece").collect()
    assert [tuple(r)[:5] for r in rows] == want
    assert check_packing(rows, 2048) <= -(-sum(w[3] for w in want) // 2048) + 1


def fewest(lengths, capacity):
    """Fewest bins by search over which items share a bin."""
    best, n = {0: (0, 0)}, len(lengths)
    for mask in range(1, 1 << n):
        options = []
        for i in range(n):
            if mask >> i & 1:
                bins, room = best[mask ^ 1 << i]
                options.append((bins, room - lengths[i]) if room >= lengths[i] else (bins + 1, capacity - lengths[i]))
        best[mask] = min(options, key=lambda o: (o[0], -o[1]))
    return best[(1 << n) - 1][0]


def test_plan_is_near_the_optimum():
    rng, over = random.Random(8), 0
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 10))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        bins = 1 + max(seq + times - 1 for _, _, _, times, seq, _ in packing.plan(counts, 20))
        over += bins - fewest(lengths, 20)
        assert bins >= fewest(lengths, 20)
    assert over <= 1
    assert packing.plan({}, 20) == []


def test_fullest_combination():
    assert packing.fullest({7: 1, 5: 2, 3: 1}, 10) == {5: 2}
    assert packing.fullest({9: 1}, 8) == {} and packing.fullest({4: 9}, 11) == {4: 2}
    rng = random.Random(1)
    for _ in range(200):
        counts, room = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(5)}, rng.randint(0, 60)
        sums = {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        chosen = packing.fullest(counts, room)
        assert sum(x * k for x, k in chosen.items()) == max(s for s in sums if s <= room) and all(k <= counts[x] for x, k in chosen.items())


def test_packing_of_odd_rows(spark, odd, none):
    packed = packing.pack(odd, tokenizer_path("word_bpe_49k.json"), capacity=64, with_ids=True)
    rows = packed.collect()
    check_packing(rows, 64)
    assert {r["doc_id"] for r in rows} == {*range(len(ODD)), None} and [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    sequences = {r["sequence_id"]: r["ids"] for r in packing.assemble(packed).collect()}
    for r in rows:
        assert sequences[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]
    assert packing.pack(none, tokenizer_path("word_bpe_49k.json")).count() == 0


def test_long_prose_is_whole():
    own = bpe.Codec(tokenizer_path("byte_bpe_50k.json"))
    text = prose(30_000)
    assert own.decode(own.encode(text)) == text
