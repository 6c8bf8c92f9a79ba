"""Token ids in plane files: blocks of ids, transposed into byte planes, each plane compressed by zstandard.

A file is: magic, header (stream, ids of the stream before it), the planes of
each chunk, then the index (zstandard): for each chunk its place, its number of
ids and the sizes of its planes; for each document its key and number of ids;
and a trailer with the index's place, size and checksum. Planes that hold only
zeros have size 0. A reader finds any chunk, and so any document, from the
index alone.

Documents are dealt to streams by ranges of the key (bounds from the key column
alone), sorted within a stream and cut into files of about FILE_IDS ids, so
files in the order of their names hold all documents in ascending key order. A
key that many rows share spreads over streams of its own.

Defined results: a null or empty text is the end id alone; null keys come
first; rows with equal keys stay side by side; whole texts of any length are
written; an empty table writes no file and reads as no row; further columns
aren't read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import library_codec
from tessera.llm.common import materialize, text_slices, tokenizer_path
from tessera.llm.files import new_folder, put, read_folder

MAGIC = b"TPLANE1\n"
#: Ids of a chunk: one transposed block.
CHUNK_IDS = 1 << 16
#: Ids after which a file is closed; a document is never cut.
FILE_IDS = 1 << 22
#: Bytes of a worker's memory of words: writing needs little else.
WORDS = 96 << 20
#: magic, stream, ids of the stream before this file.
HEADER = struct.Struct("<8sqq")
#: index place, size, crc32, magic.
TRAILER = struct.Struct("<qqI8s")
#: A null key in the index.
NO_KEY = -(1 << 63)


def pack_file(ids: np.ndarray, keys: list, counts: list[int], stream: int, start: int) -> bytes:
    """One file image."""
    press = zstandard.ZstdCompressor(level=3).compress
    out, chunks = bytearray(HEADER.pack(MAGIC, stream, start)), []
    for at in range(0, len(ids), CHUNK_IDS):
        block = np.ascontiguousarray(ids[at : at + CHUNK_IDS], "<u4")
        planes = block.view(np.uint8).reshape(-1, 4).T
        sizes, begin = [], len(out)
        for plane in planes:
            data = press(plane.tobytes()) if plane.any() else b""
            out += data
            sizes.append(len(data))
        chunks.append((begin, len(block), *sizes))
    keys = [NO_KEY if k is None else k for k in keys]
    raw = struct.pack("<qq", len(chunks), len(keys)) + np.array(chunks, "<i8").tobytes() + np.array(keys, "<i8").tobytes() + np.array(counts, "<i8").tobytes()
    index = press(raw)
    return bytes(out) + index + TRAILER.pack(len(out), len(index), zlib.crc32(index), MAGIC)


def read_index(data) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """stream, start, chunks (place, ids, four plane sizes), keys, counts; ValueError if the file is damaged."""
    magic, stream, start = HEADER.unpack_from(data, 0)
    place, size, crc, tail = TRAILER.unpack_from(data, len(data) - TRAILER.size)
    index = bytes(data[place : place + size])
    if magic != MAGIC or tail != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("damaged token file")
    raw = zstandard.ZstdDecompressor().decompress(index)
    n_chunks, n_docs = struct.unpack_from("<qq", raw, 0)
    numbers = np.frombuffer(raw, "<i8", offset=16)
    chunks, rest = numbers[: 6 * n_chunks].reshape(-1, 6), numbers[6 * n_chunks :]
    return stream, start, chunks, rest[:n_docs], rest[n_docs:]


def read_chunk(data, chunk) -> np.ndarray:
    begin, n, *sizes = (int(x) for x in chunk)
    planes, unpress = np.zeros((4, n), np.uint8), zstandard.ZstdDecompressor().decompress
    for k, size in enumerate(sizes):
        if size:
            planes[k] = np.frombuffer(unpress(bytes(data[begin : begin + size])), np.uint8)
            begin += size
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def read_ids(data, chunks, first: int = 0, last: int | None = None) -> np.ndarray:
    """ids[first:last] of a file, from the chunks that hold them."""
    ends = np.cumsum(chunks[:, 1]) if len(chunks) else np.zeros(0, np.int64)
    last = int(ends[-1]) if last is None and len(ends) else (last or 0)
    a, b = np.searchsorted(ends, first, "right"), np.searchsorted(ends, last, "left") + 1
    parts = [read_chunk(data, c) for c in chunks[a:b]]
    begin = int(ends[a - 1]) if a else 0
    return np.concatenate(parts)[first - begin : last - begin] if parts else np.empty(0, np.uint32)


def range_stream(df: DataFrame, key: str, streams: int, salt: Column):
    """A column with the number of the key range a row belongs to, found by bisection of quantile bounds.

    A key that several quantiles hit has as many streams of its own, side by
    side, among which the hash of ``salt`` chooses.
    """
    cuts = [k / streams for k in range(1, streams)]
    bounds = sorted(int(x) for x in df.select(F.col(key).cast("double")).approxQuantile(key, cuts, 0.25 / streams)) if cuts else []
    if not bounds:
        return F.lit(0)
    values = sorted(set(bounds))
    first = [bounds.index(v) for v in values]
    array = f"array({', '.join(f'{b}L' for b in values)})"
    places = f"array({', '.join(map(str, [*first, len(bounds)]))})"
    times = f"array({', '.join(str(bounds.count(v)) for v in values)})"
    steps = len(values).bit_length()
    # lo counts the distinct bounds below the key
    found = (
        f"aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', {len(values)}), (s, i) -> "
        f"CASE WHEN s.lo >= s.hi THEN s WHEN get({array}, (s.lo + s.hi) div 2) < `{key}` "
        f"THEN named_struct('lo', cast((s.lo + s.hi) div 2 AS int) + 1, 'hi', s.hi) ELSE named_struct('lo', s.lo, 'hi', cast((s.lo + s.hi) div 2 AS int)) END, s -> s.lo)"
    )
    if len(values) == len(bounds):
        return F.coalesce(F.expr(found), F.lit(0))
    # the one-element array binds the place once
    at = F.transform(F.array(F.expr(found)), lambda i: F.get(F.expr(places), i) + F.when(F.get(F.expr(array), i) == F.col(key), F.pmod(F.xxhash64(salt), F.get(F.expr(times), i)).cast("int")).otherwise(F.lit(0)))
    return F.coalesce(at[0], F.lit(0))


def write_files(df: DataFrame, path: str, folder: str, *, key: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Encode, append the end id, write; the manifest (stream, name, docs, ids) is returned, written once."""
    streams = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(key).cast("long").alias("key"), F.col(text_col).alias("text"))
    dealt = dealt.withColumn("stream", range_stream(dealt, "key", streams, F.col("text")))
    dealt = dealt.repartitionById(streams, F.col("stream")).sortWithinPartitions("stream", "key")

    def write(batches):
        own, held = library_codec(path, WORDS), {"stream": None, "seq": 0, "start": 0, "keys": [], "rows": [], "n": 0}

        def close():
            if not held["keys"]:
                return None
            ids, counts = np.concatenate(held["rows"]), [len(r) for r in held["rows"]]
            name = f"part-{held['stream']:06d}-{held['seq']:06d}.tpl"
            put(f"{folder}/{name}", pack_file(ids, held["keys"], counts, held["stream"], held["start"]))
            row = (held["stream"], name, len(counts), len(ids))
            held.update(seq=held["seq"] + 1, start=held["start"] + len(ids), keys=[], rows=[], n=0)
            return row

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["stream", "name", "docs", "ids"])

        for batch in batches:
            for part in text_slices(batch, 1):
                ids, ends = own.encode_column(part.column(1))
                ids, ends = np.insert(ids, ends, end_id), (ends + np.arange(1, len(ends) + 1)).tolist()
                for k, begin, end, stream in zip(part.column(0).to_pylist(), [0, *ends], ends, part.column(2).to_pylist()):
                    if stream != held["stream"] or held["n"] >= FILE_IDS:
                        if row := close():
                            yield table([row])
                        if stream != held["stream"]:
                            held.update(stream=stream, seq=0, start=0)
                    held["keys"].append(k)
                    held["rows"].append(ids[begin:end])
                    held["n"] += end - begin
        if row := close():
            yield table([row])

    return materialize(dealt.mapInArrow(write, "stream int, name string, docs long, ids long"), "manifest")


def read_files(spark: SparkSession, folder: str, manifest: DataFrame, *, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Each document from the files: key, start, n_tokens, ids_crc32, and the ids if asked for.

    The driver adds up one number for each stream; the streams are as many as
    the shuffle partitions, whatever the input.
    """
    totals = sorted((r["stream"], r["n"]) for r in manifest.groupBy("stream").agg(F.sum("ids").alias("n")).collect())
    first, total = {}, 0
    for stream, n in totals:
        first[stream], total = total, total + n

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                view = memoryview(data.as_buffer())
                stream, start, chunks, keys, counts = read_index(view)
                ids = read_ids(view, chunks).astype("<u4")
                ends = np.cumsum(counts)
                begins = ends - counts
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends)]
                columns = [pa.array([None if k == NO_KEY else k for k in keys.tolist()], pa.int64()), pa.array(begins + start + first[stream]), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [key, "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    ddl = f"`{key}` long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return read_folder(spark, folder).select("content").mapInArrow(read, ddl)


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "token-files")
    manifest = write_files(docs, tokenizer_path("byte_bpe_50k.json"), folder)
    return read_files(spark, folder, manifest)
