"""Best-fit packing of token pieces into sequences by minimum bin slack.

Lengths lie between 1 and the capacity, so a histogram of at most ``capacity``
counts describes any corpus. The driver plans on it: the longest length left
anchors a bin, a bitset subset-sum program over the available lengths finds the
fullest combination that fits beside it, and the combination is removed as
often as the counts allow. Pieces are then numbered within their length by a
range sort (a length that a third of all rows share spreads over many tasks)
and look their sequence and offset up in the plan, whose size the capacity
bounds.

Defined results: a null or empty text is one piece with the end id alone; long
texts are cut into pieces of the capacity, nothing is dropped; rows that repeat
are packed each; an empty table gives an empty result; further columns aren't
read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import WORDS, library_codec
from tessera.llm.common import map_batches, materialize, tokenizer_path
from tessera.llm.sharding import number_rows

CAPACITY = 2048
END_ID = 0
#: Bytes of a worker's memory of words where nothing else runs beside packing.
ALONE = 96 << 20


def cut(df: DataFrame, path: str, *, key: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, and the ids if asked for. words: bytes of a worker's memory of words."""

    def run(columns):
        own, lengths, crcs, ids, counts = library_codec(path, words), [], [], [], [0]
        for row in own.encode_many(columns[0].to_pylist()):
            row = np.append(row, np.uint32(end_id))
            for at in range(0, len(row), capacity):
                piece = row[at : at + capacity]
                lengths.append(len(piece))
                crcs.append(zlib.crc32(piece.astype("<u4").tobytes()))
                if with_ids:
                    ids.append(piece.astype(np.int32))
            counts.append(len(lengths))
        ends = pa.array(counts, pa.int32())
        out = [pa.ListArray.from_arrays(ends, pa.array(lengths, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(crcs, pa.int64()))]
        return [*out, pa.ListArray.from_arrays(ends, pa.array(ids, pa.list_(pa.int32())))] if with_ids else out

    fields = {"lengths": "array<int>", "crcs": "array<long>"} | ({"ids": "array<array<int>>"} if with_ids else {})
    rows = map_batches(df, [key], [F.col(text_col)], run, fields)
    zipped = F.arrays_zip(*fields)
    flat = rows.select(key, F.posexplode(zipped).alias("piece", "p"))
    return flat.select(
        key,
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.col("p.lengths").cast("long").alias("length"),
        F.col("p.crcs").alias("ids_crc32"),
        *([F.col("p.ids").alias("ids")] if with_ids else []),
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The available lengths, with multiplicity, whose sum comes nearest to ``room`` from below.

    Bit s of ``reach`` says that the sum s can be made; each layer adds some
    copies of one length, longest first, until the room is filled exactly.
    """
    mask, reach, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Minimum-bin-slack patterns: (length, first rank, copies a sequence, sequences, first sequence, first offset)."""
    left, used = {x: c for x, c in counts.items() if c}, dict.fromkeys(counts, 0)
    rows, sequence = [], 0
    while left:
        anchor = max(left)
        left[anchor] -= 1
        pattern = fullest(left, capacity - anchor)
        left[anchor] += 1
        pattern[anchor] = pattern.get(anchor, 0) + 1
        times, offset = min(left[x] // m for x, m in pattern.items()), 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, used[length], copies, times, sequence, offset))
            offset += length * copies
            used[length] += copies * times
            left[length] -= copies * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY, *, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """Materialized pieces with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows, first, total = plan(counts, capacity), {}, 0
    for length in sorted(counts):
        first[length], total = total, total + counts[length]
    table = np.array(sorted((first[x] + rank, copies, seq, offset, x) for x, rank, copies, _, seq, offset in rows), np.int64).reshape(-1, 5)
    shared = pieces.sparkSession.sparkContext.broadcast(table)

    def look_up(columns):
        number = columns[0].to_numpy()
        begin, copies, seq, offset, length = shared.value.T
        row = np.searchsorted(begin, number, "right") - 1
        inside = number - begin[row]
        return [pa.array(seq[row] + inside // copies[row]), pa.array(offset[row] + inside % copies[row] * length[row])]

    numbered, _ = number_rows(pieces, "length", *order)
    return map_batches(numbered, pieces.columns, [F.col("row_no")], look_up, {"sequence_id": "long", "offset": "long"})


def pack(df: DataFrame, path: str, *, key: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, words: int = WORDS) -> DataFrame:
    pieces = cut(df, path, key=key, text_col=text_col, capacity=capacity, end_id=end_id, with_ids=with_ids, words=words)
    return place(materialize(pieces, "pieces"), capacity, order=(key, "piece", "ids_crc32"))


def assemble(packed: DataFrame) -> DataFrame:
    """Whole sequences from pieces packed with their ids; a sequence holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, tokenizer_path("word_bpe_49k.json"), words=ALONE).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
