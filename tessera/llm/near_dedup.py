"""Near-duplicate documents: MinHash with a forest of sorted signature orders.

A document is the set of its distinct word shingles. Rows with equal sets form
a class, and one document stands for it, so copies cost one row each from then
on. The signatures of the classes are sorted in TREES orders (rotations of one
signature). Classes whose first BASE values agree form a region.

Candidates are confirmed on the full sets, in three passes. In the first each
region proposes its smallest member as a hub, and each class is held against the
hub it met in most orders; that joins large groups of copies at once. In the
second the depth adapts to the region: in sorted order, so by longest common
prefix first, rows look at the rows around them that belong to other components
and whose sketch (a bit of each value) could be near enough; of two components
the smaller one's rows ask, and they ask the nearest rows of each. A crowded
region thus compares the deepest prefixes, a sparse one all its pairs, and the
rows made grow with the rows read.
The third pass handles what the second left out. Of each region in which a row
may have had more partners than it asked, all pairs of rows of components that
are still different are compared, in cells of two blocks of rows with their
whole sets: by size and sketch, and what is left on the full sets at once, the
nearest first and a component only until it joins. A cell returns no pairs but
the links that join components, so a crowded region spreads over the tasks and
makes few rows; its work grows with the square of its rows less those of its
largest component. Orders are dealt by range over (region, suffix, id), so even
a region with a third of all rows spreads over the tasks, and what partition
borders cut apart is stitched.

Defined results: a text without words, or null, has an empty set, is linked
with nothing and is its own component; fewer words than a shingle form one
shingle; rows with a null key are linked with nothing, have no component and
are kept; rows with equal keys belong together, whatever their texts, and each
counts its own shingles; an empty table gives an empty result; only key and
text are read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, map_batches, materialize
from tessera.llm.components import components, extend, same_id_links, vertices, vertices_of_bare

#: Words of a shingle; percentage of intersection over union from which documents are linked.
WORDS, PERCENT = 5, 75
#: Signature values; orders; values that make a region; further values that an order sorts by.
HASHES, TREES, BASE, SUFFIX = 128, 32, 4, 12
#: A row is compared with so many rows of each of so many nearest other components, found within so many places of it in an order.
BEST, NEAR, WINDOW = 4, 8, 64
#: Rows and shingles of one block of a region whose pairs are all compared; rows of it that are compared at once; partners of a row held against its set at once.
CELL, CELL_SHINGLES, STRIPE, ASKED = 2048, 1 << 19, 64, 64
#: Rows of one region that a task holds at once.
CHUNK = 8192
#: Matching signature values below which a pair isn't held against the full sets: six standard deviations under the threshold.
LEAST_MATCHES = int(HASHES * PERCENT / 100 - 6 * (HASHES * PERCENT / 100 * (1 - PERCENT / 100)) ** 0.5)
#: A sketch holds one bit of each signature value; two sketches that differ in more bits are no candidates: six standard deviations from the threshold.
MOST_FLIPS = int(HASHES * (1 - PERCENT / 100) / 2 + 6 * (HASHES * (1 - PERCENT / 100) / 2 * (1 + PERCENT / 100) / 2) ** 0.5)
SKETCH = HASHES // 8


@functools.lru_cache(1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return tuple(rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for n in (WORDS + 1, HASHES, HASHES))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    mult = constants()[0]
    n = max(len(h) - WORDS + 1, 1)
    mixed = np.full(n, min(len(h), WORDS), np.uint64) * mult[WORDS]
    for j in range(min(WORDS, len(h))):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * mult[j] + h[j : j + n]
    mixed ^= mixed >> np.uint64(32)
    mixed *= mult[0]
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES 32-bit values; block by block, so that long sets need little memory."""
    _, mult, flip = constants()
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = (hashes[None, at : at + 2048] ^ flip[:, None]) * mult[:, None]
        np.minimum(least, block.min(1), out=least)
    return (least & np.uint64(0xFFFFFFFF)).astype("<u4")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both) > 0


def set_id(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def describe(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """Materialized: key, n_shingles, set_id (null if empty), signature."""

    def run(columns):
        n, ids, sigs = [], [], []
        for text in columns[0].to_pylist():
            own = shingles(text)
            n.append(len(own))
            ids.append(set_id(own))
            sigs.append(signature(own).tobytes() if len(own) else None)
        return [pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())]

    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text_col).alias("text"))
    return materialize(map_batches(rows, ["id"], [F.col("text")], run, {"n_shingles": "long", "set_id": "binary", "signature": "binary"}), "sets")


def orders(classes: DataFrame) -> DataFrame:
    """For each class and order: region, suffix (SUFFIX values, then the sketch), id, n_shingles."""

    def turn(batches):
        order = (np.arange(TREES)[:, None] * (HASHES // TREES) + np.arange(BASE + SUFFIX)) % HASHES
        mult = constants()[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sigs = np.frombuffer(b"".join(part.column(2).to_pylist()), "<u4").reshape(-1, HASHES)
                values = sigs[:, order]  # class, order, place
                region = np.arange(TREES, dtype=np.uint64) * mult[0]
                for j in range(BASE):
                    region = (region ^ (region >> np.uint64(31))) * mult[j] + values[:, :, j]
                region = ((region ^ (region >> np.uint64(32))) * mult[BASE]).view(np.int64)
                sketch = np.packbits((sigs & 1).astype(np.uint8), axis=1)
                deeper = np.ascontiguousarray(values[:, :, BASE:].astype(">u2")).view(np.uint8)
                suffix = np.concatenate([deeper, np.repeat(sketch[:, None], TREES, 1)], axis=2)
                rows = len(sigs) * TREES
                ends = np.arange(rows + 1, dtype=np.int32) * (2 * SUFFIX + SKETCH)
                binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(suffix)])
                ids, sizes = (np.repeat(part.column(i).to_numpy(), TREES) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(region.ravel()), binary, pa.array(ids), pa.array(sizes)], names=["region", "suffix", "id", "n"])

    return classes.select("id", "n_shingles", "signature").mapInArrow(turn, "region long, suffix binary, id long, n long")


class Hubs:
    """Rows of one region, given in order; yields (id, hub) for each, and links the hubs of its pieces."""

    def __init__(self):
        self.hub, self.held = None, None

    def add(self, ids: np.ndarray):
        hub = int(ids.min())
        if self.hub is not None and hub != self.hub:
            yield max(hub, self.hub), min(hub, self.hub)
        for i in ids.tolist():
            yield i, hub
        self.hub = hub if self.hub is None else min(hub, self.hub)


class Neighbours:
    """Rows (id, size, component, rows of the component, sketch) of one region, given in order; yields the pairs to be compared.

    Of two components the smaller one asks. Each of its rows looks WINDOW places
    to either side, at rows whose size and sketch allow a link, and asks the BEST
    of each of the NEAR other components that have the nearest sketches.
    """

    def __init__(self):
        self.rows, self.at = deque(), 0

    def add(self, row: tuple[int, int, int, int, int]):
        self.rows.append(row)
        if len(self.rows) - self.at > WINDOW:
            yield from self.ask()

    def end(self):
        while self.at < len(self.rows):
            yield from self.ask()

    def ask(self):
        i, n, c, members, sketch = self.rows[self.at]
        found: dict[int, list[tuple[int, int]]] = {}
        for j, m, d, others, other in self.rows:
            if d == c or (members, c) > (others, d):
                continue
            flips = (sketch ^ other).bit_count()
            if flips <= MOST_FLIPS and 100 * min(m, n) >= PERCENT * max(m, n):
                found.setdefault(d, []).append((flips, j))
        for _, asked in heapq.nsmallest(NEAR, ((min(x), x) for x in found.values())):
            for _, j in heapq.nsmallest(BEST, asked):
                yield min(i, j), max(i, j)
        self.at += 1
        if self.at > WINDOW:
            self.rows.popleft()
            self.at -= 1


def _runs(keys: np.ndarray):
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.append(0, cuts), np.append(cuts, len(keys))


def _table(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, names.values())], names=list(names))


def crowd(sorted_orders: DataFrame) -> DataFrame:
    """Materialized: (region, suffix, id, n, hub) of the rows that share a region with others.

    Regions that partition borders cut are put together by the borders' rows, a
    few for each partition, on the driver: they are (id, hub) links of their own.
    """
    names = {"kind": pa.int32(), "pid": pa.int32(), "region": pa.int64(), "suffix": pa.binary(), "id": pa.int64(), "n": pa.int64(), "hub": pa.int64()}

    def walk(batches):
        pid, open_region, hubs, out = TaskContext.get().partitionId(), None, None, []

        first_region = None

        def settle(last=False):
            # a region of one row is no region, but at a partition's end or begin it may be part of one
            if hubs is not None and hubs.held is not None and (last or open_region == first_region):
                out.append((2, pid, open_region, *hubs.held, hubs.hub))

        for batch in batches:
            keys, ids, sizes = (batch.column(i).to_numpy() for i in (0, 2, 3))
            if not len(keys):
                continue
            suffixes = batch.column(1)
            begins, ends = _runs(keys)
            wanted = (ends - begins > 1) | (begins == 0) | (ends == len(keys))
            for k in np.flatnonzero(wanted):
                a, b = int(begins[k]), int(ends[k])
                if hubs is None or int(keys[a]) != open_region:
                    settle()
                    hubs, open_region = Hubs(), int(keys[a])
                for c in range(a, b, CHUNK):
                    d = min(b, c + CHUNK)
                    values = suffixes.slice(c, d - c).to_pylist()
                    known = hubs.hub is not None
                    found = list(hubs.add(ids[c:d]))
                    links, rows = found[: len(found) - (d - c)], found[len(found) - (d - c) :]
                    out += [(1, pid, open_region, None, i, None, h) for i, h in links]
                    whole = [(0, pid, open_region, v, i, n, h) for v, (i, h), n in zip(values, rows, sizes[c:d].tolist())]
                    if first_region is None:
                        first_region = open_region
                        out.append((3, pid, open_region, values[0], rows[0][0], int(sizes[c]), hubs.hub))
                    if known and hubs.held is not None:
                        out.append((0, pid, open_region, *hubs.held, hubs.held[1]))
                        hubs.held = None
                    if len(whole) == 1 and not known:
                        hubs.held = (values[0], rows[0][0], int(sizes[c]))
                    else:
                        out += whole
                    if len(out) > 20_000:
                        yield _table(out, names)
                        out = []
        if hubs is not None:
            settle(last=True)
            out.append((4, pid, open_region, None, hubs.hub, None, hubs.hub))
        yield _table(out, names)

    ddl = "kind int, pid int, region long, suffix binary, id long, n long, hub long"
    return materialize(sorted_orders.mapInArrow(walk, ddl), "crowd")


def stitch(rows: list) -> list[tuple[int, int]]:
    """(id, hub) links across the borders of neighbouring partitions whose regions meet there."""
    parts: dict[int, dict[int, tuple[int, int]]] = {}
    for r in rows:
        parts.setdefault(r["pid"], {})[r["kind"]] = (r["region"], r["hub"])
    ordered = [parts[p] for p in sorted(parts)]
    links = [(one[4][1], two[3][1]) for one, two in zip(ordered, ordered[1:]) if one[4][0] == two[3][0]]
    links += [(one[4][1], two[4][1]) for one, two in zip(ordered, ordered[1:]) if one[4][0] == two[3][0] == two[4][0]]
    return [(max(a, b), min(a, b)) for a, b in links if a != b]


def hub_pairs(found: DataFrame) -> DataFrame:
    """(a, b): each class with the hub it met in most trees, the smaller on a tie."""
    borders = stitch(found.where("kind > 2").select("pid", "kind", "region", "hub").orderBy("pid", "kind").collect())
    met = found.where("kind < 2 AND id <> hub").select("id", "hub")
    if borders:
        met = met.unionByName(found.sparkSession.createDataFrame(borders, "id long, hub long"))
    votes = met.select(F.greatest("id", "hub").alias("b"), F.least("id", "hub").alias("a")).groupBy("a", "b").agg(F.count("*").alias("n"))
    return votes.groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")


def neighbour_pairs(sorted_rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) from rows (region, id, n, c, members, suffix) in order; border rows of a partition, WINDOW at either end, go over the driver."""
    names = {"pid": pa.int32(), "end": pa.int32(), "region": pa.int64(), "a": pa.int64(), "b": pa.int64(), "c": pa.int64(), "members": pa.int64(), "sketch": pa.binary()}

    def walk(batches):
        pid, region, near, out, head = TaskContext.get().partitionId(), None, None, [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for key, i, n, c, members, suffix in zip(*columns):
                if key != region:
                    if head is None:
                        head = (key, 0)
                    if near is not None:
                        out += [(pid, None, region, a, b, None, None, None) for a, b in near.end()]
                    region, near = key, Neighbours()
                if key == head[0] and head[1] < WINDOW:
                    out.append((pid, 0, key, i, n, c, members, suffix[-SKETCH:]))
                    head = (key, head[1] + 1)
                row = (i, n, c, members, int.from_bytes(suffix[-SKETCH:]))
                out += [(pid, None, key, a, b, None, None, None) for a, b in near.add(row)]
                if len(out) > 20_000:
                    yield _table(out, names)
                    out = []
        if near is not None:
            out += [(pid, None, region, a, b, None, None, None) for a, b in near.end()]
            out += [(pid, 1, region, *row[:4], row[4].to_bytes(SKETCH)) for row in list(near.rows)[-WINDOW:]]
        yield _table(out, names)

    chosen = sorted_rows.select("region", "id", "n", "c", "members", "suffix")
    found = materialize(chosen.mapInArrow(walk, "pid int, end int, region long, a long, b long, c long, members long, sketch binary"), "neighbours")
    pairs = found.where("end IS NULL").select("a", "b")
    borders = meet_borders(found.where("end IS NOT NULL").drop("kind").collect())
    if borders:
        pairs = pairs.unionByName(found.sparkSession.createDataFrame(borders, "a long, b long"))
    return pairs.distinct()


def meet_borders(rows: list) -> list[tuple[int, int]]:
    """Pairs of rows at the end of one partition and the begin of the next, where one region runs on."""
    parts: dict[int, tuple[list, list]] = {}
    for r in rows:
        parts.setdefault(r["pid"], ([], []))[r["end"]].append((r["region"], (r["a"], r["b"], r["c"], r["members"], int.from_bytes(r["sketch"]))))
    ordered, out = [parts[p] for p in sorted(parts)], []
    for (_, tail), (head, _) in zip(ordered, ordered[1:]):
        if tail and head and tail[0][0] == head[0][0]:
            near, first = Neighbours(), {row[0] for _, row in tail}
            pairs = [p for _, row in (*tail, *head) for p in near.add(row)] + list(near.end())
            out += [(a, b) for a, b in pairs if (a in first) != (b in first)]
    return out


def open_regions(labelled: DataFrame) -> DataFrame:
    """Materialized: the regions in which rows may have had more partners than they asked, from (region, id, n, c).

    largest: their largest component; rest_blocks and blocks: of the rows of all
    others, and of all, each block within CELL rows and about CELL_SHINGLES.
    """
    parts = labelled.groupBy("region", "c").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    top = F.struct("k", "c")
    found = parts.groupBy("region").agg(F.sum("k").alias("rows"), F.count("*").alias("parts"), F.max("k").alias("most"), F.sum("size").alias("size"), F.max_by("c", top).alias("largest"), F.max_by("size", top).alias("largest_size"))
    found = found.where((F.col("parts") > 1) & ((F.col("rows") > WINDOW + 1) | (F.col("parts") > NEAR + 1) | (F.col("most") > BEST)))

    def blocks(rows, size):
        return F.ceil(F.greatest(rows / CELL, size / CELL_SHINGLES))

    rest = blocks(F.col("rows") - F.col("most"), F.col("size") - F.col("largest_size"))
    return materialize(found.select("region", "largest", rest.alias("rest_blocks"), (rest + blocks(F.col("most"), F.col("largest_size"))).alias("blocks")), "open")


class Cell:
    """Rows of two blocks of a region: ids, sizes, components, sketches and whole sets."""

    def __init__(self, rows: pa.Table):
        self.ids, self.sizes, c = (rows[k].to_numpy() for k in ("id", "n", "c"))
        self.parts = np.unique(c, return_inverse=True)[1]
        self.sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH // 8)
        flat = np.frombuffer(b"".join(rows["hashes"].to_pylist()), np.uint64)
        self.codes = np.unique(flat, return_inverse=True)[1].astype(np.int32)
        self.ends = np.cumsum(self.sizes)
        self.marks = np.zeros(int(self.codes.max(initial=0)) + 1, np.int32)

    def set_of(self, k: int) -> np.ndarray:
        return self.codes[self.ends[k] - self.sizes[k] : self.ends[k]]

    def linked_to(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with x, by their whole sets."""
        own = self.set_of(x)
        self.marks[own] = 1
        begins = np.cumsum(self.sizes[others]) - self.sizes[others]
        both = np.add.reduceat(self.marks[np.concatenate([self.set_of(k) for k in others])], begins)
        self.marks[own] = 0
        return 100 * both >= PERCENT * (self.sizes[x] + self.sizes[others] - both)

    def links(self, left: np.ndarray, right: np.ndarray):
        """(x, y) of links that join all components of the cell that any link joins; each row asks by nearness, a component until it joins."""
        for at in range(0, len(left), STRIPE):
            x = left[at : at + STRIPE, None]
            fit = (self.parts[x] != self.parts[right]) & (100 * np.minimum(self.sizes[x], self.sizes[right]) >= PERCENT * np.maximum(self.sizes[x], self.sizes[right]))
            if not fit.any():
                continue
            flips = np.bitwise_count(self.sketches[x] ^ self.sketches[right]).sum(2, dtype=np.int32)
            fit &= flips <= MOST_FLIPS
            for k in np.flatnonzero(fit.any(1)):
                own = int(x[k, 0])
                asked = right[fit[k]][np.argsort(flips[k][fit[k]], kind="stable")]
                while len(asked := asked[self.parts[asked] != self.parts[own]]):
                    for y in asked[:ASKED][self.linked_to(own, asked[:ASKED])].tolist():
                        if self.parts[y] != self.parts[own]:
                            yield own, y
                            self.parts[self.parts == self.parts[y]] = self.parts[own]
                    asked = asked[ASKED:]


def crowded_links(labelled: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct links (a, b) of different components that share an open region, confirmed in place.

    Cells make no pairs but the links, and of these no more than join the cell's
    components, so what they return is bounded by the rows they read.
    """
    opened = join_lookup(labelled, open_regions(labelled), "region").where("blocks IS NOT NULL")
    sets = map_batches(texts.join(materialize(opened.select("id").distinct(), "open-ids"), "id", "left_semi"), ["id"], [F.col("text")], lambda c: [pa.array([shingles(t).tobytes() for t in c[0].to_pylist()], pa.binary())], {"hashes": "binary"})
    rows = opened.join(materialize(sets, "open-sets"), "id")
    in_largest = F.col("c") == F.col("largest")
    first = F.when(in_largest, F.col("rest_blocks")).otherwise(F.lit(0))
    count = F.when(in_largest, F.col("blocks") - F.col("rest_blocks")).otherwise(F.col("rest_blocks"))
    # rows of the largest component meet all others, but not each other
    with_blocks = F.when(in_largest, F.col("rest_blocks")).otherwise(F.col("blocks")) - 1
    rows = rows.withColumn("own", first + F.pmod(F.xxhash64("id"), count)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), with_blocks)))
    cells = rows.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "n", "c", "sketch", "hashes")

    def compare(rows: pa.Table) -> pa.Table:
        own, lo, hi = rows["own"].to_numpy(), rows["lo"][0].as_py(), rows["hi"][0].as_py()
        cell = Cell(rows)
        found = [(cell.ids[x], cell.ids[y]) for x, y in cell.links(np.flatnonzero(own == lo), np.flatnonzero(own == hi))]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.min(1), "b": pairs.max(1)})

    return cells.groupBy("region", "lo", "hi").applyInArrow(compare, "a long, b long").distinct()


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Materialized: the pairs (a, b) whose full sets are linked."""

    def run(columns):
        texts = zip(*(c.to_pylist() for c in columns))
        return [pa.array([linked(shingles(a), shingles(b)) for a, b in texts], pa.bool_())]

    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    # a hub is the smaller of its pairs: its text meets them last, so that no shuffle repeats it
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    checked = map_batches(both, ["a", "b"], [F.col("text_a"), F.col("text_b")], run, {"linked": "boolean"})
    return materialize(checked.where("linked").select("a", "b"), "links")


def alike(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures match in LEAST_MATCHES values."""

    def run(columns):
        a, b = (np.frombuffer(b"".join(c.to_pylist()), "<u4").reshape(-1, HASHES) for c in columns)
        return [pa.array((a == b).sum(1) >= LEAST_MATCHES)]

    left = classes.select(F.col("id").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("id").alias("b"), F.col("signature").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    return map_batches(both, ["a", "b"], [F.col("sa"), F.col("sb")], run, {"alike": "boolean"}).where("alike").select("a", "b")


def texts_of(rows: DataFrame, more: DataFrame | None) -> DataFrame:
    """(v, text) of rows (id, text); rows of an id with several sets are told apart by their sets."""
    if more is None:
        return rows.withColumnRenamed("id", "v")

    def run(columns):
        return [pa.array([set_id(shingles(t)) for t in columns[0].to_pylist()], pa.binary())]

    several = more.select("id").distinct()
    own = map_batches(rows.join(several, "id"), ["id", "text"], [F.col("text")], run, {"set_id": "binary"})
    own = own.where("set_id IS NOT NULL").join(more.select("id", "set_id", "v"), ["id", "set_id"], "left")
    return rows.join(several, "id", "left_anti").withColumnRenamed("id", "v").unionByName(own.select(F.coalesce("v", "id").alias("v"), "text"))


def find_duplicates(df: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept for each row."""
    sets = describe(df, key, text_col)
    used, more = vertices(sets.where("id IS NOT NULL AND set_id IS NOT NULL"))
    firsts = materialize(used.groupBy("set_id").agg(F.min("v").alias("class")), "classes")
    standing = used.join(firsts, [used["set_id"] == firsts["set_id"], used["v"] == firsts["class"]], "left_semi")
    classes = materialize(standing.select(F.col("v").alias("id"), "n_shingles", "signature").dropDuplicates(["id"]), "standing")
    place = ("region", "suffix", "id")
    crowded = crowd(orders(classes).repartitionByRange(*place).sortWithinPartitions(*place))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(text_col).alias("text"))
    members = materialize(crowded.select("id").distinct().withColumn("__hit", F.lit(True)), "members")
    rows = texts_of(rows, more).withColumnRenamed("v", "id")
    texts = materialize(join_lookup(rows, members, "id").where("__hit").drop("__hit").dropDuplicates(["id"]), "texts")

    links = confirm(materialize(hub_pairs(crowded), "hubs"), texts)
    if more is not None:
        links = links.unionByName(same_id_links(more, firsts))
    labels = components(links)
    sizes = materialize(labels.groupBy("c").agg(F.count("*").alias("members")), "sizes")
    near = materialize(join_lookup(labels, sizes, "c").select(F.col("v").alias("id"), "c", "members"), "near")

    regions = crowded.where("kind IN (0, 2)").select(*place, "n")
    labelled = materialize(join_lookup(regions, near, "id"), "labelled")
    labelled = labelled.withColumns({"c": F.coalesce("c", "id"), "members": F.coalesce("members", F.lit(1))})
    apart = neighbour_pairs(labelled.repartitionByRange(*place).sortWithinPartitions(*place))
    labels = extend(labels, confirm(materialize(alike(apart, classes), "alike"), texts))

    regions = regions.select("region", "id", "n", F.substring("suffix", 2 * SUFFIX + 1, SKETCH).alias("sketch"))
    labelled = materialize(join_lookup(regions, labels.withColumnRenamed("v", "id"), "id").withColumn("c", F.coalesce("c", "id")), "labelled")
    labels = extend(labels, materialize(crowded_links(labelled, texts), "crowded-links"))

    placed = vertices_of_bare(join_lookup(sets.drop("signature"), firsts, "set_id"), used, firsts)
    out = join_lookup(placed.select("id", "n_shingles", "v"), labels, "v")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("c", "v"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))


def filter_documents(df: DataFrame, *, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with the input's own columns; of rows with equal keys the one of the shortest text stays, rows with null keys all do."""
    found = materialize(find_duplicates(df, key=key, text_col=text_col), "found")
    ids = materialize(found.where("kept").where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows")), "kept")
    out = join_lookup(df.withColumn("__key", F.col(key).cast("long")), ids, "__key").where("__rows IS NOT NULL")
    if not ids.where("__rows > 1").isEmpty():
        text = F.coalesce(F.col(text_col), F.lit(""))
        first = Window.partitionBy("__key").orderBy(F.length(text), F.xxhash64(text))
        out = out.withColumn("__at", F.row_number().over(first)).where("__at = 1").drop("__at")
    return out.drop("__key", "__rows").unionByName(df.where(F.col(key).isNull()))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_duplicates(docs)
