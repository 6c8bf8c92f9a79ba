"""Media columns: cropped and edited copies of images by local descriptors.

Images are decoded from their bytes (PGM, PPM, 8-bit PNG). At several scales
the strongest corners get an orientation (the direction of the patch's centre of
brightness) and BITS binary brightness tests turned by it. Hamming tables bring
images together: their keys are words of two near features, which hold the
coarse place of one as seen from the other and bits of both descriptors. A table
is as wide as its rows need: the shortest prefix of a word that few rows share
brings all of these together. Images that share several words are held against
each other, all features with all: a consensus must map enough places of one on
the other by one rotation, scale and shift, and a good part of what should be
seen. Linked images form components. Then all pairs of images of different
components that share several whole words are held against each other in cells
of two blocks of images, which hold their features and words and return only
links: no crowd of rows hides a pair that shares whole words.

Equal bytes are collapsed first. Rows that share a whole word with many others,
as all copies of an image do, meet the row before and the run's first, so a part
that a third of all images share costs its rows, not their pairs. All rows of a
prefix are in one partition, and one image has hundreds of words, so no word is
more than a small part of the rows.

Defined results: null, empty or undecodable bytes have no features and are
linked with nothing; an image without corners likewise; rows with null ids are
returned with a null component; repeated rows are one image with as many rows;
rows of one id belong together whatever their bytes; an
empty table gives an empty result; only id and bytes are read.
"""

from __future__ import annotations

import functools
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import join_lookup, map_batches, materialize
from tessera.llm.components import components, extend, same_id_links, vertices, vertices_of_bare

#: Scales, each smaller than the one before by STEP; corners kept at each (part of the descriptor).
SCALES, STEP, CORNERS = 4, 2 ** (1 / 3), 16
#: Binary tests; largest distance of a match.
BITS, DISTANCE = 128, 20
#: Radius of the patch; steps of its orientation.
RADIUS, TURNS = 11, 32
#: Hamming tables; near features that a feature makes words with; least distance of these in pixels of their scale.
TABLES, MATES, LEAST_APART = 2, 3, 5.0
#: Bits of either descriptor that a word takes, by level; bits of a word below each level's prefix.
WIDTHS, LEVELS = (9, 8, 8), (32, 16, 0)
#: Rows that meet all others of their prefix; shared words that make a candidate; rows of a prefix that a task holds at once.
MOST, MEETINGS, RUN = 6, 4, 1 << 20
#: Cells of a vote in pixels and degrees; cells tried of each grid; votes a cell needs to be tried.
CELL, DEGREES, TRIED, LEAST_VOTES = 24.0, 30.0, 3, 4
#: Pixels a match may be off; score of the places that link two images; their share of what should be seen; largest scale.
OFF, SCORE, SHARE, MOST_ZOOM = 5.0, 6.0, 0.35, 2.5
#: Images of a task; of a block, two of which make a cell; cells at least; tasks of cells at most; pairs looked at at once; images of a component that others of it pass by; shared words and counters held at once; what is so close to a border that rounding may decide.
TASK_IMAGES, BLOCK, SPREAD, MOST_TASKS, PAIRS, CROWD, AT_ONCE, EDGE = 1000, 4096, 24, 2000, 64, 64, 1 << 20, 1e-6


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey values, or None for bytes that are no image of the kinds read."""
    try:
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error, TypeError):
        pass
    return None


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    planes = 3 if data[:2] == b"P6" else 1
    if not 0 < top < 256:
        raise ValueError
    pixels = np.frombuffer(data, np.uint8, width * height * planes, at + 1).reshape(height, width, planes)
    return _grey(pixels) * (255.0 / top)


def _png(data: bytes) -> np.ndarray:
    at, body, palette, colour = 8, b"", None, None
    while at < len(data):
        (size,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    planes = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * planes)
    out = np.zeros((height + 1, (width + 1) * planes), np.uint8)
    for y in range(height):
        kind, line, up, own = rows[y, 0], rows[y, 1:], out[y], out[y + 1]
        if kind == 0:
            own[planes:] = line
        elif kind == 2:
            own[planes:] = line + up[planes:]
        else:
            for x in range(planes, len(own)):
                a, b, c = int(own[x - planes]), int(up[x]), int(up[x - planes])
                if kind == 1:
                    guess = a
                elif kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                own[x] = (int(line[x - planes]) + guess) & 255
    pixels = out[1:, planes:].reshape(height, width, planes)
    if colour == 3:
        return _grey(palette[pixels[:, :, 0]])
    return _grey(pixels[:, :, : planes - (planes in (2, 4))])


def _grey(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype(np.float32).mean(2)


def pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5 %d %d 255\n" % (w, h) + np.clip(image, 0, 255).astype(np.uint8).tobytes()


def box(image: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2r + 1 pixels of an image, or of each of several, edges repeated."""
    n = 2 * r + 1
    for axis in (-2, -1):
        at = np.clip(np.arange(-r - 1, image.shape[axis] + r), 0, image.shape[axis] - 1)
        total = np.cumsum(image.take(at, axis), axis, dtype=np.float64)
        image = (total[..., n:, :] - total[..., :-n, :] if axis == -2 else total[..., n:] - total[..., :-n]) / n
    return image


def shrink(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear resampling after a small blur."""
    h, w = (max(1, int(round(n / factor))) for n in image.shape)
    soft = box(image, 1) if factor > 1 else image
    y, x = (np.clip((np.arange(n) + 0.5) * factor - 0.5, 0, m - 1) for n, m in ((h, image.shape[0]), (w, image.shape[1])))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None], x - x0
    top = soft[y0][:, x0] * (1 - fx) + soft[y0][:, x1] * fx
    low = soft[y1][:, x0] * (1 - fx) + soft[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def corners(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y, x of the strongest corners (smaller eigenvalue of the gradient's structure) away from the border."""
    gy, gx = np.gradient(box(image, 1))
    a, b, c = box(np.stack([gx * gx, gx * gy, gy * gy]), 2)
    strength = (a + c) / 2 - np.sqrt(((a - c) / 2) ** 2 + b * b)
    m = RADIUS + 5
    inner = strength[m:-m, m:-m]
    if not inner.size:
        return np.empty(0, int), np.empty(0, int)
    around = np.pad(inner, 2, constant_values=-1)
    for _ in range(2):  # the largest of five rows, then of five columns
        around = functools.reduce(np.maximum, [around[k : len(around) - 4 + k] for k in range(5)]).T
    y, x = np.nonzero((inner == around) & (inner > 1.0))
    best = np.lexsort((x, y, -inner[y, x]))[:CORNERS]
    return y[best] + m, x[best] + m


@functools.lru_cache(1)
def tests() -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the binary tests for each turn, and the disc that orientation is measured on."""
    rng = np.random.default_rng(11)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (BITS, 2, 2)), -RADIUS + 1, RADIUS - 1)
    angle = np.arange(TURNS) * 2 * math.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    offsets = np.rint(np.einsum("tij,bpj->tbpi", turn, points)).astype(int)
    d = np.arange(-RADIUS, RADIUS + 1)
    dy, dx = np.meshgrid(d, d, indexing="ij")
    disc = np.stack([dy.ravel(), dx.ravel()], -1)[(dy * dy + dx * dx <= RADIUS * RADIUS).ravel()]
    return offsets, disc


def features(image: np.ndarray) -> list[tuple]:
    """(x, y in the whole image, scale, degrees, descriptor bytes) of each corner."""
    out, (offsets, disc) = [], tests()
    for scale in range(SCALES):
        factor = STEP**scale
        small = shrink(image, factor) if scale else image
        if min(small.shape) <= 2 * (RADIUS + 5):
            break
        y, x = corners(small)
        if not len(y):
            continue
        soft = box(small, 2)
        patch = soft[y[:, None] + disc[:, 0], x[:, None] + disc[:, 1]]
        patch = patch - patch.mean(1, keepdims=True)
        angle = np.arctan2(patch @ disc[:, 0], patch @ disc[:, 1])
        at = offsets[np.rint(angle / (2 * math.pi) * TURNS).astype(int) % TURNS]
        values = soft[y[:, None, None] + at[..., 1], x[:, None, None] + at[..., 0]]
        bits = np.packbits(values[..., 0] < values[..., 1], axis=1)
        out += [(float(b * factor), float(a * factor), scale, math.degrees(t), d.tobytes()) for a, b, t, d in zip(y, x, angle, bits)]
    return out


#: A feature in a packed row: place in the whole image, scale, degrees, descriptor.
FEATURE = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<i4"), ("degrees", "<f4"), ("bits", "<u8", (BITS // 64,))])


def pack(image: np.ndarray | None) -> bytes | None:
    """Height, width and the features of an image; null without features."""
    found = features(image) if image is not None else []
    if not found:
        return None
    rows = np.array([(x, y, scale, degrees, np.frombuffer(bits, "<u8")) for x, y, scale, degrees, bits in found], FEATURE)
    return struct.pack("<ii", *image.shape) + rows.tobytes()


def unpack(data: bytes) -> tuple[tuple[int, int], np.ndarray]:
    return struct.unpack_from("<ii", data), np.frombuffer(data, FEATURE, offset=8)


@functools.lru_cache(1)
def chunks() -> np.ndarray:
    """For each table the bits that its words take of a descriptor, in order: each table has bits of its own."""
    order = np.random.default_rng(3).permutation(BITS)
    return np.stack([np.roll(order, -t * BITS // TABLES)[: sum(WIDTHS)] for t in range(TABLES)])


def words(rows: np.ndarray) -> np.ndarray:
    """Distinct 64-bit words of an image's features, one for each table, feature and near feature of its scale.

    A word begins with what turning and scaling leave alone: the table, the
    distance and the direction of the near feature and its own orientation, in
    coarse steps that each table shifts. Then come bits of both descriptors.
    """
    out = [np.empty(0, np.uint64)]
    bits = np.unpackbits(rows["bits"].view(np.uint8).reshape(len(rows), -1), axis=1)
    codes = [[(bits[:, part] @ (1 << np.arange(len(part))[::-1])).astype(np.uint64) for part in np.split(taken, np.cumsum(WIDTHS)[:-1])] for taken in chunks()]
    for scale in range(SCALES):
        own = np.flatnonzero(rows["scale"] == scale)
        if len(own) < 2:
            continue
        place = np.stack([rows["x"][own], rows["y"][own]], 1) / STEP**scale
        degrees = rows["degrees"][own]
        apart = place[None] - place[:, None]  # from, to
        distance = np.hypot(apart[..., 0], apart[..., 1])
        distance[distance < LEAST_APART] = np.inf
        near = np.argsort(distance, axis=1, kind="stable")[:, :MATES]
        one, two = np.repeat(np.arange(len(own)), near.shape[1]), near.ravel()
        fits = np.isfinite(distance[one, two])
        one, two = one[fits], two[fits]
        far, to = np.log2(distance[one, two]) * 2, np.degrees(np.arctan2(apart[one, two, 1], apart[one, two, 0])) - degrees[one]
        turn = degrees[two] - degrees[one]
        for t, parts in enumerate(codes):
            shift = t / TABLES
            word = np.full(len(one), t, np.uint64)
            for value, size in ((np.clip(np.floor(far + shift), 0, 15), 4), (np.floor(to / 30 + shift) % 12, 4), (np.floor(turn / 30 + shift) % 12, 4)):
                word = (word << np.uint64(size)) | value.astype(np.uint64)
            for width, code in zip(WIDTHS, parts):
                for side in (one, two):
                    word = (word << np.uint64(width)) | code[own[side]]
            out.append(word)
    return np.unique(np.concatenate(out))


def meet(keys: np.ndarray, ids: np.ndarray, first: tuple[int, int] | None = None) -> np.ndarray:
    """Pairs of ids that a word brings together, from rows in order of (word, id).

    The shortest prefix, of LEVELS, that at most MOST rows share brings all of
    these together; so tables are as wide as their rows need. Rows that share a
    whole word with more, copies most of them, meet the row before and the run's
    first, which joins copies; ``rest`` takes their other pairs. first: the first row of the run that goes on here.
    """
    found, open_rows = [np.empty((0, 2), np.int64)], np.arange(len(keys))
    for shift in LEVELS:
        own = keys[open_rows] >> np.uint64(shift)
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        sizes = np.diff(np.append(cuts, len(own)))
        run = np.repeat(np.arange(len(cuts)), sizes)
        small = sizes[run] <= MOST
        for step in range(1, MOST):
            both = small[:-step] & (run[:-step] == run[step:])
            found.append(np.stack([ids[open_rows[:-step][both]], ids[open_rows[step:][both]]], 1))
        open_rows = open_rows[~small]
        if not len(open_rows):
            break
    else:
        own = keys[open_rows]
        same = np.flatnonzero(own[1:] == own[:-1])
        found.append(np.stack([ids[open_rows[same]], ids[open_rows[same + 1]]], 1))
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        heads = ids[open_rows[cuts]].copy()
        if first is not None and own[0] == first[0]:
            heads[0] = first[1]
        found.append(np.stack([np.repeat(heads, np.diff(np.append(cuts, len(own)))), ids[open_rows]], 1))
    pairs = np.concatenate(found)
    return np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1)


def consensus(one: bytes, two: bytes) -> float:
    """How well one similarity maps places of either image on places of the other with alike descriptors; 0 if too few or too small a part of what should be seen.

    All features meet all. Matches vote for a turn, a scale and a shift; the best
    cells' matches are fitted, and fitted again with all matches that agree. A
    place counts 1 if descriptors are equal, and less the more they differ.
    """
    (_, a), (size, b) = unpack(one), unpack(two)
    apart = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None]).sum(2)
    i, j = np.nonzero(apart <= DISTANCE)
    worth = 1 - apart[i, j] / (DISTANCE + 1)
    if worth.sum() < SCORE:
        return 0.0
    p, q = (x["x"][k].astype(float) + 1j * x["y"][k] for x, k in ((a, i), (b, j)))
    turn, zoom = b["degrees"][j].astype(float) - a["degrees"][i], b["scale"][j] - a["scale"][i]
    step = np.round(turn / DEGREES) % (360 / DEGREES)
    shift = q - STEP**zoom * np.exp(1j * np.radians(step * DEGREES)) * p
    best = 0.0
    for grid in (0.0, 0.5):  # two grids, half a cell apart, so that no agreement is lost on a border
        cells = np.stack([step, zoom, np.floor(shift.real / CELL + grid), np.floor(shift.imag / CELL + grid)], 1).astype(np.int64)
        code = ((cells[:, 0] * 64 + cells[:, 1] + 32) << 32) + ((cells[:, 2] + 32768) << 16) + cells[:, 3] + 32768
        _, cell, votes = np.unique(code, return_inverse=True, return_counts=True)
        for k in np.argsort(-votes, kind="stable")[:TRIED]:
            if votes[k] < LEAST_VOTES:
                break
            fits = cell == k
            for _ in range(3):
                u, v = p[fits] - p[fits].mean(), q[fits] - q[fits].mean()
                spread = (np.abs(u) ** 2).sum()
                scale = (v * np.conj(u)).sum() / spread if spread > 1 else 0
                if not 1 / MOST_ZOOM < abs(scale) < MOST_ZOOM:
                    fits = fits & False
                    break
                move = q[fits].mean() - scale * p[fits].mean()
                off = np.abs((turn - math.degrees(np.angle(scale)) + 180) % 360 - 180)
                fits = (np.abs(scale * p + move - q) < OFF) & (off < DEGREES)
                if worth[fits].sum() < SCORE:
                    break
            if worth[fits].sum() < SCORE:
                continue
            score = min(_places(p[fits], worth[fits]), _places(q[fits], worth[fits]))
            corners_of_a = a["x"] + 1j * a["y"]
            seen, m = scale * corners_of_a + move, RADIUS + 5
            inside = (seen.real >= m) & (seen.real < size[1] - m) & (seen.imag >= m) & (seen.imag < size[0] - m)
            if score >= SCORE and score >= SHARE * _places(corners_of_a[inside], np.ones(int(inside.sum()))):
                best = max(best, score)
    return best


def _places(points: np.ndarray, worth: np.ndarray) -> float:
    """Sum over places, squares of OFF pixels, of the best point's worth in each."""
    place = np.unique(np.floor(points.real / OFF) * 1e6 + np.floor(points.imag / OFF), return_inverse=True)[1]
    most = np.zeros(len(points))
    np.maximum.at(most, place, worth)
    return float(most.sum())


def grid(packed: list[bytes]) -> dict[str, np.ndarray]:
    """The features of images in rectangular arrays, with a mask of those that are there."""
    rows = [unpack(x)[1] for x in packed]
    out = np.zeros((len(rows), max(map(len, rows))), FEATURE)
    there = np.zeros(out.shape, bool)
    for k, r in enumerate(rows):
        out[k, : len(r)], there[k, : len(r)] = r, True
    sizes = np.array([unpack(x)[0] for x in packed])
    return {name: np.ascontiguousarray(out[name]) for name in FEATURE.names} | {"there": there, "height": sizes[:, 0], "width": sizes[:, 1]}


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of spans that begin there and are so long, one after the other."""
    return np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())


@functools.lru_cache(1)
def _moves() -> np.ndarray:
    """Turn and scale of a vote, by its step and zoom, as a complex factor."""
    step, zoom = np.arange(round(360 / DEGREES)), np.arange(1 - SCALES, SCALES, dtype=float)
    return STEP**zoom * np.exp(1j * np.radians(step * DEGREES))[:, None]


def _places_of(run: np.ndarray, points: np.ndarray, worth: np.ndarray, n: int) -> np.ndarray:
    """``_places`` of each of n runs."""
    if not len(run):
        return np.zeros(n)
    place = (run << 40) + (np.floor(points.real / OFF) * 1e6 + np.floor(points.imag / OFF)).astype(np.int64)
    order = np.argsort(place)
    place = place[order]
    cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return np.bincount(run[order[cuts]], np.maximum.reduceat(worth[order], cuts), n)


def may_agree(a: dict, b: dict, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs (one of a, two of b) ``consensus`` finds above 0: its steps for many pairs at once; it decides itself where rounding could."""
    may, unsure = _agreeing(a, b, one, two)
    for k in np.flatnonzero(unsure):
        may[k] = consensus(_packed(a, one[k]), _packed(b, two[k])) > 0
    return may


def _packed(a: dict, k: int) -> bytes:
    rows = np.zeros(int(a["there"][k].sum()), FEATURE)
    for name in FEATURE.names:
        rows[name] = a[name][k][a["there"][k]]
    return struct.pack("<ii", a["height"][k], a["width"][k]) + rows.tobytes()


def _agreeing(a: dict, b: dict, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs agree, and which came within EDGE of a border, as places on the same pixels often do.

    The matches of a pair are in order of their turn, so a cell's fit looks only
    at those whose turn it allows.
    """
    may, unsure = np.zeros(len(one), bool), np.zeros(len(one), bool)
    apart = sum(np.bitwise_count(a["bits"][one][:, :, None, k] ^ b["bits"][two][:, None, :, k]) for k in range(BITS // 64))
    at = np.flatnonzero((apart <= DISTANCE) & a["there"][one][:, :, None] & b["there"][two][:, None, :])
    pair, i, j = np.unravel_index(at, apart.shape)
    worth = (1 - np.arange(DISTANCE + 1) / (DISTANCE + 1))[apart.ravel()[at]]
    enough = np.bincount(pair, worth, len(one))[pair] >= SCORE - 1e-3
    pair, i, j, worth = pair[enough], i[enough], j[enough], worth[enough]
    if not len(pair):
        return may, unsure
    turn = b["degrees"][two[pair], j].astype(float) - a["degrees"][one[pair], i]
    turn = np.where(turn >= 180, turn - 360, np.where(turn < -180, turn + 360, turn))
    by_turn = pair * 1024.0 + turn
    order = np.argsort(by_turn)
    by_turn, pair, turn, worth = by_turn[order], pair[order], turn[order], worth[order]
    i, j = (one[pair], i[order]), (two[pair], j[order])
    px, py, qx, qy = (z.astype(float) for z in (a["x"][i], a["y"][i], b["x"][j], b["y"][j]))
    step, zoom = np.round(turn / DEGREES).astype(np.int64) % round(360 / DEGREES), (b["scale"][j] - a["scale"][i]).astype(np.int64)
    shift = (qx + 1j * qy) - _moves()[step, zoom + SCALES - 1] * (px + 1j * py)
    sx, sy = shift.real, shift.imag
    base = (pair << 48) + ((step * 64 + zoom + 32) << 32) + (32768 << 16) + 32768
    found = []
    for half in (0.0, 0.5):
        code = base + (np.floor(sx / CELL + half).astype(np.int64) << 16) + np.floor(sy / CELL + half).astype(np.int64)
        order = np.argsort(code)
        code = code[order]
        cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        votes = np.diff(np.append(cuts, len(code)))
        cuts, votes = cuts[votes >= LEAST_VOTES], votes[votes >= LEAST_VOTES]
        of = pair[order[cuts]]
        best = np.lexsort((np.arange(len(votes)), -votes, of))
        tried = best[np.arange(len(best)) - np.searchsorted(of[best], of[best]) < TRIED]
        found.append((of[tried], votes[tried], order[_spans(cuts[tried], votes[tried])]))
    # of: the pair of each cell; run, at: the matches that fit a cell
    of, votes, at = (np.concatenate(c) for c in zip(*found))
    run = np.repeat(np.arange(len(of)), votes)
    for _ in range(3):
        n = len(of)
        if not n:
            return may, unsure
        count = np.bincount(run, minlength=n)
        mean = [np.bincount(run, z[at], n) / count for z in (px, py, qx, qy)]
        ux, uy, vx, vy = (z[at] - m[run] for z, m in zip((px, py, qx, qy), mean))
        spread = np.bincount(run, ux * ux + uy * uy, n)
        cx, cy = (np.bincount(run, z, n) / np.maximum(spread, 0.5) for z in (vx * ux + vy * uy, vy * ux - vx * uy))
        size = np.hypot(cx, cy)
        unsure[of[(np.abs(spread - 1) < EDGE) | (np.abs(size - 1 / MOST_ZOOM) < EDGE) | (np.abs(size - MOST_ZOOM) < EDGE)]] = True
        fine = (spread > 1) & (size > 1 / MOST_ZOOM) & (size < MOST_ZOOM)
        of, cx, cy, mean_px, mean_py, mean_qx, mean_qy = (z[fine] for z in (of, cx, cy, *mean))
        mx, my = mean_qx - (cx * mean_px - cy * mean_py), mean_qy - (cx * mean_py + cy * mean_px)
        angle = np.degrees(np.arctan2(cy, cx))
        # turns off by less than DEGREES, and those a whole turn away
        middle = of * 1024.0 + np.stack([angle, angle + np.where(angle < 0, 360, -360)])
        begin, end = (np.searchsorted(by_turn, middle + d).ravel() for d in (-DEGREES - EDGE, DEGREES + EDGE))
        run, at = np.repeat(np.tile(np.arange(len(of)), 2), end - begin), _spans(begin, end - begin)
        spare = DEGREES - np.abs(by_turn[at] - np.repeat(middle.ravel(), end - begin))
        x, y = px[at], py[at]
        off_x, off_y = cx[run] * x - cy[run] * y + mx[run] - qx[at], cx[run] * y + cy[run] * x + my[run] - qy[at]
        spare = np.minimum(spare, OFF * OFF - (off_x * off_x + off_y * off_y))
        unsure[of[run[np.abs(spare) < EDGE]]] = True
        run, at = run[spare > 0], at[spare > 0]
        total = np.bincount(run, worth[at], len(of))
        unsure[of[np.abs(total - SCORE) < EDGE]] = True
        fine = total >= SCORE
        stay = fine[run]
        # cells that are left, by new numbers
        run, at = (np.cumsum(fine) - 1)[run[stay]], at[stay]
        of, cx, cy, mx, my = (z[fine] for z in (of, cx, cy, mx, my))
    if not len(of):
        return may, unsure
    score = np.minimum(*(_places_of(run, z, worth[at], len(of)) for z in (px[at] + 1j * py[at], qx[at] + 1j * qy[at])))
    left = np.flatnonzero(score >= SCORE - EDGE)
    of_left = of[left]
    corner, m = a["x"][one[of_left]] + 1j * a["y"][one[of_left]], RADIUS + 5
    seen = (cx + 1j * cy)[left, None] * corner + (mx + 1j * my)[left, None]
    height, width = b["height"][two[of_left], None], b["width"][two[of_left], None]
    spare = functools.reduce(np.minimum, [seen.real - m, width - m - seen.real, seen.imag - m, height - m - seen.imag])
    inside = a["there"][one[of_left]] & (spare > 0)
    unsure[of_left[(a["there"][one[of_left]] & (np.abs(spare) < EDGE)).any(1)]] = True
    r, k = np.nonzero(inside)
    over = np.minimum(score[left] - SCORE, score[left] - SHARE * _places_of(r, corner[r, k], np.ones(len(r)), len(left)))
    unsure[of_left[np.abs(over) < EDGE]] = True
    may[of_left[over > 0]] = True
    return may, unsure


def _meetings(one: list[np.ndarray], images: np.ndarray, keys: np.ndarray, place: np.ndarray, n: int):
    """(k, places below n) for each of these images of one: the places whose rows (keys, in order) share MEETINGS words or more with it."""
    step = max(1, AT_ONCE // n)
    for at in range(0, len(images), step):
        part = images[at : at + step]
        ask, who = np.concatenate([one[k] for k in part]), np.repeat(np.arange(len(part)), [len(one[k]) for k in part])
        order = np.argsort(ask)  # asked in order, so that the search stays where it was
        ask, who = ask[order], who[order]
        begin = np.searchsorted(keys, ask, "left")
        met = begin < len(keys)
        met[met] = keys[begin[met]] == ask[met]
        begin, who = begin[met], who[met]
        rows = np.searchsorted(keys, ask[met], "right") - begin
        order = np.argsort(who, kind="stable")
        begin, who, rows = begin[order], who[order], rows[order]
        # as many images at once as meet AT_ONCE rows, one at least
        met = np.cumsum(np.bincount(who, rows, len(part)).astype(np.int64))
        cuts = np.flatnonzero(np.diff(met // AT_ONCE, prepend=-1))
        for first, last in zip(cuts, np.append(cuts[1:], len(part))):
            own = slice(*np.searchsorted(who, (first, last)))
            code = np.repeat((who[own] - first) * n, rows[own]) + place[_spans(begin[own], rows[own])]
            image, found = np.divmod(np.flatnonzero(np.bincount(code, minlength=1) >= MEETINGS), n)
            for k, places in zip(*_runs(image, found)):
                yield int(part[first + k]), places


def _runs(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each of the sorted keys with its values."""
    cuts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[cuts], np.split(values, cuts[1:])


def shared(one: list[np.ndarray], two: list[np.ndarray], of_one: np.ndarray, of_two: np.ndarray):
    """(k, places in two) for each image k of one: the images of other components that share MEETINGS words or more with it, however many rows a word has.

    The words are sorted and distinct.
    """
    keys, place = np.concatenate(two), np.repeat(np.arange(len(two)), [len(w) for w in two])
    order = np.argsort(keys)
    keys, place = keys[order], place[order]
    del order
    # an image doesn't walk through a crowd of its own component
    many = np.unique(of_two, return_counts=True)
    many = many[0][many[1] > CROWD]
    for c in [None, *np.intersect1d(many, of_one)]:
        images = np.flatnonzero(~np.isin(of_one, many) if c is None else of_one == c)
        keep = slice(None) if c is None else of_two[place] != c
        if len(images):
            for k, found in _meetings(one, images, keys[keep], place[keep], len(two)):
                found = found[of_two[found] != of_one[k]]
                if len(found):
                    yield k, found


def _blocks(df: DataFrame) -> dict[int, list[str]]:
    """The files of a written table by the number of the partition that wrote them."""
    out: dict[int, list[str]] = {}
    for name in sorted(df.inputFiles()):
        out.setdefault(int(name.rpartition("/")[2].split("-")[1]), []).append(name)
    return out


def _read(names: list[str]) -> pa.Table:
    from pyarrow import fs, parquet

    parts = []
    for name in names:
        store, path = fs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1))
        parts.append(parquet.read_table(path, filesystem=store, partitioning=None))
    return pa.concat_tables(parts)


def rest(feats: DataFrame, labels: DataFrame, blocks: int) -> DataFrame:
    """Links (a, b) between different components (v, c) of images that share MEETINGS whole words or more: all such pairs, whatever was crowded.

    feats: a written table (id, feats, words) in that many hash partitions of
    its ids. A cell holds two of them, read from the shared folder, and returns
    only links.
    """
    spark = feats.sparkSession
    tags = feats.select("id").join(labels, feats["id"] == labels["v"], "left").select("id", F.coalesce("c", "id").alias("c"))
    tags = materialize(tags.repartition(blocks, "id"), "media-tags")
    files, of = _blocks(feats), _blocks(tags)
    own = sorted(files)
    slices = max(1, -(-SPREAD // max(1, len(own) * (len(own) + 1) // 2)))
    cells = [(x, y, k) for n, x in enumerate(own) for y in own[n:] for k in range(slices)]
    if not cells:
        return spark.createDataFrame([], "a long, b long")

    def load(k):
        table, tag = _read(files[k]).sort_by("id"), _read(of.get(k, [])).sort_by("id")
        assert table["id"].equals(tag["id"]), "blocks and their components differ"
        return table["id"].to_numpy(), tag["c"].to_numpy(), table["feats"].to_pylist(), [np.frombuffer(w, "<u8") for w in table["words"].to_pylist()]

    def run(batches):
        for batch in batches:
            for x, y, part in zip(*(c.to_pylist() for c in batch.columns[:3])):
                two = load(y)
                one = two if x == y else load(x)
                if not len(one[0]) or not len(two[0]):
                    continue
                a, b = grid(one[2]), grid(two[2])
                mine = np.arange(part, len(one[0]), slices)
                links, held = [], []

                def hold():
                    i, j = (np.concatenate(c) for c in zip(*held))
                    held.clear()
                    up = one[0][i] < two[0][j]  # in the order of ids, as other candidates are
                    for left, right, f, g, p, q in ((one, two, a, b, i[up], j[up]), (two, one, b, a, j[~up], i[~up])):
                        for at in range(0, len(p), PAIRS):
                            may = may_agree(f, g, p[at : at + PAIRS], q[at : at + PAIRS])
                            for k, m in zip(p[at : at + PAIRS][may], q[at : at + PAIRS][may]):
                                if consensus(left[2][k], right[2][m]) > 0:
                                    links.append((int(left[0][k]), int(right[0][m])))

                waiting = 0
                for k, found in shared([one[3][k] for k in mine], two[3], one[1][mine], two[1]):
                    k = int(mine[k])
                    found = found[found > k] if x == y else found
                    held.append((np.full(len(found), k), found))
                    waiting += len(found)
                    if waiting >= 64 * PAIRS:
                        hold()
                        waiting = 0
                if held:
                    hold()
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return spark.createDataFrame(cells, "x int, y int, part int").repartition(min(len(cells), MOST_TASKS)).mapInArrow(run, "a long, b long")


def candidates(feats: DataFrame) -> DataFrame:
    """Pairs (a, b) of images that share MEETINGS words or more; all rows of a word's first 32 bits are in one partition, so no border cuts a run."""
    names = {"key": pa.int64(), "id": pa.int64()}

    def spell(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.frombuffer(x, "<u8") if given else words(unpack(x)[1]) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(w) for w in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], names=list(names))

    def walk(batches):
        keys, ids, held, first = np.empty(0, np.uint64), np.empty(0, np.int64), 0, None

        def table(pairs):
            code, n = np.unique(pairs, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code[:, 0]), pa.array(code[:, 1]), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            # rows of a prefix that goes on wait for its end, or for RUN rows
            keys = np.append(keys, batch.column(0).to_numpy().view(np.uint64))
            ids = np.append(ids, batch.column(1).to_numpy())
            ends = np.flatnonzero(keys[1:] >> np.uint64(32) != keys[:-1] >> np.uint64(32))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if len(keys) - cut > RUN:
                yield table(meet(keys, ids, first))
                begin = int(np.searchsorted(keys, keys[-1]))
                first = first if first is not None and first[0] == keys[-1] else (int(keys[begin]), int(ids[begin]))
                keys, ids = keys[-MOST:], ids[-MOST:]
            elif cut:
                yield table(meet(keys[:cut], ids[:cut], first))
                keys, ids, first = keys[cut:], ids[cut:], None
        if len(keys):
            yield table(meet(keys, ids, first))

    given = "words" in feats.columns
    spelt = feats.select("id", "words" if given else "feats").mapInArrow(spell, "key long, id long")
    dealt = spelt.repartition(F.shiftrightunsigned("key", 32)).sortWithinPartitions(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "id")
    met = dealt.mapInArrow(walk, "a long, b long, n long")
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= MEETINGS).select("a", "b")


def agree(pairs: DataFrame, feats: DataFrame) -> DataFrame:
    """Links (a, b, score) of the pairs whose features agree on one mapping."""

    def run(columns):
        one, two = (c.to_pylist() for c in columns)
        score = np.zeros(len(one))
        for at in range(0, len(one), PAIRS):
            both = np.arange(len(one[at : at + PAIRS]))
            for k in np.flatnonzero(may_agree(grid(one[at : at + PAIRS]), grid(two[at : at + PAIRS]), both, both)):
                score[at + k] = consensus(one[at + k], two[at + k])
        return [pa.array(score)]

    sides = [feats.select(F.col("id").alias(c), F.col("feats").alias(f"feats_{c}")) for c in "ab"]
    both = pairs.join(sides[1], "b").join(sides[0], "a")
    return map_batches(both, ["a", "b"], [F.col("feats_a"), F.col("feats_b")], run, {"score": "double"}).where("score > 0")


def find_copies(df: DataFrame, *, key: str = "media_id", data_col: str = "data") -> DataFrame:
    """key, class_id (smallest id with the same bytes; beyond all ids for further bytes of an id) and component_id (smallest id that links reach)."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(data_col).alias("data"))
    rows = rows.withColumn("set_id", F.when(F.length("data") > 0, F.sha2("data", 256)))
    keys = materialize(rows.select("id", "set_id"), "media")
    used, more = vertices(keys.where("id IS NOT NULL AND set_id IS NOT NULL"))
    firsts = materialize(used.groupBy("set_id").agg(F.min("v").alias("class"), F.min_by("id", "v").alias("id")), "media-classes")
    standing = rows.join(firsts, ["id", "set_id"]).select(F.col("class").alias("id"), "data").repartition(max(1, -(-firsts.count() // TASK_IMAGES)))
    packed = map_batches(standing, ["id"], [F.col("data")], lambda c: [pa.array([pack(decode(x)) for x in c[0].to_pylist()], pa.binary())], {"feats": "binary"})
    blocks = max(1, -(-firsts.count() // BLOCK))
    packed = packed.where("feats IS NOT NULL").repartition(blocks, "id").dropDuplicates(["id"])
    spelt = map_batches(packed, ["id", "feats"], [F.col("feats")], lambda c: [pa.array([words(unpack(x)[1]).tobytes() for x in c[0].to_pylist()], pa.binary())], {"words": "binary"})
    feats = materialize(spelt, "features")
    links = materialize(agree(materialize(candidates(feats), "media-met"), feats), "media-links")
    links = links.select("a", "b")
    labels = components(links if more is None else links.unionByName(same_id_links(more, firsts)))
    labels = extend(labels, materialize(rest(feats, labels, blocks), "media-rest"))
    out = vertices_of_bare(join_lookup(keys, firsts.drop("id"), "set_id"), used, firsts)
    out = join_lookup(out, labels, "v")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "v"))
    return out.select(F.col("id").alias(key), F.when(F.col("id").isNotNull(), F.col("v")).alias("class_id"), component.alias("component_id"))


def draw(vector: np.ndarray, side: int = 112) -> np.ndarray:
    """A picture of a vector: four values at a time make one grey rectangle."""
    values = np.asarray(vector, np.float64)
    spread = values.std() or 1.0
    u = 0.5 * (1 + np.tanh((values - values.mean()) / spread))
    image = np.full((side, side), 128.0)
    for cx, cy, size, grey in u[: len(u) // 4 * 4].reshape(-1, 4):
        w, h = 8 + int(30 * size), 8 + int(30 * (1 - size))
        x, y = int(cx * (side - w)), int(cy * (side - h))
        image[y : y + h, x : x + w] = 255 * ((grey * 997) % 1.0)
    return image


def edited(image: np.ndarray, number: int) -> np.ndarray:
    """A crop, a change of contrast, or a crop with a caption bar."""
    if number % 3 == 0:
        return image[10:, 6:-4]
    if number % 3 == 1:
        return 30 + 0.7 * image
    out = image[4:-8, 12:].copy()
    out[-9:] = 20
    return out


def op7_media(spark, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` drawn as pictures (2 * vec_id; null for a null one), with an edited copy of every fourth (2 * vec_id + 1)."""

    def run(columns):
        ids, data, ends = [], [], [0]
        for i, vector in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            image = draw(np.array([x or 0.0 for x in vector or [0.0]], np.float32))
            ids.append(None if i is None else 2 * i)
            data.append(pgm(image))
            if i is not None and i % 4 == 0:
                ids.append(2 * i + 1)
                data.append(pgm(edited(image, i // 4)))
            ends.append(len(ids))
        ends = pa.array(ends, pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(data, pa.binary()))]

    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    drawn = map_batches(vectors, [], [F.col("vec_id"), F.col("embedding")], run, {"media_id": "array<long>", "data": "array<binary>"})
    return find_copies(drawn.select(F.inline(F.arrays_zip("media_id", "data"))))
