"""Edited copies of pictures by local descriptors.

Pictures are grey; PNM (P5, P6) and non-interlaced 8-bit PNG are decoded in numpy. Per picture:

* corners: local maxima of the Harris response on scales ``STEP`` apart;
* descriptors: the patch around a corner, turned by the direction of its intensity centroid, gives
  ``BITS`` comparisons of smoothed pixels (the same point pairs for every patch);
* joins: the bits are dealt to ``PARTS`` parts of ``CELLS`` cells; for each part and each cell left out, the other
  cells make a key of a hash table. Two descriptors at most ``2 * PARTS - 1`` bits apart differ in at most one bit of
  some part and so meet in a table for certain; of farther ones, those whose bits happen to fall well;
* consensus: descriptors of two pictures match within ``REACH`` bits. Two matches fix a change of scale, turn and
  shift; the pair of pictures is linked if one such change fits ``MIN_VOTES`` matches on distinct places of both.

Equal pictures collapse to one first. Pictures that share a key form a bucket. Every picture is verified
against the smallest one that it meets; then, in buckets that are not all joined by that, pictures of other components
against the bucket's smallest; then, in open buckets of at most ``SMALL`` pictures, all pairs of different components. A larger open bucket sends its pictures through tables of other, independent parts. Buckets of any of the
``LEVELS`` rounds of tables that are still open after the last one hold pictures that share a corner without being copies; there
the next pictures of each bucket, twice as many each time, meet all others of other components, until it is joined or all have met.

What is known of classes is carried on from verification to verification; buckets and pairs that are few are worked on in one task
(``few``), since dealing some hundred rows to hundreds of partitions dozens of times takes longer than all verification.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phrasemill.llm.common import arrow_rows, buckets_of, discard, few, open_pairs, sized, stored, united

#: Scales of a picture: at most so many, each smaller than the one before by the factor ``STEP``.
SCALES, STEP, PATCH = 6, math.sqrt(2), 11
BITS, PARTS, CELLS = 256, 4, 3
#: Independent rounds of tables, the most pictures of a bucket whose pairs are verified at once, and the first ones that meet all others of a larger one.
LEVELS, SMALL, PIVOTS = 3, 8, 8
#: Bits by which two descriptors of one corner may differ once two pictures are compared.
REACH = 32
#: A corner is the strongest within so many pixels each way.
APART = 2
#: Share of a picture's strongest corner that a corner's response must reach.
RELATIVE = 0.01
MIN_VOTES = 6
#: A match fits a change of place within this share of the picture's extent, but ``LEAST_PLACE`` pixels at least, and within ``TURN`` radians.
PLACE, LEAST_PLACE, TURN = 0.02, 2.5, 0.6
#: Pictures, or pairs of them, that are handed to Python at once.
AT_ONCE = 500
#: The most pictures that are broadcast for a verification of few pairs.
CARRIED = 1000
#: Other matches that each match is paired with to fix a change; matches compared at once.
PARTNERS, BLOCK = 8, 1 << 22
_PAIRS = np.clip(np.random.Generator(np.random.PCG64(5)).normal(0, PATCH / 2.5, (BITS, 4)), -PATCH + 1, PATCH - 1)


def decode(data: bytes | None) -> np.ndarray | None:
    """The grey picture of PNM or PNG bytes as floats; None if they can't be read."""
    try:
        if data[:2] in (b"P5", b"P6"):
            fields, at = [], 2
            while len(fields) < 3:
                while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
                    at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
                end = at
                while data[end : end + 1].isdigit():
                    end += 1
                fields.append(int(data[at:end]))
                at = end
            w, h, top = fields
            depth = 3 if data[:2] == b"P6" else 1
            if top != 255 or w < 1 or h < 1:
                return None
            raw = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
            return raw.astype(np.float64).mean(2)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, struct.error, zlib.error, TypeError):
        pass
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, body, head, palette = 8, b"", None, None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        palette = np.frombuffer(part, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    w, h, bits, colour, _, _, interlace = head
    if bits != 8 or interlace:
        return None
    bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(body), np.uint8, h * (1 + w * bpp)).reshape(h, 1 + w * bpp)
    out, above = np.zeros((h, w * bpp), np.uint8), np.zeros(w * bpp, np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind in (1, 3, 4):
            for x in range(w * bpp):
                left = int(line[x - bpp]) if x >= bpp else 0
                up, corner = int(above[x]), int(above[x - bpp]) if x >= bpp else 0
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    d = (abs(up - corner), abs(left - corner), abs(left + up - 2 * corner))
                    guess = (left, up, corner)[d.index(min(d))]
                line[x] = (int(line[x]) + guess) & 255
        out[y] = above = line
    out = out.reshape(h, w, bpp)
    if colour == 3:
        return palette[out[..., 0]].astype(np.float64).mean(2)
    return out[..., : 3 if bpp > 2 else 1].astype(np.float64).mean(2)


def png(grey: np.ndarray) -> bytes:
    """A grey picture as PNG bytes."""

    def chunk(kind: bytes, part: bytes) -> bytes:
        return struct.pack(">I", len(part)) + kind + part + struct.pack(">I", zlib.crc32(kind + part))

    h, w = grey.shape
    raw = np.hstack([np.zeros((h, 1), np.uint8), np.clip(np.rint(grey), 0, 255).astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


def _blur(a: np.ndarray) -> np.ndarray:
    """Binomial smoothing over five pixels each way."""
    for axis in (0, 1):
        p = np.pad(a, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        n = a.shape[axis]
        s = [np.take(p, range(k, k + n), axis) for k in range(5)]
        a = (s[0] + 4 * s[1] + 6 * s[2] + 4 * s[3] + s[4]) / 16
    return a


def corners(a: np.ndarray) -> np.ndarray:
    """Rows and columns of the local maxima of the Harris response, off the border."""
    gy, gx = np.gradient(a)
    xx, yy, xy = _blur(gx * gx), _blur(gy * gy), _blur(gx * gy)
    r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    if r.shape[0] <= 2 * PATCH or r.shape[1] <= 2 * PATCH or r.max() <= 1e-6:
        return np.empty((0, 2), np.int64)
    high = r
    for axis in (0, 1):
        padded = np.pad(high, [(APART, APART) if k == axis else (0, 0) for k in (0, 1)], mode="edge")
        high = np.max([np.take(padded, range(k, k + r.shape[axis]), axis) for k in range(2 * APART + 1)], 0)
    y, x = np.nonzero((r >= high) & (r > RELATIVE * r.max()))
    ok = (y >= PATCH) & (y < r.shape[0] - PATCH) & (x >= PATCH) & (x < r.shape[1] - PATCH)
    return np.stack([y[ok], x[ok]], 1)


def shrunk(a: np.ndarray, factor: float) -> np.ndarray:
    """The picture at ``1 / factor`` of its size, by linear interpolation."""
    for axis in (0, 1):
        n = max(1, round(a.shape[axis] / factor))
        at = np.clip((np.arange(n) + 0.5) * factor - 0.5, 0, a.shape[axis] - 1)
        low = np.minimum(at.astype(int), a.shape[axis] - 1)
        high, part = np.minimum(low + 1, a.shape[axis] - 1), (at - low).reshape((-1, 1) if axis == 0 else (1, -1))
        a = np.take(a, low, axis) * (1 - part) + np.take(a, high, axis) * part
    return a


def describe(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keypoints ``(scale, turn, row, column)`` in picture pixels, and packed descriptors of ``BITS // 8`` bytes."""
    span = np.arange(-PATCH + 1, PATCH)
    dy, dx = np.meshgrid(span, span, indexing="ij")
    disc = dy * dy + dx * dx < PATCH * PATCH
    points, bits = [], []
    a = grey
    for step in range(SCALES):
        smooth = _blur(a)
        at = corners(smooth)
        if len(at):
            y, x = at[:, :1, None], at[:, 1:, None]
            patch = smooth[y + dy[None], x + dx[None]] * disc
            turn = np.arctan2((patch * dy).sum((1, 2)), (patch * dx).sum((1, 2)))
            c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
            value = []
            for py, px in ((_PAIRS[:, 0], _PAIRS[:, 1]), (_PAIRS[:, 2], _PAIRS[:, 3])):
                ry, rx = py * c + px * s, px * c - py * s
                shrink = np.minimum(1, (PATCH - 1) / np.maximum(np.hypot(ry, rx), 1e-9))
                value.append(smooth[at[:, :1] + np.rint(ry * shrink).astype(int), at[:, 1:] + np.rint(rx * shrink).astype(int)])
            bits.append(np.packbits(value[0] < value[1], axis=1))
            points.append(np.column_stack([np.full(len(at), STEP**step), turn, (at + 0.5) * np.array(grey.shape) / np.array(a.shape) - 0.5]))
        a = shrunk(smooth, STEP)
        if min(a.shape) <= 2 * PATCH:
            break
    if not points:
        return np.empty((0, 4)), np.empty((0, BITS // 8), np.uint8)
    return np.concatenate(points), np.concatenate(bits)


def _matches(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of descriptors at most ``reach`` bits apart."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    rows = max(1, BLOCK // max(1, 4 * len(y)))
    found = [np.argwhere(np.bitwise_count(x[i : i + rows, None] ^ y[None]).sum(2, dtype=np.int32) <= reach) + [i, 0] for i in range(0, len(x), rows)]
    return tuple(np.concatenate(found).T)


def consensus(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], reach: int = REACH) -> int:
    """The most corners, on distinct places of both pictures, that one change of scale, turn and place from a to b fits."""
    (pa_, da), (pb, db) = a, b
    if not len(pa_) or not len(pb):
        return 0
    i, j = _matches(da, db, reach)
    m = len(i)
    if m < 2:
        return m
    za, zb = pa_[i, 3] + 1j * pa_[i, 2], pb[j, 3] + 1j * pb[j, 2]
    turn = np.exp(1j * (pb[j, 1] - pa_[i, 1]))
    near = max(LEAST_PLACE, PLACE * max(np.ptp(zb.real), np.ptp(zb.imag)))
    # Every match is paired with others at growing distances in the list, which is in order of scale and place.
    steps = np.unique(np.rint(np.geomspace(1, max(1, m - 1), PARTNERS)).astype(int))
    one = np.repeat(np.arange(m), len(steps))
    two = (one + np.tile(steps, m)) % m
    apart = (abs(za[two] - za[one]) > 2 * near) & (abs(zb[two] - zb[one]) > 2 * near)
    one, two = one[apart], two[apart]
    change = (zb[two] - zb[one]) / (za[two] - za[one])
    level = change / abs(change)
    sound = (abs(np.angle(turn[one] / level)) < TURN) & (abs(np.angle(turn[two] / level)) < TURN)
    change, shift = change[sound], zb[one[sound]] - change[sound] * za[one[sound]]
    most, rows = 1, max(1, BLOCK // (4 * m))
    for at in range(0, len(change), rows):
        c = change[at : at + rows, None]
        fits = (abs(c * za[None] + shift[at : at + rows, None] - zb[None]) <= near) & (abs(np.angle(turn[None] / c)) < TURN)
        number = fits.sum(1)
        for h in np.argsort(-number, kind="stable"):
            if number[h] <= most:
                break
            most = max(most, min(len(np.unique(za[fits[h]])), len(np.unique(zb[fits[h]]))))
    return most


def descriptors(pictures: DataFrame) -> DataFrame:
    """``points (scale, turn, row, column of each), bits`` beside the other columns of ``pictures(data, ...)``."""
    others = [c for c in pictures.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, bits = [], []
            for value in batch.column("data"):
                grey = decode(value.as_py())
                p, d = describe(grey) if grey is not None else (np.empty((0, 4)), np.empty((0, BITS // 8), np.uint8))
                points.append(p.astype(np.float32).tobytes())
                bits.append(d.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(points, pa.binary()), pa.array(bits, pa.binary())], [*others, "points", "bits"])

    schema = ", ".join(f"`{c}` {pictures.schema[c].dataType.simpleString()}" for c in others)
    return pictures.mapInArrow(run, f"{schema}, points binary, bits binary")


def keys(bits: np.ndarray, level: int = 0) -> np.ndarray:
    """The table keys of packed descriptors, one row each: for every part of the bits and every cell left out of it.

    ``level`` chooses one of many independent deals of the bits to parts and cells.
    """
    deal = np.random.Generator(np.random.PCG64([11, level])).permutation(BITS)
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, BITS // 8), axis=1)
    cells = np.array_split(deal, PARTS * CELLS)
    value = np.stack([flat[:, c] @ (1 << np.arange(len(c))) for c in cells], 1).astype(np.int64).reshape(-1, PARTS, CELLS)
    wide = BITS // (PARTS * CELLS) + 1
    out = []
    for part in range(PARTS):
        for left in range(CELLS):
            key = np.full(len(value), part * CELLS + left, np.int64)
            for cell in range(CELLS):
                if cell != left:
                    key = key << wide | value[:, part, cell]
            out.append(key)
    return np.stack(out, 1)


def _keyed(described: DataFrame, level: int) -> DataFrame:
    """``node, sig``: every distinct table key of a picture's descriptors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                raw = part.column("bits").to_pylist()
                found = keys(np.frombuffer(b"".join(raw), np.uint8), level)
                owner = np.repeat(np.arange(len(raw)), [len(x) * 8 // BITS for x in raw])
                rows = [np.unique(found[owner == k]) for k in range(len(raw))]
                node = np.repeat(part.column("node").to_numpy(), [len(x) for x in rows])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate(rows))], ["node", "sig"])

    return described.select("node", "bits").mapInArrow(run, "node long, sig long")


def _verified(pairs: DataFrame, described: DataFrame, least: int) -> DataFrame:
    """``a, b, ok`` (a table) of candidate pairs, by geometric consensus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [
                [(np.frombuffer(p, np.float32).reshape(-1, 4).astype(np.float64), np.frombuffer(d, np.uint8).reshape(-1, BITS // 8)) for p, d in zip(batch.column(f"p{s}").to_pylist(), batch.column(f"d{s}").to_pylist(), strict=True)]
                for s in "ab"
            ]
            ok = [consensus(x, y) >= least for x, y in zip(*side, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    # The pictures of few pairs go to every task, and the pairs are dealt anew; else the pictures are joined as they are.
    nodes = few(pairs).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if nodes.limit(CARRIED + 1).count() <= CARRIED:
        described = sized(described.join(F.broadcast(nodes), "node", "left_semi"), CARRIED)
        pairs = pairs.repartition(2 * pairs.sparkSession.sparkContext.defaultParallelism)
    sides = [described.select(F.col("node").alias(s), F.col("points").alias(f"p{s}"), F.col("bits").alias(f"d{s}")) for s in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "pa", "da", "pb", "db")
    with arrow_rows(pairs.sparkSession, AT_ONCE):
        return stored(both.mapInArrow(run, "a long, b long, ok boolean"))


def _open(rows: DataFrame, root: DataFrame) -> DataFrame:
    """The rows ``(node, bucket, ...)`` of buckets that ``root(node, root)`` doesn't join to one class.

    With each node's ``root``, the bucket's number of nodes ``n``, its smallest node ``low`` and that one's ``low_root``.
    """
    # A node's root reaches its rows by a window over the node, as in ``still_open``: a join would make all rows once more.
    both = few(rows.unionByName(root, allowMissingColumns=True))
    rooted = both.withColumn("root", F.coalesce(F.max("root").over(Window.partitionBy("node")), "node")).where("bucket is not null")
    ends = rooted.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.min_by("root", "node").alias("low_root"), F.min("root").alias("first"), F.max("root").alias("last"))
    return rooted.join(ends.where("first <> last").drop("first", "last"), "bucket")


def classes(described: DataFrame, least: int = MIN_VOTES) -> DataFrame:
    """``node, root`` of the pictures of ``described(node, points, bits)`` whose class has a smaller picture, root being the smallest.

    Classes are what the verified links join; every change of them goes on from the classes before, and open buckets from those before.
    """
    spark, tried, rest, kept, nodes = described.sparkSession, None, None, None, described
    root = spark.createDataFrame([], "node long, root long")

    def verify(pairs: DataFrame) -> None:
        nonlocal root, tried
        new = stored(pairs.join(sized(tried), ["a", "b"], "left_anti") if tried else pairs)
        if not new.isEmpty():
            checked = _verified(new, described, least)
            root = united(root, checked.where("ok").select("a", "b"))
            tried = checked.select("a", "b").unionByName(tried) if tried else checked.select("a", "b")
        discard(spark, new)

    def reopened(rows: DataFrame, *others: str) -> DataFrame:
        nonlocal kept
        before, kept = kept, stored(_open(rows.select("node", "bucket", *others), root))
        if before:
            discard(spark, before)
        return few(kept)

    for level in range(LEVELS):
        kept = stored(buckets_of(_keyed(nodes, level)))
        live = few(kept)
        # One pair a picture first: what that joins need not be verified again in every bucket.
        verify(live.groupBy("node").agg(F.min("low").alias("a")).where("a <> node").select("a", F.col("node").alias("b")))
        live = reopened(live)
        verify(live.where("root <> low_root").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct())
        live = reopened(live.where("n > 2"))
        verify(open_pairs(live, SMALL))
        live = reopened(live.where(F.col("n") > SMALL))
        if live.isEmpty():
            break
        # Later tables join most of them; pairs that meet only here are compared at the end.
        rest = live.select("node", "bucket").unionByName(rest) if rest else live.select("node", "bucket")
        nodes = described.join(sized(stored(live.select("node").distinct())), "node", "left_semi")
    if not rest:
        return root
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("node"))
    kept = None
    live = reopened(few(rest).distinct().withColumn("place", place), "place")
    done, some = 0, PIVOTS
    while not live.isEmpty():
        pivots = live.where(F.col("place").between(done + 1, done + some))
        pivots = pivots.select("bucket", F.col("node").alias("a"), F.col("place").alias("of"), F.col("root").alias("with"))
        verify(live.join(pivots, "bucket").where("place > of and root <> with").select("a", F.col("node").alias("b")).distinct())
        done, some = done + some, 2 * some
        live = reopened(live.where(F.col("n") > done + 1), "place")
    return root


def copies(pictures: DataFrame, key: str = "id", data: str = "data", least: int = MIN_VOTES) -> DataFrame:
    """``key, class_id, class_size`` of each row of ``pictures(key, data)``, key being a bigint.

    ``class_id``: the smallest key among the pictures that links reach; ``class_size``: the rows of its class.
    Null or unreadable data, and pictures without corners: linked with equal bytes only (null data with
    nothing). A row without a key gets the class of its picture's rows, null if there are none. Other columns are ignored.
    """
    rows = pictures.select(F.col(key).alias("id"), F.col(data).alias("data"), F.sha2(F.col(data), 256).alias("digest"))
    distinct = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows"), F.first("data").alias("data"))
    with arrow_rows(pictures.sparkSession, AT_ONCE):
        described = stored(descriptors(distinct))
    same = described.select("digest", "rows", "node")
    discard(pictures.sparkSession)
    known = same.join(classes(described, least), "node", "left").select("digest", "rows", F.coalesce("root", "node").alias("root"))
    known = known.withColumn("class_size", F.sum("rows").over(Window.partitionBy("root"))).select("digest", "root", "class_size")
    return rows.join(known, "digest", "left").select(
        F.col("id").alias(key), F.coalesce("root", "id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


SIDE = 64


def textures(n: int) -> np.ndarray:
    """``n`` fixed noise pictures of ``SIDE`` by ``SIDE`` pixels, smoothed a little."""
    rng = np.random.Generator(np.random.PCG64(3))
    return np.stack([_blur(rng.standard_normal((SIDE, SIDE))) for _ in range(n)])


def picture_of(vector: np.ndarray) -> np.ndarray:
    """A vector as a grey picture: the mixture of the fixed textures that it weighs."""
    mixed = np.tensordot(vector, textures(len(vector)), 1)
    return 128 + 48 * mixed / max(mixed.std(), 1e-9)


def pictures_of_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, data``: PNG pictures of vectors, for tables that hold no pictures; null for null or empty vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                out = []
                for value in part.column(vector):
                    v = np.array([x or 0.0 for x in value.as_py() or []], np.float64)
                    if not len(v):
                        out.append(None)
                        continue
                    if len(v) not in base:
                        base[len(v)] = textures(len(v)).reshape(len(v), -1)
                    mixed = (v @ base[len(v)]).reshape(SIDE, SIDE)
                    out.append(png(128 + 48 * mixed / max(mixed.std(), 1e-9)))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out, pa.binary())], [key, "data"])

    return vectors.select(F.col(key).cast("long"), vector).mapInArrow(run, f"`{key}` long, data binary")
