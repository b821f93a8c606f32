"""Media columns: local image descriptors find cropped or edited copies.

An image gives all corners at several scales; each corner gets the direction of its intensity
centroid and DESCRIPTOR_BITS binary tests turned by it. Distinct images (by digest) are indexed by
TABLES tables of KEY_BITS bits each of the descriptors; queries meet them in an equi-join per table
whose condition checks the full Hamming distance, and a pair of images counts as a copy if one
similarity transform (scale, turn, shift) explains enough of its matches. Keys that very many
corners share are met in blocks, so no task holds such a key.

So that many near-equal images do not all meet each other, images whose signature (the signs of
64 brightness steps) links them are compared with the first of their group, and those that its
descriptors confirm join its class. Every distinct image goes into the tables with its own
descriptors, since a member may show what the first image of its class doesn't; links within a
class are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.llm.components import components
from claimweave.llm.simhash import linked
from claimweave.session import discard, prepare, store

#: Side of a rendered texture, scales, patch radius, border.
SIDE, SCALES, RADIUS, EDGE = 64, (1.0, 0.8, 0.64), 8, 10
DESCRIPTOR_BITS, TABLES, KEY_BITS, NEAR = 256, 24, 44, 48
LEAST_INLIERS, SLACK = 5, 3.0
#: Signature bits that may differ within a group of near-equal images.
SIGN_RADIUS = 6
#: Bits of the mask of asked keys per table; rows of one key that a block holds; images, and their bytes, worked on at a time.
MASK_BITS, BLOCK, SLICE, SLICE_BYTES = 23, 2048, 256, 1 << 20
#: Pixels and corners described at a time; pairs of descriptors compared at a time; transforms tried first.
PIXELS, AT_ONCE, PAIRS_AT_ONCE, FIRST_TRIES = 64 * SIDE * SIDE, 4096, 1 << 20, 256
#: Rows of (image, class) that differ which are still broadcast to the images.
MOST_BROADCAST = 200_000
_rng = np.random.default_rng(4)
#: Pairs of points about as far along the corner's direction: turned that way, their order is a fair coin.
TESTS = _rng.uniform(-RADIUS, RADIUS, (DESCRIPTOR_BITS, 4)) / 1.15
TESTS[:, 2] = TESTS[:, 0] + _rng.normal(0, 1.0, DESCRIPTOR_BITS)
KEYS = np.stack([_rng.choice(DESCRIPTOR_BITS, KEY_BITS, replace=False) for _ in range(TABLES)])


def rendered(vectors: np.ndarray, side: int = SIDE) -> np.ndarray:
    """A texture per vector: waves of fixed random directions, weighted by its values (0 to 255)."""
    rng, n = np.random.default_rng(44), vectors.shape[1]
    freq, phase = rng.normal(0, 0.5, (n, 2)), rng.uniform(0, 2 * np.pi, n)
    y, x = np.mgrid[0:side, 0:side]
    waves = np.cos(freq[:, 0, None, None] * x + freq[:, 1, None, None] * y + phase[:, None, None])
    made = np.tensordot(vectors, waves, axes=1)
    low, high = made.min(axis=(1, 2), keepdims=True), made.max(axis=(1, 2), keepdims=True)
    return np.round(255 * (made - low) / np.maximum(high - low, 1e-9)).astype(np.uint8)


def encode(image: np.ndarray) -> bytes:
    """Height, width (2 bytes each), then the grey values."""
    return np.array(image.shape, dtype="<u2").tobytes() + image.astype(np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray:
    """The inverse of encode; null, short and damaged bytes give an empty image."""
    if not data or len(data) < 5:
        return np.zeros((0, 0), np.uint8)
    h, w = np.frombuffer(data[:4], "<u2")
    return np.frombuffer(data[4:], np.uint8).reshape(h, w) if len(data) - 4 == int(h) * int(w) else np.zeros((0, 0), np.uint8)


def resized(images: np.ndarray, h: int, w: int, scale: float) -> np.ndarray:
    """Bilinear samples of each image at steps of 1 / scale, clamped at the border."""
    if scale == 1.0:
        return images
    y, x = np.minimum(np.arange(h) / scale, images.shape[1] - 1.001), np.minimum(np.arange(w) / scale, images.shape[2] - 1.001)
    i, j, a, b = y.astype(int), x.astype(int), (y % 1)[:, None], x % 1
    rows = images[:, i] * (1 - a) + images[:, i + 1] * a
    return rows[:, :, j] * (1 - b) + rows[:, :, j + 1] * b


def smooth(images: np.ndarray) -> np.ndarray:
    """A binomial filter of five taps along both axes."""
    h, w = images.shape[1:]
    p = np.pad(images, ((0, 0), (2, 2), (0, 0)), mode="edge")
    images = (p[:, :h] + p[:, 4 : h + 4] + 4 * (p[:, 1 : h + 1] + p[:, 3 : h + 3]) + 6 * p[:, 2 : h + 2]) / 16
    p = np.pad(images, ((0, 0), (0, 0), (2, 2)), mode="edge")
    return (p[:, :, :w] + p[:, :, 4 : w + 4] + 4 * (p[:, :, 1 : w + 1] + p[:, :, 3 : w + 3]) + 6 * p[:, :, 2 : w + 2]) / 16


def largest_near(values: np.ndarray) -> np.ndarray:
    """The largest value within two pixels along both axes."""
    h, w = values.shape[1:]
    p = np.pad(values, ((0, 0), (2, 2), (0, 0)), mode="edge")
    values = np.max([p[:, k : k + h] for k in range(5)], axis=0)
    p = np.pad(values, ((0, 0), (0, 0), (2, 2)), mode="edge")
    return np.max([p[:, :, k : k + w] for k in range(5)], axis=0)


def turned_tests(small: np.ndarray, n: np.ndarray, y: np.ndarray, x: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The direction of each corner's intensity centroid, and its binary tests turned by it."""
    h, w = small.shape[1:]
    patch = small[n[:, None], y[:, None] + dy, x[:, None] + dx]
    turn = np.arctan2(patch @ dy, patch @ dx)
    c, s = np.cos(turn)[:, None], np.sin(turn)[:, None]
    spot = lambda u, v: small[n[:, None], np.rint(y[:, None] + s * u + c * v).astype(int).clip(0, h - 1), np.rint(x[:, None] + c * u - s * v).astype(int).clip(0, w - 1)]
    return turn, spot(TESTS[:, 0], TESTS[:, 1]) < spot(TESTS[:, 2], TESTS[:, 3])


def describe(images: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each image of one shape: corners (x, y, scale, turn) in its own coordinates, and their bits."""
    points, bits, owner = [], [], []
    for scale in SCALES:
        h, w = (int(round(n * scale)) for n in images.shape[1:])
        if min(h, w) <= 2 * EDGE:
            continue
        small = smooth(resized(images.astype(np.float32), h, w, scale))
        gy, gx = np.gradient(small, axis=(1, 2))
        xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
        strength = xx * yy - xy**2 - 0.05 * (xx + yy) ** 2
        inner = np.zeros((h, w), bool)
        inner[EDGE:-EDGE, EDGE:-EDGE] = True
        n, y, x = np.nonzero((strength >= largest_near(strength)) & (strength > 1.0) & inner)
        dy, dx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
        disc = dy**2 + dx**2 <= RADIUS**2
        dy, dx = dy[disc], dx[disc]
        for at in range(0, len(n), AT_ONCE):
            turn, found = turned_tests(small, n[at : at + AT_ONCE], y[at : at + AT_ONCE], x[at : at + AT_ONCE], dy, dx)
            bits.append(found)
            points.append(np.stack([x[at : at + AT_ONCE] / scale, y[at : at + AT_ONCE] / scale, np.full(len(turn), 1 / scale), turn], axis=1).astype(np.float32))
            owner.append(n[at : at + AT_ONCE])
    if not owner:
        return [(np.zeros((0, 4), np.float32), np.zeros((0, DESCRIPTOR_BITS), bool))] * len(images)
    owner, points, bits = np.concatenate(owner), np.concatenate(points), np.concatenate(bits)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(1, len(images)))
    return list(zip(np.split(points[order], cuts), np.split(bits[order], cuts), strict=True))


def described(media: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """describe() and signatures() of encoded images of any shapes, in their order."""
    images = [decode(m) for m in media]
    out: list = [None] * len(images)
    shapes: dict[tuple, list[int]] = {}
    for i, image in enumerate(images):
        shapes.setdefault(image.shape, []).append(i)
    for (h, w), rows in shapes.items():
        many = max(1, min(64, PIXELS // max(1, h * w)))
        for k in range(0, len(rows), many):
            stack = np.stack([images[i] for i in rows[k : k + many]])
            for i, found, sign in zip(rows[k : k + many], describe(stack), signatures(stack), strict=True):
                out[i] = (*found, sign)
    return out


def signatures(images: np.ndarray) -> np.ndarray:
    """For each image of one shape: the signs of the steps between nine smoothed samples on each of eight rows."""
    h, w = images.shape[1:]
    if min(h, w) < 2:
        return np.zeros(len(images), np.int64)
    soft = smooth(smooth(images.astype(np.float32)))
    rows, columns = np.rint(np.linspace(0.06, 0.94, 8) * (h - 1)).astype(int), np.rint(np.linspace(0.05, 0.95, 9) * (w - 1)).astype(int)
    seen = soft[:, rows][:, :, columns]
    return np.packbits((seen[:, :, 1:] > seen[:, :, :-1]).reshape(len(images), 64), axis=1, bitorder="little").view("<i8").reshape(-1)


def sliced(batches: Iterator[pa.RecordBatch], *heavy: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of SLICE rows, or fewer if their heavy columns hold over SLICE_BYTES, whatever the session's batch size."""
    for batch in batches:
        size = sum((pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False) for k in heavy), np.zeros(batch.num_rows, np.int64))
        at = 0
        while at < batch.num_rows:
            rows = max(1, int(np.searchsorted(np.cumsum(size[at : at + SLICE]), SLICE_BYTES, side="right")))
            yield batch.slice(at, rows)
            at += rows


def descriptors(media: DataFrame) -> DataFrame:
    """id, digest, sign, points (float32 x, y, scale, turn of each corner), d (32 bytes each): a row per row of media.

    A task describes equal bytes once in a while. No shuffle.
    """

    def run(batches):
        known: dict[str, tuple] = {}
        for batch in sliced(batches, 1):
            held = [m or b"" for m in batch.column(1).to_pylist()]
            digests = [hashlib.sha256(m).hexdigest()[:32] for m in held]
            if len(known) > 4 * SLICE:
                known.clear()
            new = {d: m for d, m in zip(digests, held, strict=True) if d not in known}
            for d, (points, bits, sign) in zip(new, described(list(new.values())), strict=True):
                known[d] = (points.astype("<f4").tobytes(), np.packbits(bits, axis=1, bitorder="little").tobytes(), int(sign))
            rows = [known[d] for d in digests]
            made = [pa.array(digests), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "digest", "sign", "points", "d"])

    return media.select("id", "media").mapInArrow(run, "id long, digest string, sign long, points binary, d binary")


def corner_keys(bits: np.ndarray) -> np.ndarray:
    """The key of each corner (row) in each table (column)."""
    weights = 1 << np.arange(KEY_BITS, dtype=np.int64)
    return np.stack([bits[:, k].astype(np.int64) @ weights for k in KEYS], axis=1)


def mask_slot(keys: np.ndarray) -> np.ndarray:
    """Which bit of a table's mask stands for a key."""
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MASK_BITS)).astype(np.int64)


def spread(images: DataFrame, asked: np.ndarray | None = None, keys_only: bool = False) -> DataFrame:
    """A row per corner and table: key (with the table's number) and tab, slot (keys_only) or n, h, c (the corner), d0 to d3.

    images: n, h (numbers of an image and of its class's first), d. asked: only keys whose bit of the mask is set.
    """
    shared = images.sparkSession.sparkContext.broadcast(asked)  # TABLES * 2^MASK_BITS bits
    names = ["key"] + (["tab", "slot"] if keys_only else ["n", "h", "c", "d0", "d1", "d2", "d3"])

    def run(batches):
        mask = shared.value
        for part in sliced(batches, 2):
            held = part.column(2).to_pylist()
            longs = np.frombuffer(b"".join(held), "<i8").reshape(-1, 4)
            if not len(longs):
                continue
            sizes = np.array([len(d) // 32 for d in held])
            keys = corner_keys(np.unpackbits(longs.view(np.uint8), axis=1, bitorder="little"))
            slots = mask_slot(keys)
            corner, tab = np.indices(keys.shape)
            use = np.ones(keys.shape, bool) if mask is None else (mask[tab, slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
            columns = [keys[use] * TABLES + tab[use]]
            if keys_only:
                columns += [tab[use].astype(np.int32), slots[use].astype(np.int32)]
            else:
                c = corner[use]
                own = np.arange(len(longs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                columns += [np.repeat(np.asarray(part.column(0)), sizes)[c], np.repeat(np.asarray(part.column(1)), sizes)[c], own[c].astype(np.int32), *longs[c].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in columns], names=names)

    schema = "key long, " + ("tab int, slot int" if keys_only else "n long, h long, c int, d0 long, d1 long, d2 long, d3 long")
    return images.select("n", "h", "d").mapInArrow(run, schema)


def asked_mask(keys: DataFrame) -> np.ndarray:
    """Which mask bits of each table some keys (tab, slot) have: TABLES * 2^MASK_BITS bits, whatever their number."""
    rows = keys.groupBy("tab", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, slot & 63)")).alias("bits")).toArrow()
    mask = np.zeros((TABLES, 1 << (MASK_BITS - 6)), np.uint64)
    mask[np.asarray(rows["tab"]), np.asarray(rows["word"])] = np.asarray(rows["bits"]).view(np.uint64)
    return mask


def distance(a: str, b: str) -> Column:
    return sum((F.bit_count(F.col(f"{a}.d{i}").bitwiseXOR(F.col(f"{b}.d{i}"))) for i in (1, 2, 3)), F.bit_count(F.col(f"{a}.d0").bitwiseXOR(F.col(f"{b}.d0"))))


def first_table(a: str, b: str) -> Column:
    """Whether a matched key's table is the first of those in which two descriptors meet, so that each pair counts once."""
    out = F.lit(True)
    for t, bits in enumerate(KEYS[:-1]):
        words = np.zeros(4, np.uint64)
        for k in bits.tolist():
            words[k >> 6] |= np.uint64(1 << (k & 63))
        apart = [F.col(f"{a}.d{i}").bitwiseXOR(F.col(f"{b}.d{i}")).bitwiseAND(F.lit(int(w))) for i, w in enumerate(words.view(np.int64))]
        out = out & ((F.col(f"{a}.key") % TABLES <= t) | (apart[0].bitwiseOR(apart[1]).bitwiseOR(apart[2]).bitwiseOR(apart[3]) != 0))
    return out


def consensus(one: np.ndarray, two: np.ndarray, slack: float = SLACK) -> int:
    """Most distinct corners that one similarity transform, taken from a match, carries onto their partners.

    one, two: x, y, scale, turn of the two corners of each match. Of more than FIRST_TRIES matches
    evenly spaced ones are tried first, and the others only until LEAST_INLIERS agree: whether they
    do is exact, how many then is the most among those tried.
    """
    q, r = one[:, :2].astype(float), two[:, :2].astype(float)
    grow, turn = two[:, 2].astype(float) / one[:, 2], two[:, 3].astype(float) - one[:, 3]
    best = 0
    first = np.unique(np.linspace(0, max(0, len(q) - 1), min(len(q), FIRST_TRIES)).astype(int))
    for at, k in enumerate(np.concatenate([first, np.setdiff1d(np.arange(len(q)), first)])):
        if at >= FIRST_TRIES and best >= LEAST_INLIERS:
            break
        c, s = grow[k] * np.cos(turn[k]), grow[k] * np.sin(turn[k])
        d = q - q[k]
        moved = np.stack([c * d[:, 0] - s * d[:, 1], s * d[:, 0] + c * d[:, 1]], axis=1) + r[k]
        bend = np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi)
        ok = (np.hypot(*(moved - r).T) <= slack * max(1.0, grow[k])) & (bend < 0.5) & (np.abs(np.log(grow / grow[k])) < 0.5)
        best = max(best, min(len({(round(a), round(b)) for a, b in q[ok]}), len({(round(a), round(b)) for a, b in r[ok]})))
    return best


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows; a stored table, as it is counted."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def confirmed(images: DataFrame) -> DataFrame:
    """n, h, head: the first image of an image's signature group, where that is another and descriptors confirm it as a copy."""
    seen = images.where(F.length("d") > 0).select("image", "n", "sign")
    signs = store(seen.groupBy(F.col("sign").alias("_fp")).agg(F.min(F.struct("image", "n")).alias("first")), "signs").df
    found = components(linked(signs.select("_fp"), SIGN_RADIUS))
    root = store(signs.join(found, signs["_fp"] == found["node"], "left").select("_fp", "first", F.coalesce("component", "_fp").alias("root")), "sign-roots").df
    least = store(root.groupBy("root").agg(F.min("first").alias("head")), "sign-heads").df
    heads = root.join(least, "root").select("_fp", "head")
    # only images of larger groups, and their descriptors, move
    proposed = store(seen.join(heads, seen["sign"] == heads["_fp"]).select("n", F.col("head.n").alias("h"), F.col("head.image").alias("head")).where("n <> h"), "proposed").df
    own = images.join(small(proposed), "n").select("n", "h", "head", "points", "d")
    theirs = images.join(small(store(proposed.select(F.col("h").alias("n")).distinct(), "proposed").df), "n", "left_semi")
    pairs = own.join(theirs.select(F.col("n").alias("h"), F.col("points").alias("hp"), F.col("d").alias("hd")), "h").select("n", "h", "head", "points", "d", "hp", "hd")

    def run(batches):
        for part in sliced(batches, 3, 4, 5, 6):
            same = [alike(*row) for row in zip(*(part.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)]
            yield part.select([0, 1, 2]).filter(pa.array(same, pa.bool_()))

    return pairs.mapInArrow(run, "n long, h long, head string")


def alike(points: bytes, d: bytes, other_points: bytes, other_d: bytes) -> bool:
    """Whether near descriptors of two images agree on one transform."""
    p, r = (np.frombuffer(x, "<f4").reshape(-1, 4) for x in (points, other_points))
    a, b = (np.frombuffer(x, "<u8").reshape(-1, 4) for x in (d, other_d))
    step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
    near = [(i + at, j) for at in range(0, len(a), step) for i, j in [np.nonzero(np.bitwise_count(a[at : at + step, None] ^ b[None]).sum(axis=2) <= NEAR)]]
    i, j = (np.concatenate([x[k] for x in near]) if near else np.zeros(0, int) for k in (0, 1))
    return len(i) >= LEAST_INLIERS and consensus(p[i], r[j]) >= LEAST_INLIERS


def met_in_blocks(asked: DataFrame, held: DataFrame, counts: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides with blk: keys of over block rows are cut into blocks, each pair of which meets once.

    counts: key, n_asked, n_held. A crowded key's rows of one side are dealt by image, and
    repeated for each block of the other side; all other rows have block 0.
    """
    cut = lambda n: F.ceil(F.col(n) / block).cast("int")
    crowded = store(counts.where((F.col("n_asked") > block) | (F.col("n_held") > block)).select("key", cut("n_asked").alias("down"), cut("n_held").alias("across")), "crowded-keys").df
    if crowded.isEmpty():
        return asked.withColumn("blk", F.lit(0)), held.withColumn("blk", F.lit(0))
    crowded = small(crowded)
    one = lambda n: F.coalesce(F.col(n), F.lit(1))
    own = lambda n: F.pmod(F.xxhash64("n", "c"), one(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), one(n) - 1))
    q = asked.join(crowded, "key", "left").withColumn("_y", every("across")).withColumn("blk", own("down") * one("across") + F.col("_y"))
    r = held.join(crowded, "key", "left").withColumn("_y", every("down")).withColumn("blk", F.col("_y") * one("across") + own("across"))
    return q.drop("_y", "down", "across"), r.drop("_y", "down", "across")


def matches(asking: DataFrame, held: DataFrame) -> DataFrame:
    """n, other, h, g, m: pairs of images of two classes with LEAST_INLIERS near corners or more, and those (corner, corner).

    Descriptors move only with keys that two corners or more have, one of them asked.
    """
    asked_keys = spread(asking, keys_only=True)
    number = lambda keys, name: keys.groupBy("key", "tab", "slot").agg(F.count("*").alias(name))
    mine, all_ = number(asked_keys, "n_asked"), number(spread(held, asked_mask(asked_keys), keys_only=True), "n_held")
    shared = store(mine.join(all_, ["key", "tab", "slot"]).where("n_held > 1"), "shared-keys").df
    mask = asked_mask(shared)
    q, r = met_in_blocks(spread(asking, mask), spread(held, mask), shared)
    on = (F.col("q.key") == F.col("r.key")) & (F.col("q.blk") == F.col("r.blk")) & (F.col("q.h") != F.col("r.h")) & (distance("q", "r") <= NEAR) & first_table("q", "r")
    named = {"n": "q.n", "other": "r.n", "h": "q.h", "g": "r.h", "c": "q.c", "k": "r.c"}
    met = q.alias("q").join(r.alias("r"), on).select(*[F.col(c).alias(n) for n, c in named.items()])
    return met.groupBy("n", "other", "h", "g").agg(F.collect_list(F.struct("c", "k")).alias("m")).where(F.size("m") >= LEAST_INLIERS)


def agreeing(matched: DataFrame, asking: DataFrame, held: DataFrame) -> DataFrame:
    """h, g, inliers: the classes of matched images whose corners one transform explains."""
    corners = lambda df, n, p: df.select(F.col("n").alias(n), F.col("points").alias(p))
    rows = corners(held, "other", "r").join(small(matched), "other").join(corners(asking, "n", "q"), "n").select("h", "g", "q", "r", "m")

    def run(batches):
        for part in sliced(batches, 2, 3):
            inliers = []
            for q, r, m in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                i, j = np.array([(x["c"], x["k"]) for x in m]).T
                inliers.append(consensus(np.frombuffer(q, "<f4").reshape(-1, 4)[i], np.frombuffer(r, "<f4").reshape(-1, 4)[j]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(inliers, pa.int32())], names=["h", "g", "inliers"])

    return rows.mapInArrow(run, "h long, g long, inliers int").where(F.col("inliers") >= LEAST_INLIERS).groupBy("h", "g").agg(F.max("inliers").alias("inliers"))


def media_copies(media: DataFrame, queries: Column) -> DataFrame:
    """kind, id, class_id, other, inliers: membership of every row, and copies among the classes of the queries.

    media: id, media (bytes of encode()). A class, named by the digest of its first image, holds
    the rows of equal bytes and of near-equal images whose descriptors match that image. Null and
    damaged media form classes by their bytes and have no corners, so no copies.
    kind 'member': a row for every row of media. kind 'pair': class_id has a row among the queries
    (a condition on id) and class other holds a cropped or edited copy of such a row or of the
    class's first image, with so many inliers at most.
    Repeated rows and ids: a member row each; one id on two images: in two classes. Empty table: no
    rows. Other columns are not read, whatever their names.
    """
    spark = prepare(media.sparkSession)
    rows = store(descriptors(media).withColumn("_asked", F.coalesce(queries, F.lit(False))), "descriptors")
    # equal digests have equal descriptors: any of them will do
    first = rows.df.groupBy(F.col("digest").alias("image")).agg(F.max("_asked").alias("asked"), F.first("sign").alias("sign"), F.first("points").alias("points"), F.first("d").alias("d"))
    images = store(first.withColumn("n", F.monotonically_increasing_id()), "media-images")
    ids = store(rows.df.select("id", F.col("digest").alias("image")), "media-ids").df
    discard(spark, rows.path)
    heads = small(store(confirmed(images.df), "media-heads").df)
    held = images.df.join(heads, "n", "left").select("n", F.coalesce("h", "n").alias("h"), "asked", "points", "d")
    asks = store(held.where("asked").select(F.explode(F.array("n", "h")).alias("n")).distinct(), "media-asks").df
    asking = store(held.join(small(asks), "n", "left_semi"), "media-asking").df
    pairs = agreeing(store(matches(asking, held), "media-matches").df, asking, held)
    names = store(images.df.join(heads, "n", "left").select("n", "image", F.coalesce("head", "image").alias("class_id")), "media-classes").df
    name = lambda n, out: names.select(F.col("n").alias(n), F.col("image").alias(out))
    found = store(pairs.join(name("h", "class_id"), "h").join(name("g", "other"), "g").select(F.lit("pair").alias("kind"), F.lit(None).cast("long").alias("id"), "class_id", "other", "inliers"), "media-pairs").df
    discard(spark, images.path)
    members = ids.join(names, "image").select(F.lit("member").alias("kind"), "id", "class_id", F.lit(None).cast("string").alias("other"), F.lit(None).cast("int").alias("inliers"))
    return members.unionByName(found)


#: Edits that the query plants: a strong crop, a milder one, a quarter turn, dimming, noise, another scale.
EDITS = ("crop", "trim", "turn", "dim", "noise", "scale")


def edited(image: np.ndarray, edit: str) -> np.ndarray:
    """A copy of a grey picture of SIDE pixels, edited."""
    x = image.astype(float)
    if edit == "crop":  # five eighths of each side
        return image[SIDE // 8 : SIDE * 3 // 4, SIDE // 8 : SIDE * 3 // 4]
    if edit == "trim":
        return image[SIDE // 16 : SIDE * 7 // 8, SIDE // 10 : SIDE * 15 // 16]
    if edit == "turn":
        return np.ascontiguousarray(np.rot90(image))
    if edit == "dim":
        return np.round(x * 0.6 + 60)
    if edit == "noise":
        return np.round(np.clip(x + np.random.default_rng(int(x.sum())).normal(0, 12, x.shape), 0, 255))
    return np.round(resized(x[None], SIDE * 5 // 4, SIDE * 5 // 4, 1.25)[0])


def textures(vectors: DataFrame, every: int = 20) -> DataFrame:
    """id, media, edit: each embedding rendered as a texture, and planted copies.

    vectors: vec_id, embedding. Of each id divisible by every, an edited copy (its edit by id)
    stands beside it with id -1 - id. Null vectors, and vectors that hold a null, give null media
    and no copy; shorter vectors are filled up with zeros. Empty table: no rows.
    """

    def run(batches):
        for batch in sliced(batches):
            ids, values = batch.column(0).to_pylist(), [v if v and None not in v else None for v in batch.column(1).to_pylist()]
            width = max((len(v) for v in values if v), default=1)
            made = rendered(np.array([(v + [0.0] * width)[:width] if v else [0.0] * width for v in values], dtype=np.float64))
            rows = [(i, encode(m) if v else None, None) for i, m, v in zip(ids, made, values, strict=True)]
            for i, m, v in zip(ids, made, values, strict=True):
                if v and i is not None and i % every == 0:
                    edit = EDITS[i // every % len(EDITS)]
                    rows.append((-1 - i, encode(edited(m, edit)), edit))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "media", "edit"])

    return vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding").mapInArrow(run, "id long, media binary, edit string")
