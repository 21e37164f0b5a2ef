"""Operator 9: SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most 4 bits apart both lie within 2 bits of some value between them. So every
distinct fingerprint stands for all its variants within half the radius; fingerprints that collide in
a variant are paired, pairs are deduplicated and each is verified by counting the bits that differ.

All variants would be 2,081 rows a fingerprint. They are shuffled by their top bits: a row goes to each
of the few prefixes that its variants have, with the number of flips left for the rest, and the
receiving task enumerates the rest in arrays, in pieces of bounded size. A prefix with too many rows is
split by further bits, again and again. Members of a variant are paired with one of them, not with each
other, and a task gives back the verified pairs that connect what it found connected, so a group of
any size adds no more links than rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm._shared import forget, rows_named, written

RADIUS, SHINGLE, SEED, BITS = 4, 4, 42, 64
#: Variants that a task holds at once; 8 bytes each.
PIECE = 2_000_000
#: A prefix with more rows than this is split by SPLIT_BITS more bits, and its parts likewise.
MOST_ROWS, SPLIT_BITS = 200_000, 6


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 text over its word shingles: A-Z lower-cased, ASCII white space parts words, repeats count."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends + 1).tolist()]
    hashes = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends[min(shingle, len(words)) - 1 :].tolist())), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, 32_768):
        ones += np.unpackbits(hashes[i : i + 32_768].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) and the text's SHA-256, one row per row of df; a null text counts as empty."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [(x or "").encode() for x in part.column(1).to_pylist()]
                fps = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps), pa.array([hashlib.sha256(x).digest() for x in texts])], names=["doc_id", "fp", "sha"])

    plain = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, "doc_id long, fp long, sha binary")


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) for every way to flip up to `most` of `bits` bits."""
    return [(sum(1 << b for b in chosen), r) for r in range(most + 1) for chosen in combinations(range(bits), r)]


def _choices(bits: int, most: int):
    """An array column of (mask, flips)."""
    return F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(r).alias("r")) for m, r in _masks(bits, most)])


def _dealt(fps: DataFrame, n: int, half: int, piece: int, most: int = MOST_ROWS) -> DataFrame:
    """Rows (depth, prefix, fp, left): each fingerprint once under each prefix of its variants, with the flips left; no prefix short of all bits has more than `most` rows."""
    per = sum(1 for _ in _masks(BITS, half)) if half < 3 else 50_000
    k = int(np.clip(np.ceil(np.log2(max(1, n * per / (2 * piece)))), 4, 32))
    rows = fps.select("fp", F.explode(_choices(k, half)).alias("c")).select(F.lit(k).alias("depth"), F.shiftrightunsigned("fp", BITS - k).bitwiseXOR(F.col("c.m")).alias("prefix"), "fp", (half - F.col("c.r")).alias("left"))
    done, depth = [], k
    while depth < BITS:
        sizes = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col("prefix").alias("p"))
        hot = written(sizes, "hot")
        if hot.isEmpty():
            break
        # the hot prefixes are met by joins, which AQE splits, and never listed on the driver
        done.append(rows.join(hot, rows["prefix"] == hot["p"], "left_anti"))
        more = min(SPLIT_BITS, BITS - depth)
        parts = rows.join(hot, rows["prefix"] == hot["p"], "left_semi").select("prefix", "fp", "left", F.explode(_choices(more, half)).alias("c")).where(F.col("c.r") <= F.col("left"))
        low = F.shiftrightunsigned("fp", BITS - depth - more).bitwiseAND(F.lit(2**more - 1).cast("long")).bitwiseXOR(F.col("c.m"))
        depth += more
        rows = written(parts.select(F.lit(depth).alias("depth"), F.shiftleft("prefix", more).bitwiseOR(low).alias("prefix"), "fp", (F.col("left") - F.col("c.r")).alias("left")), "finer")
    return reduce(DataFrame.unionByName, [*done, rows])


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the classes of a[i] and b[i]; a label is the smallest index of its class."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        least = np.minimum(la, lb)
        np.minimum.at(label, la, least)
        np.minimum.at(label, lb, least)
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
    return label


def _forest(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after merging along the pairs (u, v), and the places of pairs that suffice for it: each class takes its first pair out, until none leads out."""
    alive, kept = np.arange(len(u)), []
    while len(alive := alive[label[u[alive]] != label[v[alive]]]):
        best = np.full(len(label), len(u))
        np.minimum.at(best, label[u[alive]], alive)
        np.minimum.at(best, label[v[alive]], alive)
        chosen = np.unique(best[best < len(u)])
        kept.append(chosen)
        label = _join_labels(label, u[chosen], v[chosen])
    return label, np.concatenate(kept) if kept else np.zeros(0, np.int64)


def meet(fps: np.ndarray, left: np.ndarray, bits: int, radius: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints (unsigned) that share all but the low `bits` bits after the flips made so far: rows (u, v) at most `radius` bits apart that connect all that collide."""
    label = np.arange(len(fps))
    found: list[np.ndarray] = []
    mask = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    todo = [(np.arange(len(fps)), fps & mask, left.astype(np.int64), bits)]
    while todo:
        own, low, r, b = todo.pop()
        if len(own) < 2:
            continue
        size = np.array([sum(_choose(b, j) for j in range(x + 1)) for x in range(int(r.max()) + 1)])[r].sum()
        if size > piece and b > 0:
            # too many at once: part by the next bit; a row reaches the other side by spending a flip
            bit = np.uint64(1 << (b - 1))
            high = (low & bit) != 0
            for side in (False, True):
                same, flip = high == side, (high != side) & (r > 0)
                at = np.concatenate([np.flatnonzero(same), np.flatnonzero(flip)])
                todo.append((own[at], low[at] & np.uint64(int(bit) - 1), np.concatenate([r[same], r[flip] - 1]), b - 1))
            continue
        values, owners = [], []
        for x in np.unique(r):
            at = np.flatnonzero(r == x)
            flips = np.array([m for m, _ in _masks(b, int(min(x, b)))], np.uint64)
            values.append((low[at][:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(own[at], len(flips)))
        v, o = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(v)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(twice):
            continue
        where = np.searchsorted(twice, v)
        where[where == len(twice)] = 0
        hit = np.flatnonzero(twice[where] == v)
        o, g = o[hit], where[hit]
        first = np.full(len(twice), len(fps))
        np.minimum.at(first, g, o)
        # deduplicated, then verified by the bits that differ
        pairs = np.unique(np.stack([o, first[g]], axis=1)[o != first[g]], axis=0)
        pairs = pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= radius]
        label, kept = _forest(label, pairs[:, 0], pairs[:, 1])
        found.append(pairs[kept])
    every = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return every[:, 0], every[:, 1]


def _choose(n: int, k: int) -> int:
    from math import comb

    return comb(n, k)


def links(fps: DataFrame, radius: int = RADIUS, piece: int = PIECE, most: int = MOST_ROWS) -> DataFrame:
    """Rows (u, v) of distinct `fp` of fps, verified to be at most `radius` bits apart, enough of them to connect all that such links connect."""
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("radius must be even: both sides flip half of it")
    n = fps.count()

    def group(table):
        import pyarrow as pa

        own = table.column("fp").to_numpy()
        u, v = meet(own.view(np.uint64), table.column("left").to_numpy(), BITS - table.column("depth")[0].as_py(), radius, piece)
        return pa.table({"u": own[u], "v": own[v]})

    return _dealt(fps, n, half, piece, most).groupBy("depth", "prefix").applyInArrow(group, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (u, root) for every vertex that is not the smallest of its component, by alternating large and small stars.

    Each round is written to the shared folder. Joins meet two written tables, so AQE can split a
    vertex with very many neighbours; nothing is gathered on the driver but a count and a checksum.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while (at := state(now)) != before and at[0]:
        before = at
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        met = large.join(small, "u")
        nxt = written(met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (now, least, large, small):
            forget(old)
        now = nxt
    return now.select("u", F.col("v").alias("root"))


def near_classes(df: DataFrame, text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, piece: int = PIECE) -> DataFrame:
    """One row per row of df: doc_id, fp (signed), sha, root (the component's smallest fp), component_id - the smallest doc_id linked to it over any number of steps.

    Null texts count as empty; texts without words have fingerprint zero and are linked by it. Null
    doc_ids are never the smallest; a component of nulls alone has a null id. Columns of df other
    than doc_id and the text are not read. An empty table gives an empty table. Texts of any length
    are read whole.
    """
    docs = written(fingerprints(df, text, shingle), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(fps, radius, piece))
    rooted = written(fps.join(roots, fps["fp"] == roots["u"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    named = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "named")
    of = written(rooted.select("fp", "root").join(named, "root").select("fp", "root", "component_id"), "component")
    return docs.join(of, "fp").select("doc_id", "fp", "sha", "root", "component_id")


def drop_near(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df, one of each component: that with the smallest doc_id (null the largest; of repeated rows with that id, one)."""
    found = written(near_classes(df, text), "near")
    hexed = found.select("doc_id", F.lower(F.hex("sha")).alias("sha"), "root")
    best = hexed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("sha"))).alias("b"))
    per = hexed.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("_n"))
    stays = best.select(F.col("b.doc_id").alias("_id"), F.col("b.sha").alias("_sha")).join(per, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("sha"))).select("_id", "_sha", "_n")
    return rows_named(df, written(stays, "stays"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
