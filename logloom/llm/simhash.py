"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: whole texts, A-Z lower-cased, words without white space,
three-word shingles, XXH64 with seed 42; a bit is 1 where over half of the
shingle hashes have it. Two fingerprints link at ``RADIUS`` or fewer
differing bits.

Search. Distinct fingerprints are dealt into buckets: of the 64 bits in
RADIUS + 1 blocks, a linked pair agrees on one whole block at least, so it
meets in one bucket at least. A bucket with more than ``LEAF`` fingerprints
is not worked on but dealt again by blocks of its remaining bits, until it
fits. That ends: with 12 bits left it has 4096 members at most. So no task
ever holds more than LEAF fingerprints of a bucket, however hot, and nothing
is dropped. Within a bucket, members are sorted by Gray rank and cut into runs;
a node keeps the bits that its whole run shares (mask and pattern), upper nodes
what their children share. Pairs of nodes are walked from the root; a pair's
differences on the shared bits accumulate downwards, and a pair of groups is
left as soon as they exceed the radius. Groups so alike that all their
members must link are joined without being opened. A bucket yields a spanning
forest, never all its pairs.

Components: min-label rounds over the forest edges (large star, small star), each
written to the shared folder, joined with components of exact copies by the
fingerprint. Only links of distinct fingerprints are moved, never texts.

Defined cases: null, empty or blank text has fingerprint zero and links like
any other; repeated rows fall into one component; a null doc_id is a row
that counts for nobody's component_id (null if its whole component has none); an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, packed, table, unpacked

RADIUS = 3
SHINGLE = 3
SEED = 42
LEAF = 4096
FANOUT = 8
#: Node pairs expanded at a time within a task.
FRONTIER = 1 << 14


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), SEED) for s in zip(*(found[k:] for k in range(SHINGLE)), strict=False)]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[k : k + (1 << 15)], np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long), one row for each row of docs."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """Place of a bit pattern in the Gray sequence (prefix XOR of its bits)."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def _blocks(bits: list[int]) -> list[list[int]]:
    """RADIUS + 1 runs of the given bits, as even as they come."""
    return [x.tolist() for x in np.array_split(bits, RADIUS + 1) if len(x)]


def _number(path: list[int]) -> int:
    """A path as one number."""
    out = 0
    for n in path:
        out = out * (RADIUS + 2) + n + 1
    return out


def _split(spread: DataFrame, paths: list[list[int]]) -> DataFrame:
    """Deals fingerprints anew: for each path (the blocks taken so far, as block numbers) the bits left give RADIUS + 1 keys.

    ``path`` names the bits that a bucket has in common, ``key`` their values (the other bits zero).
    """
    of_path = None
    for path in paths:
        left, taken = list(range(64)), 0
        for n in path:
            block = _blocks(left)[n]
            left = [b for b in left if b not in block]
            taken |= sum(1 << b for b in block)
        dealt = []
        for n, block in enumerate(_blocks(left)):
            mask = taken | sum(1 << b for b in block)
            signed = mask - (1 << 64) if mask >> 63 else mask
            dealt.append(F.struct(F.lit(_number([*path, n])).cast("long").alias("path"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("key")))
        case = F.col("path") == _number(path)
        of_path = F.when(case, F.array(*dealt)) if of_path is None else of_path.when(case, F.array(*dealt))
    return spread.select("fp", F.explode_outer(of_path).alias("d")).select("fp", "d.path", "d.key")


def _runs(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _grid(a: np.ndarray, b: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (a, b), ordered pairs once; and which pair each came from."""
    cells = count[a] * count[b]
    source = np.repeat(np.arange(len(a)), cells)
    at = np.arange(len(source)) - np.repeat(np.cumsum(cells) - cells, cells)
    x = first[a[source]] + at // count[b[source]]
    y = first[b[source]] + at % count[b[source]]
    keep = x <= y
    return x[keep], y[keep], source[keep]


class _Forest:
    """Least reachable index of each of n items, under links that come in lots."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            if not len(a):
                return
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def linked(keys: np.ndarray, fps: np.ndarray) -> _Forest:
    """Forest over fingerprints sorted by bucket and Gray rank; only members of one bucket are compared."""
    n, forest = len(fps), _Forest(len(fps))
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if n else np.zeros(0, np.int64)
    # Level 0 holds the fingerprints, level k + 1 runs of FANOUT nodes of level k of one bucket, the last level a root for each bucket.
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    levels = [{"mask": np.full(n, full), "bits": fps, "low": np.arange(n), "high": np.arange(n) + 1}]
    start = heads
    while n and len(levels[-1]["bits"]) > len(start):
        below = levels[-1]
        size = len(below["bits"])
        place = np.arange(size) - np.repeat(start, _runs(start, size))
        cut = np.flatnonzero(place % FANOUT == 0)
        both, some = np.bitwise_and.reduceat(below["bits"], cut), np.bitwise_or.reduceat(below["bits"], cut)
        mask = np.bitwise_and.reduceat(below["mask"], cut) & ~(both ^ some)
        levels.append({"mask": mask, "bits": both & mask, "first": cut, "count": _runs(cut, size), "low": below["low"][cut], "high": below["high"][np.append(cut[1:], size) - 1]})
        start = np.searchsorted(cut, start)
    if len(levels) == 1:
        return forest
    roots = np.flatnonzero(levels[-1]["high"] - levels[-1]["low"] > 1)
    zero = np.zeros(len(roots), np.int64)
    todo = [(len(levels) - 1, roots, roots, np.zeros(len(roots), np.uint64), zero)]
    while todo:
        k, a, b, known, differ = todo.pop()
        if len(a) > FRONTIER:
            todo += [(k, a[i : i + FRONTIER], b[i : i + FRONTIER], known[i : i + FRONTIER], differ[i : i + FRONTIER]) for i in range(0, len(a), FRONTIER)]
            continue
        x, y, source = _grid(a, b, levels[k]["first"], levels[k]["count"])
        level = levels[k - 1]
        shared = level["mask"][x] & level["mask"][y]
        fresh = shared & ~known[source]
        differ = differ[source] + np.bitwise_count((level["bits"][x] ^ level["bits"][y]) & fresh)
        near = differ <= RADIUS
        if k == 1:
            near &= x < y
            forest.link(x[near], y[near])
            continue
        x, y, shared, differ = x[near], y[near], shared[near], differ[near]
        # All members differ by this much at most: then all link, and no level below need be seen.
        sure = differ + 64 - np.bitwise_count(shared) <= RADIUS
        for i in np.flatnonzero(sure):
            own = np.r_[level["low"][x[i]] : level["high"][x[i]], level["low"][y[i]] : level["high"][y[i]]]
            forest.link(np.full(len(own) - 1, own[0]), own[1:])
        same = (x == y) & (level["high"][x] - level["low"][x] == 1)
        rest = ~sure & ~same
        if rest.any():
            todo.append((k - 1, x[rest], y[rest], shared[rest], differ[rest]))
    return forest


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning-forest edges of complete buckets; rows come sorted by bucket and Gray rank."""
    held_k, held_f, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def done(keys, fps, paths):
        new = np.append(True, (keys[1:] != keys[:-1]) | (paths[1:] != paths[:-1])) if len(keys) else np.zeros(0, bool)
        bucket = np.cumsum(new)
        root = linked(bucket, fps.view(np.uint64)).root
        out = np.flatnonzero(root != np.arange(len(root)))
        u, v = fps[out], fps[root[out]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    for b in batches:
        keys = np.append(held_k, b.column("key").to_numpy(zero_copy_only=False))
        fps = np.append(held_f, b.column("fp").to_numpy(zero_copy_only=False))
        paths = np.append(held_p, b.column("path").to_numpy(zero_copy_only=False))
        ends = np.flatnonzero((keys[1:] != keys[:-1]) | (paths[1:] != paths[:-1]))
        end = int(ends[-1]) + 1 if len(ends) else 0
        if end:
            yield done(keys[:end], fps[:end], paths[:end])
        held_k, held_f, held_p = keys[end:], fps[end:], paths[end:]
    if len(held_k):
        yield done(held_k, held_f, held_p)


def links(distinct: DataFrame, leaf: int = LEAF) -> DataFrame:
    """Edges (u, v), u > v, whose components are those of all pairs within RADIUS; distinct has one row for each fp."""
    spread = distinct.select("fp", F.lit(0).cast("long").alias("path"))
    paths: list[list[int]] = [[]]
    found = None
    while True:
        dealt = _split(spread, paths)
        counts = dealt.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"))
        hot = counts.filter(F.col("n") > leaf).select("path", "key")
        # At the first level there are 4 x 65,536 buckets at most, so this list is short; deeper it may be long and stays distributed.
        hot = Written(hot, "simhash-hot")
        cold = dealt.join(hot.df, ["path", "key"], "left_anti") if hot.rows else dealt
        sized = cold.withColumn("rank", gray_rank(F.col("fp"))).repartition("path", "key").sortWithinPartitions("path", "key", "rank")
        edges = sized.select("path", "key", "fp").mapInArrow(_edges, "u long, v long")
        found = edges if found is None else found.unionByName(edges)
        if not hot.rows:
            return found
        spread = dealt.join(hot.df, ["path", "key"], "left_semi").select("fp", "path").distinct()
        paths = [[*p, n] for p in paths for n in range(RADIUS + 1)]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable over edges (u, v), for every node that has one; rounds of large and small stars."""
    now = Written(edges.filter("u <> v").distinct(), "stars", mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    while True:
        if not now.rows:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode_outer(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        step = small.select("e.u", "e.v").filter("u <> v").distinct()
        new = Written(step, "stars", mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        same = new.rows == now.rows and new.metrics["mark"] == now.metrics["mark"]
        now.drop()
        now = new
        if same:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _classes(prints: DataFrame, leaf: int) -> DataFrame:
    """fp, root and component_id of every fingerprint; prints has doc_id and fp."""
    distinct = Written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct").df
    rooted = components(links(distinct, leaf))
    of_fp = distinct.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = of_fp.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return of_fp.join(of_root, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", leaf: int = LEAF) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row of docs."""
    prints = Written(fingerprints(docs, doc_id, text), "fingerprints").df
    return prints.join(_classes(prints, leaf).drop("root"), "fp").select("doc_id", "fp", "component_id")


def op1(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.fromiter((fingerprint(t.as_py()) for t in b.column(3)), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(values.view(np.int64))], ["doc_id", "h1", "h2", "fp"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the least (doc_id, digest of the row) stays; rows without an id all stay.

    Rows are judged one by one, so rows that repeat a doc_id with texts of
    their own stay where their components differ. Of rows equal in all columns one stays. Columns of any
    name pass through; those of a map type do not count in the digest.
    """
    hashed = [F.col(f"`{n}`") for n, t in docs.dtypes if "map<" not in t and "variant" not in t]
    rows = packed(docs, doc_id=F.col("doc_id").cast("long"), h1=F.xxhash64(*hashed), h2=F.xxhash64(F.lit(1), *hashed))
    known = rows.filter("doc_id is not null")
    prints = Written(known.select("doc_id", "h1", "h2", F.col("r.text").alias("text")).mapInArrow(_keyed, "doc_id long, h1 long, h2 long, fp long"), "fingerprints").df
    # Copies are summed up in each task before a group is moved.
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("k"))
    stay = least.join(_classes(prints, LEAF), "fp").groupBy("root").agg(F.min("k").alias("k")).select("k.*")
    stay = Written(stay, "survivors").df
    kept = known.join(stay, ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "doc_id"])
    return kept.select(*unpacked(kept)).unionByName(docs.filter("doc_id is null"))
