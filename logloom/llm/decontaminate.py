"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words: A-Z lower-cased, runs of digits, letters and non-ASCII characters. A
pattern is a window of ``WINDOW`` consecutive words of a benchmark item (the
whole item where it has fewer). The symbols of the search are words: for the
patterns of one length, a shift table over blocks of ``BLOCK`` words tells how
far a scan may jump when a block ends at its position; a shift of zero leads to
the bucket of that suffix block, whose patterns are compared word by word.

The patterns of at most ``BLOCK_BYTES`` of item text are broadcast at a time;
a larger benchmark is searched in blocks of items, one scan of the documents each,
and the hits of the blocks (only of documents that have any) are merged by
document and text digest. Documents are never shuffled.

Defined cases: null or empty texts have no words, hence no hit; null item
texts give no pattern; repeated items count once (by item_id); a null item_id gives
patterns that hit words but are named nowhere; repeated document rows are
judged alike; empty tables give an empty result or no hit; documents of any
length are scanned whole; other columns are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, table

WINDOW = 10
BLOCK = 2
#: Item text that is broadcast at a time.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of a text; every byte of a non-ASCII character is a word byte."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class WuManber:
    """Shift tables and suffix buckets for patterns of words, grouped by pattern length."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        owners: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item_id, text in items:
            w = words(text)
            for i in range(max(1, len(w) - WINDOW + 1) if w else 0):
                owners[tuple(w[i : i + WINDOW])].add(item_id)
        by_length: dict[int, list] = defaultdict(list)
        for pattern, ids in owners.items():
            by_length[len(pattern)].append((pattern, frozenset(ids)))
        self.sets = []
        for m, patterns in sorted(by_length.items()):
            b = min(BLOCK, m)
            shift, bucket = {}, defaultdict(list)
            for pattern, ids in patterns:
                for end in range(b, m + 1):
                    block = pattern[end - b : end]
                    shift[block] = min(shift.get(block, m - b + 1), m - end)
                bucket[pattern[m - b :]].append((pattern, ids))
            self.sets.append((m, b, shift, dict(bucket)))

    def search(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit word ranges (merged, end exclusive) and ids of the items that have an occurrence."""
        hits, ids, n = [], set(), len(w)
        for m, b, shift, bucket in self.sets:
            far = m - b + 1
            jump = shift.get
            blocks = list(zip(*(w[k:] for k in range(b)), strict=False))
            end = m
            while end <= n:
                block = blocks[end - b]
                step = jump(block, far)
                if step:
                    end += step
                    continue
                here = tuple(w[end - m : end])
                for pattern, owners in bucket[block]:
                    if pattern == here:
                        hits.append((end - m, end))
                        ids |= owners
                end += 1
        return merged(hits), ids


def merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def summary(n_words: int, ranges, ids) -> tuple:
    named = sorted(i for i in ids if i is not None)
    hit = sum(b - a for a, b in merged(ranges))
    return n_words, hit, len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), hit > 0


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
_PARTIAL = pa.struct([("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("ids", pa.list_(pa.string()))])


def _item_blocks(items: DataFrame) -> list[DataFrame]:
    """The items in pieces of at most about BLOCK_BYTES of text."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = -(-size // BLOCK_BYTES) or 1
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def scan(docs: DataFrame, items: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Every row of docs with n_words, n_hit, n_items, items_sha256 and contaminated (names after prefix).

    Columns of docs that have these names give way to the results.
    """
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    blocks = _item_blocks(items)
    names = [f.split()[0] for f in RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in [prefix + n for n in names]]
    if len(blocks) == 1:
        shared = spark.sparkContext.broadcast(WuManber([tuple(r) for r in blocks[0].collect()]))

        @F.arrow_udf(RESULT)
        def judged(texts: pa.Array) -> pa.Array:
            rows = []
            for t in texts:
                w = words(t.as_py())
                rows.append(dict(zip(names, summary(len(w), *shared.value.search(w)), strict=True)))
            return pa.array(rows, _RESULT)

        out = docs.withColumn("_r", judged(F.col(text)))
        return out.select(*kept, *(F.col(f"_r.{x}").alias(prefix + x) for x in names))
    # Larger benchmarks: one pass a block keeps the hits of the documents that have some; the last pass sums up.
    keyed = docs.withColumn("_k", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    parts = None
    for block in blocks:
        found = Written(_partial(keyed.select("_k", F.col(text).alias("t")), WuManber([tuple(r) for r in block.collect()])), "hits").df
        parts = found if parts is None else parts.unionByName(found)
    whole = parts.groupBy("_k").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))

    @F.arrow_udf(RESULT)
    def summed(texts: pa.Array, hits: pa.Array) -> pa.Array:
        rows = []
        for t, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
            rows.append(dict(zip(names, summary(len(words(t)), zip(h["a"] or [], h["b"] or [], strict=True), h["ids"] or []), strict=True)))
        return pa.array(rows, _RESULT)

    out = keyed.join(whole, "_k", "left").withColumn("_r", summed(F.col(text), F.struct("a", "b", "ids")))
    return out.select(*kept, *(F.col(f"_r.{x}").alias(prefix + x) for x in names))


def _partial(keyed: DataFrame, patterns: WuManber) -> DataFrame:
    shared = keyed.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ranges, ids = shared.value.search(words(t.as_py()))
                if ranges:
                    out.append({"_k": k, "a": [a for a, _ in ranges], "b": [b for _, b in ranges], "ids": sorted(i for i in ids if i is not None)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("_k", pa.string()), *_PARTIAL]))

    return keyed.mapInArrow(run, "_k string, a array<long>, b array<long>, ids array<string>").distinct()


def op2(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark items."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a hit stay."""
    out = scan(docs, table(spark, sf_dir, "benchmark"), prefix="_")
    return out.filter("not _contaminated").select(*docs.columns)


#: The same definition in SQL: windows of every length that an item has, equal windows joined.
ORACLE = r"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM i WHERE len(w) > 0)),
ps AS (SELECT DISTINCT m, s FROM p), ms AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m)),
h AS (SELECT x.doc_id, x.m, x.k, x.s FROM x JOIN ps USING (m, s)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS pos FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT h.doc_id, p.item_id FROM h JOIN p USING (m, s)) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
