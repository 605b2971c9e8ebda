"""Substring dedup by hashing lines and what long lines consist of.

Units: lines; a line of over ``LONG`` words is cut at sentence ends, and a
sentence of over LONG words after a word pair whose hash is the least of the
``PIECE`` - 1 pairs before and after it, so that a shared passage yields equal
units wherever it stands and every piece has PIECE words or more. Units of any
length count, single words included. Normalised (lower case, single blanks),
they are grouped over the whole corpus by a 128-bit digest. Of each group the
occurrence with the least (doc_id, start) stays; the others are repeats. A whole line
that repeats is to be removed at any length. Parts of a line are to be removed where a
run of neighbouring repeated units holds ``RUN`` words or more: unrelated prose
shares short sentences by chance (``run=1`` takes them too). Offsets are those of the original text.

Units are cut once and written (digest, document, offsets; no text). Grouping is a
hash aggregate (a unit that a third of all documents carry is summed up in each task
first); only digests met twice or more are joined back, a join that
adaptive execution can split. Texts are never shuffled for it.

Defined cases: null or empty texts have no unit; a null doc_id ranks last;
rows that repeat a doc_id count as the same document (equal start: the same
occurrence, kept once in each row), and ``cleaned`` tells them apart by a digest of their text; ties end by start; empty tables give an
empty result; very long texts are cut as any; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, packed, table, unpacked

LONG = 24
#: Words of a unit: one at least, so only blank lines are no unit.
LEAST = 1
#: Words of a piece of a long sentence, at least.
PIECE = 5
#: Words of a run of neighbouring repeated parts of lines that is taken for a repeated passage, at least.
RUN = 12
LAST = (1 << 63) - 1
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r".+?(?:[.!?]+(?=\s)|$)", re.S)
_WORD = re.compile(r"\S+")
_FIELDS = {"doc_id": pa.int64(), "d": pa.int64(), "place": pa.int32(), "whole": pa.bool_(), "start": pa.int64(), "stop": pa.int64(), "n_words": pa.int32(), "nth": pa.int32(), "hi": pa.int64(), "lo": pa.int64()}
UNIT = "doc_id long, d long, place int, whole boolean, start long, stop long, n_words int, nth int, hi long, lo long"


def _cuts(words: list[str]) -> Iterator[int]:
    """Words after which a long sentence is cut; each depends on the PIECE words before and after it only."""
    h = [0, *(zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:], strict=False))]
    for i in range(PIECE, len(words) - PIECE):
        x = h[i]
        if x < h[i - 1] and x <= h[i + 1] and x < min(h[i - PIECE + 1 : i]) and x <= min(h[i + 1 : i + PIECE]):
            yield i


def pieces(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, normalised words) of the units of a text, blank ones included."""
    for line in _LINE.finditer(text or ""):
        words = line[0].lower().split()
        if len(words) <= LONG:
            yield line.start(), line.end(), words
            continue
        for s in _SENTENCE.finditer(text, line.start(), line.end()):
            words = s[0].lower().split()
            if len(words) <= LONG:
                yield s.start(), s.end(), words
                continue
            at = [m.span() for m in _WORD.finditer(text, s.start(), s.end())]
            if len(at) != len(words):  # lower-casing made or took white space; the words as they stand decide
                words = [text[a:b].lower() for a, b in at]
            first = 0
            for i in [*_cuts(words), len(at) - 1]:
                yield at[first][0], at[i][1], words[first : i + 1]
                first = i + 1


def _whole(text: str, start: int, end: int) -> bool:
    """Whether a unit is all of its line."""
    return (start == 0 or text[start - 1] == "\n") and (end == len(text) or text[end] == "\n")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, digests = [], []
        for doc_id, d, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            seen: Counter = Counter()
            place = 0
            text = value.as_py() or ""
            for start, end, words in pieces(text):
                if len(words) < LEAST:
                    continue
                key = xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))
                rows.append((doc_id, d, place, _whole(text, start, end), start, end, len(words), seen[key]))
                digests.append(key)
                seen[key] += 1
                place += 1
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, _FIELDS.values(), strict=False)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())], names=list(_FIELDS))


def units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every unit: its document and text digest d, place among the text's units, offsets, and nth, which counts equal units within a text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("d"), F.col(text).alias("text")).mapInArrow(_units, UNIT)


def _found(docs: DataFrame, doc_id: str, text: str, run: int) -> DataFrame:
    """The unit rows to remove, with kept (rank of the document that keeps the unit) and kept_start."""
    every = Written(units(docs, doc_id, text), "units").df
    rank = F.coalesce("doc_id", F.lit(LAST))
    first = F.when(F.col("nth") == 0, rank)
    groups = every.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("kept"), F.min_by("start", first).alias("kept_start"))
    groups = Written(groups.filter("n > 1").drop("n"), "repeated-units").df
    found = every.join(groups, ["hi", "lo"]).filter(~((rank == F.col("kept")) & (F.col("nth") == 0))).drop("hi", "lo")
    if run <= LEAST:
        return found
    # Neighbours: places without a gap. A group is one text's repeated units.
    text_rows = W.partitionBy("doc_id", "d")
    found = found.withColumn("island", F.col("place") - F.dense_rank().over(text_rows.orderBy("place")))
    held = F.sum("n_words").over(W.partitionBy("doc_id", "d", "island"))
    return found.withColumn("held", held).filter(F.col("whole") | (F.col("held") >= run))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """A row for each occurrence to remove: doc_id, start, stop, n_words, kept_doc_id, kept_start."""
    kept_id = F.when(F.col("kept") == LAST, F.lit(None)).otherwise(F.col("kept")).cast("long")
    return _found(docs, doc_id, text, run).select("doc_id", "start", "stop", "n_words", kept_id.alias("kept_doc_id"), "kept_start")


def _without(text: str | None, spans: list[dict] | None) -> str | None:
    out, at = [], 0
    for s in spans or []:
        out.append(text[at : s["start"]])
        at = s["stop"]
    return text if not spans else "".join([*out, text[at:]])


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """Every row of docs with ``text_kept`` and ``removed`` (sorted spans of the original text); columns of these names give way.

    Spans come back by doc_id and text digest, so a row never gets those of another text with its id.
    """
    spans = _found(docs, doc_id, text, run).groupBy("doc_id", "d").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("removed"))
    rows = packed(docs, i=F.col(doc_id).cast("long"), e=F.xxhash64(F.col(text)), text=F.col(text))
    out = rows.join(spans, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("e") == F.col("d")), "left")

    @F.arrow_udf("string")
    def kept(texts: pa.Array, removed: pa.Array) -> pa.Array:
        return pa.array([_without(t.as_py(), s.as_py()) for t, s in zip(texts, removed, strict=True)], pa.string())

    return out.select(*unpacked(out, "text_kept", "removed"), kept("text", "removed").alias("text_kept"), "removed")


def op6(spark, sf_dir: str) -> DataFrame:
    """Repeated lines, sentences and passage pieces of all documents, with the occurrence that stays."""
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
