"""Language identification with bit-sliced Bloom filters of n-grams.

Learning: over all learnable documents, hashed character trigrams are counted
by language: each task sums up what it meets, and hands on a language's sums when they
hold ``HELD`` trigrams. Spark adds them up and finds each trigram's languages; only those come to the driver.
A trigram belongs to a language where its relative frequency is at least
``SHARE`` of its highest over the languages. The languages' Bloom filters
lie side by side: slot i holds one bit for each language, so ``HASHES`` lookups
and an AND give all languages that contain a trigram at once.

Prediction: each language's popcount over a text's trigrams, less what its
filter's false positive rate explains, decides; ties go to the language with
more learned text, then by name. The score is the winner's share.

Trigrams are 62-bit hashes, so hardly any two fall together. Model size is fixed
but for the number of languages: ``SLOTS`` masks for each 64 of them. A language has at most
1 / ``LEAST_RATE`` trigrams; the driver sets their bits as they come, without keeping them.

Defined cases: null text or one without a letter is ``und`` with score 0; a
text whose letters match nothing gets the most learned language with score 0;
with nothing to learn from all is ``und``; null langs and null ids are
not learned from; repeated rows count each time; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, held_out, learnable, table

N = 3
#: Trigrams of a language that a task holds before it hands their sums on.
HELD = 1 << 17
SLOTS = 1 << 19
HASHES = 3
SHARE = 0.3
#: Trigrams rarer than this in a language's text are not taken for its own.
LEAST_RATE = 2e-6
#: Code points worked on at a time.
PIECE = 1 << 20
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Cells of the character trigrams of the lower-cased text, non-letters as one blank, in pieces."""
    for at in range(0, max(len(text), 1), PIECE):
        points = np.frombuffer(text[max(0, at - N + 1) : at + PIECE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
        points = np.where(letter, points, 32).astype(np.uint64)
        keep = np.ones(len(points), bool)
        keep[1:] = letter[1:] | letter[:-1]
        p = points[keep]
        if len(p) >= N:
            h = (p[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (p[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (p[2:] * np.uint64(0x165667B19E3779F9))
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            yield (h >> np.uint64(2)).astype(np.int64)


def _summed(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n): sums over what a task has read since it last handed a language's on."""
    held: dict[str, list[np.ndarray]] = {}
    size: dict[str, int] = {}

    def out(lang: str) -> pa.RecordBatch:
        cells, n = _summed(held.pop(lang))
        size.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(n)], ["lang", "cell", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if (t := text.as_py()) is None:
                continue
            for cells in trigrams(t):
                held.setdefault(lang, []).append(cells)
                size[lang] = size.get(lang, 0) + len(cells)
                if size[lang] >= HELD or sum(size.values()) >= 8 * HELD:
                    yield out(max(size, key=size.get))
    for lang in list(held):
        yield out(lang)


def slots_of(cells: np.ndarray) -> np.ndarray:
    """HASHES slots of each cell, from hashes of their own."""
    out = []
    for k in range(HASHES):
        h = (cells.astype(np.uint64) + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(((h ^ (h >> np.uint64(31))) & np.uint64(SLOTS - 1)).astype(np.int64))
    return np.stack(out)


class Filter:
    """Bit-sliced Bloom filters of all languages, with each one's false positive rate."""

    def __init__(self, langs: list[str], members: Iterable[np.ndarray]):
        self.langs = langs
        self.masks = np.zeros((-(-len(langs) // 64) or 1, SLOTS), np.uint64)
        for i, cells in enumerate(members):
            self.add(i, cells)
        self.settle()

    def add(self, lang: int, cells: np.ndarray) -> None:
        self.masks[lang // 64][slots_of(cells).ravel()] |= np.uint64(1 << (lang % 64))

    def settle(self) -> Filter:
        """Note each language's false positive rate, once all members are in."""
        self.false = np.array([np.mean(self.masks[i // 64] & np.uint64(1 << (i % 64)) != 0) ** HASHES for i in range(len(self.langs))])
        return self

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        total, found = 0, np.zeros(len(self.langs), np.int64)
        for cells in trigrams(text):
            total += len(cells)
            at = slots_of(cells)
            for k, row in enumerate(self.masks):
                mask = np.bitwise_and.reduce(row[at], axis=0)
                found[64 * k : 64 * k + 64] += [np.count_nonzero(mask & np.uint64(1 << i)) for i in range(len(self.langs[64 * k : 64 * k + 64]))]
        if not total:
            return self.langs[0], 0.0
        share = np.maximum(0, (found / total - self.false) / np.maximum(1e-9, 1 - self.false))
        best = int(np.argmax(share))
        return self.langs[best], float(min(1.0, share[best] / share.sum())) if share.sum() else 0.0


def members(rows: DataFrame, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, cell) of every language's own trigrams, and (lang, total) of all languages."""
    counted = rows.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = counted.mapInArrow(_counts, "lang string, cell long, n long").groupBy("cell", "lang").agg(F.sum("n").alias("n"))
    counted = Written(counted, "trigrams").df
    totals = Written(counted.groupBy("lang").agg(F.sum("n").alias("total")), "languages").df
    rated = counted.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    # A trigram's languages meet in one group: as many rows as languages have it.
    best = rated.groupBy("cell").agg(F.max("rate").alias("best"))
    own = rated.join(best, "cell").filter((F.col("rate") >= SHARE * F.col("best")) & (F.col("rate") >= LEAST_RATE))
    return own.select("lang", "cell"), totals


def learn(rows: DataFrame, lang: str = "lang", text: str = "text") -> Filter:
    """The filters of all languages of rows (null languages left out)."""
    own, totals = members(rows, lang, text)
    langs = [r["lang"] for r in totals.orderBy(F.desc("total"), "lang").collect()]
    number = {x: i for i, x in enumerate(langs)}
    model = Filter(langs, [])
    # A row a language and slice of its trigrams; bits are set as the rows come.
    parts = own.groupBy("lang", F.pmod("cell", F.lit(64)).alias("part")).agg(F.collect_list("cell").alias("cells"))
    for r in parts.select("lang", "cells").toLocalIterator():
        model.add(number[r["lang"]], np.array(r["cells"], np.int64))
    return model.settle()


def identify(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """Every row of docs with lang_pred and score (which replace columns of these names)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        return pa.array([dict(zip(("lang_pred", "score"), shared.value.predict(t.as_py()), strict=True)) for t in texts], kind)

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("_p", predicted(F.col(text))).select(*kept, "_p.lang_pred", "_p.score")


def op4(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the folds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(learnable()).select("lang", "text"))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
