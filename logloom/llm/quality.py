"""Quality rules: fixed text rules plus a hashed n-gram log-likelihood ratio (native).

Method: every document's words give hashed unigrams and bigrams. Two
multinomials over the hash buckets are counted in full, one over a trusted
target (documents that pass strict well-formedness rules) and one over the
raw corpus. A document's score is the mean log ratio over its n-grams, so it
is length-normalised, and one fixed threshold decides about every document.

Everything is DataFrame functions: two scans of the text, one small shuffle
(at most ``BUCKETS`` rows a task), no join. The bucket weights, ``BUCKETS``
integers whatever the corpus size, reach the second scan as an array literal.

Defined cases: null or empty text has no words (it fails the word minimum);
rows are judged one by one, so ties and repeated rows get equal results; an
empty table gives an empty result; other columns pass through ``judge`` and
``stage`` whatever their names, but ``judge`` puts its results in the place of columns named like them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, settled, table, unpacked

#: Characters that part words, and characters counted as symbols (fixed values).
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BUCKETS = 1 << 14
#: Added to each bucket's count in both multinomials.
PRIOR = 0.5
#: Mean log ratio under which the method rejects a document.
THRESHOLD = -0.08


def words(text: Column) -> Column:
    """Array of maximal runs without white space; empty for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    return docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t"))).withColumn("_n", F.size("_w").cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def _word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACE, ""))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _t, _w, _n and the base statistics word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    out = _with_words(docs, text)
    out = out.withColumn("_l", _lines(F.col("_t")))
    # Windows of word hashes, so each word's characters are hashed once and not eight times.
    out = out.withColumn("_u", F.transform("_w", lambda w: F.xxhash64(w)))
    u = F.col("_u")
    # Eight lookups for each window: slice() copies its whole array each time, which grows with the square of a text.
    each = F.transform(u, lambda x, i: F.xxhash64(x, *[F.get(u, i + k) for k in range(1, WINDOW)]))
    windows = F.slice(each, 1, F.greatest(F.size(u) - (WINDOW - 1), F.lit(0)))
    out = out.withColumn("_h", F.when(F.col("_n") >= WINDOW, windows))
    # Only texts that have equal windows at all are sorted: then equal hashes stand side by side.
    ranked = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_z", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked))
    z = F.col("_z")
    twice = F.filter(z, lambda e, k: (F.get(z, k - 1)["h"].eqNullSafe(e["h"])) | (F.get(z, k + 1)["h"].eqNullSafe(e["h"])))
    out = out.withColumn("_p", F.array_sort(F.transform(twice, lambda e: e["i"])))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("hit"))
    covered = F.aggregate("_p", start, lambda a, x: F.struct(x.alias("last"), (a["hit"] + F.least(F.lit(WINDOW), x - a["last"])).alias("hit")), lambda a: a["hit"])
    out = out.withColumns(
        {
            "word_chars": _word_chars(F.col("_t")).cast("long"),
            "n_symbols": _symbols(F.col("_t")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    )
    failed = (F.col("_n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n"))
    return out.withColumn("base_failed", failed)


def _grams(hashes: str) -> Column:
    """Buckets of the unigrams and bigrams of an array of word hashes."""
    u = F.col(hashes)
    ones = F.transform(u, lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int"))
    twos = F.transform(u, lambda x, i: F.pmod(F.xxhash64(x, F.get(u, i + 1)), F.lit(BUCKETS)).cast("int"))
    return F.concat(ones, F.slice(twos, 1, F.greatest(F.size(u) - 1, F.lit(0))))


def _trusted() -> Column:
    """Strict well-formedness: long enough, hardly a symbol, no repeated line, varied words, few capitals."""
    chars = F.greatest(_word_chars(F.col("_t")), F.lit(1))
    capitals = chars - F.length(F.regexp_replace(F.translate(F.col("_t"), SPACE, ""), r"\p{Lu}", ""))
    lines = F.col("_l")
    return (
        (F.col("_n") >= 50)
        & (_symbols(F.col("_t")) * 50 <= F.col("_n"))
        & (capitals * 5 <= chars)
        & (F.size(F.array_distinct("_w")) * 10 >= F.col("_n"))
        & (F.size(lines) == F.size(F.array_distinct(lines)))
    )


def bucket_weights(docs: DataFrame, text: str = "text") -> list[int]:
    """Thousandths of the log ratio of target to raw probability, for each bucket."""
    rows = _with_words(docs, text).withColumn("_l", _lines(F.col("_t"))).withColumn("_u", F.transform("_w", lambda w: F.xxhash64(w)))
    # Trust is settled before the explode, else it would be judged anew for every n-gram.
    # explode() would have the optimizer push a filter on its whole input expression into the scan.
    grams = rows.select(_trusted().alias("good"), _grams("_u").alias("g")).select("good", F.explode_outer("g").alias("b")).filter("b is not null")
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count_if("good").alias("target"))
    rows = counts.collect()  # BUCKETS at most
    raw, target = dict((r["b"], r["raw"]) for r in rows), dict((r["b"], r["target"]) for r in rows)
    mass = PRIOR * BUCKETS
    scale = math.log((sum(raw.values()) + mass) / (sum(target.values()) + mass))
    return [round(1000 * (math.log((target.get(b, 0) + PRIOR) / (raw.get(b, 0) + PRIOR)) + scale)) for b in range(BUCKETS)]


#: Columns that judge() gives beside those of the rows.
RESULTS = ("_n", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")


def judge(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of docs with the base statistics, ``llr`` (null without words) and ``kept``.

    ``kept`` is false where the base rules fail, else where the length-normalised
    log-likelihood ratio is under ``threshold``. Columns of docs named like RESULTS give way to them.
    """
    out = _judged(packed(docs, text=F.col(text)), bucket_weights(docs, text), threshold)
    return out.select(*unpacked(out, *RESULTS), *RESULTS)


def _judged(rows: DataFrame, weights: list[int], threshold: float) -> DataFrame:
    """Packed rows with their text, judged."""
    out = with_base(rows, "text").withColumn("_g", _grams("_u"))
    # Folded by the optimizer into one array literal.
    lookup = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    total = F.aggregate("_g", F.lit(0).cast("long"), lambda a, b: a + F.get(lookup, b))
    out = out.withColumn("llr", F.when(F.size("_g") > 0, total / (1000 * F.size("_g"))))
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= threshold, F.lit(False)))


def op9(spark, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules and the method keep."""
    out = settled(_judged(packed(docs, text=F.col("text")), bucket_weights(docs), THRESHOLD), "kept").filter("kept")
    return out.select(*unpacked(out))
