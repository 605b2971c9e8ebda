import math
import re
from collections import Counter

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import quality as Q


def base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


ROWS = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one two"), (5, "a b c d e f g h " * 4), (6, " ".join(f"w{i}" for i in range(60))),
    (7, "line one here\nline one here\n \nother # * é😀 line\nline one here"), (8, " ".join(f"w{i % 25}" for i in range(200))), (9, " nbsp is no space " * 10),
    (10, " ".join(f"x{i}" for i in range(40)) + " p q r s t u v w " + " ".join(f"y{i}" for i in range(60)) + " p q r s t u v w"), (11, "same " * 50000), (6, " ".join(f"w{i}" for i in range(60))), (None, "z " * 30),
]


def test_base_matches_definition(spark):
    docs = spark.createDataFrame([(d, t, 5) for d, t in ROWS], "doc_id long, text string, kept int").repartition(3)
    out = Q.judge(docs).select("doc_id", "_n", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted(((d, *base(t)) for d, t in ROWS), key=str)


def test_ratio_rejects_odd_text_and_keeps_plain(spark):
    plain = [(i, " ".join(f"word{(i * 7 + k * k) % 50}" for k in range(80))) for i in range(200)]
    odd = [(1000 + i, " ".join(f"###%{(i + k * k) % 50}&" for k in range(80))) for i in range(10)]
    out = {r.doc_id: r for r in Q.judge(spark.createDataFrame(plain + odd, "doc_id long, text string")).collect()}
    assert all(out[i].llr > 0 for i, _ in plain) and all(out[i].llr < -1 for i, _ in odd)
    assert all(out[i].kept == (not out[i].base_failed) for i, _ in plain) and not any(out[i].kept for i, _ in odd)
    stage = Q.stage(spark, spark.createDataFrame([(d, t, "en", "s", 1) for d, t in plain + odd], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert {r.doc_id for r in stage.collect()} == {i for i, _ in plain if out[i].kept}


def test_weights_match_definition(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string")
    weights = Q.bucket_weights(docs)
    assert len(weights) == Q.BUCKETS
    # No document is trusted: every bucket has the prior alone in the target.
    scale = math.log((4 + Q.PRIOR * Q.BUCKETS) / (Q.PRIOR * Q.BUCKETS))
    assert Counter(weights) == Counter([round(1000 * scale)] * (Q.BUCKETS - 3) + [round(1000 * (math.log(Q.PRIOR / (n + Q.PRIOR)) + scale)) for n in (1, 2, 1)])


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
