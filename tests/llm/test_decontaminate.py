import hashlib
import random
import re

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import decontaminate as D


def brute(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    w, hit, ids = find(text), set(), set()
    for item_id, t in items:
        v = find(t)
        m = min(10, len(v))
        for i in range(len(v) - m + 1 if v else 0):
            for k in range(len(w) - m + 1):
                if w[k : k + m] == v[i : i + m]:
                    hit |= set(range(k, k + m))
                    ids.add(item_id)
    named = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


def _case():
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("a B c9 dé E-f g").strip() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 30]) + 2)) for i in range(30)] + [(99, None), (98, ""), (3, "a b c9 g a b c9 g"), (None, "only here now")]
    docs = [(i, text(rng.choice([0, 1, 5, 200]))) for i in range(30)] + [(50, None), (51, ""), (52, "x only HERE now, y"), (52, items[4][1]), (53, items[7][1] + " tail"), (54, "word " * 30000)]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 24, 100])
def test_matches_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(D, "BLOCK_BYTES", block_bytes)
    docs, items = _case()
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, n_items long")
    out = D.scan(df, spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out.collect()))
    assert got == sorted((d, *brute(t, items)) for d, t in docs)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in D.scan(docs, none).collect()] == [0]
    assert D.scan(docs.limit(0), none).count() == 0
