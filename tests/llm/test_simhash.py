import random
import re

import numpy as np
import pytest
import xxhash

pytest.importorskip("logloom.llm")
from logloom.llm import simhash as S


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return [(d, p, min((x for x in least[find(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def test_fingerprint_matches_definition():
    for t in (None, "", " \n", "One", "One two", "A b C d\x0be F", "Él été x y z", "x " * 5000):
        assert S.fingerprint(t) == brute_fingerprint(t)


@pytest.mark.parametrize("n,flips", [(1, 1), (3000, 2), (700, 6)])
def test_forest_has_the_components_of_all_pairs(n, flips):
    rng = random.Random(n)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < n:
        f = rng.choice([base, rng.getrandbits(64)])
        for _ in range(rng.randint(0, flips)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    rank = lambda f: S_rank(f)
    fps = np.array(sorted(fps, key=rank), np.uint64)
    got = S.linked(np.zeros(len(fps), np.int64), fps).root
    want = S._Forest(len(fps))
    for i in range(len(fps)):
        near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3)
        want.link(np.full(len(near), i), near)
    assert np.array_equal(got, want.root)


def S_rank(f):
    for k in (1, 2, 4, 8, 16, 32):
        f ^= f >> k
    return f


def _rows():
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr st".split()) + str(rng.randrange(40))
    rows, texts = [], []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.choice([1, 2, 5, 120])))
        texts.append(t)
        rows.append((i, t))
    for i in range(60, 180):
        w = rng.choice(texts).split()
        if len(w) > 50:
            w[rng.randrange(len(w))] = "other"
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \t"), (7, rows[7][1]), (None, rows[9][1]), (503, "Z" * 100000)]


@pytest.mark.parametrize("leaf", [4096, 8])
def test_components_match_brute_force(spark, leaf):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string").repartition(5)
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in S.near_duplicates(docs, leaf=leaf).collect()), key=str)
    assert got == sorted(brute_components(rows), key=str)


def test_stage_keeps_one_of_each_group_and_rows_without_id(spark):
    rows = _rows()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = S.stage(spark, docs, "")
    assert out.columns == docs.columns
    want = sorted({c for d, _, c in brute_components(rows)})
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0
