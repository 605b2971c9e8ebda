import random

import pytest

pytest.importorskip("logloom.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from .test_decontaminate import brute as contamination  # noqa: E402
from .test_mixing import brute as mixture  # noqa: E402
from .test_secrets import base, token  # noqa: E402
from .test_simhash import brute_components  # noqa: E402

from logloom.llm import secrets as S  # noqa: E402


def _docs():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ra", "lo", "mi", "te", "su", "ka"]) for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, text(150), rng.choice(["en", "fr", None]), f"src{i % 5}"))
    rows += [(100 + i, rows[i][1] + " more", "en", "src1") for i in range(10)]
    rows += [(200, text(5), "en", "src0"), (201, "again and " * 60, "en", "src0"), (202, None, "en", "src0"), (203, "", "en", None)]
    item = text(12)
    rows += [(300, text(100) + " " + item + " " + text(20), "en", "src2"), (301, text(80) + " token=abcdef123456 " + text(40), "en", "src3")]
    return [(*r, len(r[1] or "")) for r in rows], [(1, item), (2, text(30))]


def _write(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_run_matches_brute_force(spark, tmp_path):
    docs, items = _docs()
    _write(spark, tmp_path, docs, items)
    out = pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in docs if r[0] not in (200, 201, 202, 203)]
    first = pipeline.STAGES[0][1](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r.doc_id for r in first.collect()) == sorted(r[0] for r in good)
    stay = {c for _, _, c in brute_components([(r[0], r[1]) for r in good])}
    good = [r for r in good if r[0] in stay and not contamination(r[1], items)[4]]
    owners = {}
    for r in good:
        for x in token(r[1]):
            owners.setdefault(x[3], set()).add(r[3])
    rows = []
    for d, t, lang, source, _ in good:
        spans = sorted(base(t) + [x[:3] for x in token(t) if len(owners[x[3]]) <= S.MAX_OWNERS])
        at, text = 0, ""
        for a, _, b in spans:
            if a >= at:
                text += t[at:a] + "[SECRET]"
            at = max(at, b)
        rows.append((d, text + t[at:], lang, source))
    assert sorted(((r.doc_id, r.domain, r.epoch, r.tokens) for r in out), key=str) == mixture(rows)
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r.doc_id] == r.text and r.n_chars == len(r.text) for r in out)


def test_empty_documents(spark, tmp_path):
    _write(spark, tmp_path, [], [])
    assert pipeline.run(spark, str(tmp_path)).count() == 0
