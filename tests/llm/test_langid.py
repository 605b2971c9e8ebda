import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import langid as L

EN = "the quick brown fox jumps over the lazy dog and then the other thing was there with them "
FR = "le renard brun saute par-dessus le chien paresseux et puis les autres étaient là avec eux "


def test_learns_and_predicts(spark):
    rows = spark.createDataFrame([("en", EN), ("fr", FR), (None, "zzz"), ("en", None), ("en", "")] * 3, "lang string, text string")
    model = L.learn(rows)
    assert sorted(model.langs) == ["en", "fr"]
    docs = [(1, "the dog was there", 0), (2, "les autres chiens étaient là", 0), (3, None, 0), (4, "", 0), (5, "123 ###", 0), (6, "qqq", 0), (7, EN * 20000, 0), (7, EN, 0)]
    out = L.identify(spark.createDataFrame(docs, "doc_id long, text string, score int"), model).collect()
    assert [r.lang_pred for r in out] == ["en", "fr", "und", "und", "und", model.langs[0], "en", "en"]
    assert all(0 <= r.score <= 1 for r in out) and out[2].score == 0


def test_bitmask_finds_every_member_language():
    import numpy as np

    a, b = np.arange(0, 500), np.arange(250, 900)
    f = L.Filter(["a", "b"], [a, b])
    mask = np.bitwise_and.reduce(f.masks[0][L.slots_of(np.arange(250, 500))], axis=0)
    assert (mask == 3).all() and (f.false < 0.01).all()


def test_many_languages_use_more_slices(spark):
    import numpy as np

    f = L.Filter([f"l{i}" for i in range(70)], [np.arange(i * 10, i * 10 + 10) for i in range(70)])
    assert f.masks.shape[0] == 2 and (np.bitwise_and.reduce(f.masks[1][L.slots_of(np.arange(690, 700))], axis=0) == 1 << 5).all()


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "lang string, text string")
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    assert [r.lang_pred for r in L.identify(docs, L.learn(none)).collect()] == ["und"]
    assert L.identify(docs.limit(0), L.learn(none)).count() == 0
