"""Columns named like internal ones, repeated ids with texts of their own, and null ids, in every stage that carries rows through."""

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import mixing, quality, secrets, simhash, substring

WORDS = " ".join(f"word{i} of line{i % 7}" for i in range(40))
KIND = "doc_id long, text string, lang string, source string, n_chars long, _d int, _spans string, _t int, kept string, whole int, rest int, language string, origin string, key int, r string, llr int"
MORE = (1, "s", 2, "k", 3, 4, "l", "o", 5, "r", 6)


def _docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), *MORE) for d, t, s in rows], KIND)


def test_rows_that_repeat_an_id_stay_where_texts_differ(spark):
    docs = _docs(spark, [(5, WORDS, "a1"), (5, "quite another text with other words in it", "a1"), (5, WORDS, "a1"), (6, WORDS, "a1"), (None, WORDS, "a1"), (None, "x", "a1")])
    out = simhash.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(5, WORDS), (5, "quite another text with other words in it"), (None, WORDS), (None, "x")], key=str)


def test_stages_carry_any_column(spark):
    docs = _docs(spark, [(1, WORDS + " password = hunter2secret", "a1"), (2, WORDS + " tail", "b2"), (None, None, None), (2, "", "b2")])
    for stage in (quality.stage, secrets.stage):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and all(r.whole == 3 and r.r == "r" for r in out.collect())
    assert "[SECRET]" in {r.doc_id: r.text for r in secrets.stage(spark, docs.filter("doc_id = 1"), "").collect()}[1]
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "domain", "epoch", "tokens"] and all(r.rest == 4 and r.language == "l" for r in mixed.collect())
    judged = quality.judge(docs)
    assert judged.columns[-2:] == ["llr", "kept"] and [c for c in judged.columns if c == "kept"] == ["kept"]


def test_ends_are_sought_in_small_buckets(spark, monkeypatch):
    rows = [(i, "w " * (i % 7 + 1), "en", "src1") for i in range(300)] + [(7, "w " * 8, "en", "src1")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted((r.doc_id, r.epoch, r.tokens) for r in mixing.mix(docs, budget_share=0.6).collect())
    monkeypatch.setattr(mixing, "ENOUGH", 1)
    assert sorted((r.doc_id, r.epoch, r.tokens) for r in mixing.mix(docs, budget_share=0.6).collect()) == want
    assert 0 <= 0.6 * sum(len(t.split()) for _, t, *_ in rows) - sum(n for *_, n in want) < 9


def test_spans_go_back_to_their_own_text(spark):
    line = "a line of some words that stands in two texts and more"
    docs = spark.createDataFrame([(None, f"first\n{line}"), (None, f"ABCDEFGHIJKLMNOPQRSTUVWXYZ{line}\nown"), (1, line)], "doc_id long, text string")
    out = {r.text: r.text_kept for r in substring.cleaned(docs).collect()}
    assert out[f"first\n{line}"] == "first\n" and out[f"ABCDEFGHIJKLMNOPQRSTUVWXYZ{line}\nown"].startswith("ABCDEFGHIJ") and out[line] == line


def test_short_sentences_count_in_runs_only(spark):
    a = "Yes it is. " + " ".join(f"alpha{i}" for i in range(30))
    b = "Yes it is. " + " ".join(f"beta{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert substring.repeats(docs).count() == 0 and [r.n_words for r in substring.repeats(docs, run=1).collect()] == [3]


def test_many_secrets_in_one_text(spark):
    text = " ".join(f"token={i:06d}x" for i in range(700))
    got = secrets.scan(_docs(spark, [(1, text, "a1")])).first()
    assert [text[s.start : s.end] for s in got["_base"]] == text.split(" ")
