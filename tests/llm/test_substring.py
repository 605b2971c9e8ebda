import random

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import substring as S

RNG = random.Random(11)
word = lambda: "".join(RNG.choice("abcdefghij") for _ in range(5))
PASSAGE = " ".join(word() for _ in range(60))
LINE = "one Two three  four five six"
ROWS = [
    (3, f"intro {word()} {PASSAGE} outro {word()}\n{LINE}"),
    (1, f"{word()} {word()}. {PASSAGE}. {word()}\nshort line"),
    (2, "\n".join([LINE.upper(), "short line", LINE, "own words of this text alone é"])),
    (4, None),
    (5, ""),
    (6, " \n \n"),
    (7, "A sentence of some words here. " * 3 + " ".join(word() for _ in range(40))),
    (8, " ".join(word() for _ in range(200000))),
    (None, LINE),
    (2, "\n".join([LINE.upper(), "short line", LINE, "own words of this text alone é"])),
]


def expected():
    found = {}
    for d, t in ROWS:
        for start, end, words in S.pieces(t):
            if len(words) >= S.LEAST:
                found.setdefault(" ".join(words), []).append((S.LAST if d is None else d, start, end))
    out = []
    for spans in found.values():
        first = min(spans)[:2]
        out += [(None if d == S.LAST else d, s, e, None if first[0] == S.LAST else first[0], first[1]) for d, s, e in spans if len(spans) > 1 and (d, s) != first]
    return sorted(out, key=str)


def test_repeats_match_brute_force(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in ROWS], "doc_id long, text string, start int").repartition(4)
    got = sorted(((r.doc_id, r.start, r.stop, r.kept_doc_id, r.kept_start) for r in S.repeats(docs).collect()), key=str)
    assert got == expected()
    assert sum(e - s for d, s, e, *_ in got if d == 3) > 0.6 * len(PASSAGE)
    assert not any(d in (7, 8) for d, *_ in got if d == 8)


def test_pieces_cover_words_in_order():
    for _, t in ROWS:
        at = 0
        for start, end, words in S.pieces(t):
            assert start >= at and t[start:end].lower().split() == words
            at = end


def test_short_lines_and_short_pieces_are_grouped(spark):
    docs = spark.createDataFrame([(1, "short line\nother"), (2, "own\nShort  line\nother"), (3, " \n\n ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.start, r.stop, r.n_words) for r in S.repeats(docs).collect()) == [(2, 4, 15, 2), (2, 16, 21, 1)]
    # The pieces that two long sentences share hold all of the shared words but those near its ends.
    long = [" ".join([*(word() for _ in range(30)), PASSAGE, *(word() for _ in range(30))]) for _ in range(2)]
    for text in long:
        assert min(len(w) for _, _, w in S.pieces(text)) >= S.PIECE
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    assert sum(r.n_words for r in S.repeats(docs).collect()) >= 60 - 4 * S.PIECE


def test_cleaned_text(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = {r.doc_id: r for r in S.cleaned(docs).collect()}
    assert out[None].text_kept == "" and out[4].text_kept is None
    assert LINE not in out[2].text_kept.split("\n")[2:] and "own words" in out[2].text_kept
    for r in out.values():
        if r.removed:
            assert len(r.text_kept) == len(r.text) - sum(s.stop - s.start for s in r.removed)


def test_empty_table(spark):
    assert S.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
