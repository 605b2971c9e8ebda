import random

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import toxicity as T


def _rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = [rng.choice("alpha beta gamma delta house river stone cloud".split()) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            w[rng.randrange(40)] = rng.choice(["idiot", "blarghest", "blarghing", "moron"])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    train, test = _rows(400, 1), _rows(100, 2)
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model, labels = T.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    extra = [(1000, None, 0), (1001, "", 0), (1002, "stone " * 100000, 0), (None, "idiot", 1), (3, test[3][1], 0)]
    out = T.score(spark.createDataFrame([(d, t, 9) for d, t, _ in test + extra], "doc_id long, text string, labels int"), model).collect()
    right = sum(r.predicted == y for r, (_, _, y) in zip(out, test, strict=False))
    assert right >= 98 and len(out) == 105
    assert out[100].score == out[101].score and all(0 <= r.score <= 1 for r in out)
    assert labels.posterior((1, 1, 1, 1, -1, -1)) > 0.5 > labels.posterior((0, 0, 0, -1, -1, -1))


def test_lexicons_and_labels_of_all_rows_count_whatever_the_sample(spark):
    train = _rows(400, 1)
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int").repartition(3)
    seen = []
    for sample in (40, 400):
        scorer, labels = T.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), sample)
        seen.append((scorer.voters.words, scorer.voters.beginnings, labels.prior))
    assert seen[0][:2] == seen[1][:2] and abs(seen[0][2] - 0.2) < 1e-6
    assert {"blarghest", "blarghing"} <= seen[0][0] and "blarg" in seen[0][1]


def test_correlated_voters_share_a_table(spark):
    counts = {((1, 1, 0, -1, -1, -1), 1): 40, ((0, 0, 0, -1, -1, -1), 1): 40, ((0, 0, 0, -1, -1, -1), 0): 400, ((1, 1, 0, -1, -1, -1), 0): 20}
    assert any(0 in g and 1 in g for g in T.LabelModel(counts).groups)


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in _rows(60, 3)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model, _ = T.learn(docs, none)
    assert T.score(docs, model).count() == 60 and T.score(docs.limit(0), model).count() == 0
    model, _ = T.learn(docs.limit(0), none)
    assert T.score(docs, model).count() == 60
