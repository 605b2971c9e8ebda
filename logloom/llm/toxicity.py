"""Toxicity by weak supervision.

Voters. Each votes toxic (1), clean (0) or abstains (-1) on a text: a seed
lexicon, lexicons of words and of word beginnings drawn from the labelled rows, a
lexicon of hostile phrases and one of courtesies, and patterns (shouting, insults near a second person or
said of one, near the start, more than once, the share of lexicon words). The
generative label model has a latent class, an accuracy table for each voter, and
correlations: voters that agree beyond what the class explains are gathered in
one group, whose joint votes get one table. It is fitted by expectation
maximisation over the distinct vote vectors of the whole learning part (a label, where
known, fixes the class). Its posterior of the votes alone labels the rows on which a linear
classifier is trained (logistic regression on hashed words and word beginnings
plus the votes), labelled or not; the classifier scores every whole text.

Fitting sample (documented bound): the classifier alone is fitted on the
``SAMPLE`` learnable rows that come first by a digest of the row, as feature numbers made on
the executors. Lexicons are drawn from counts over all labelled learnable rows, and vote vectors are
counted with their labels over all learnable rows. Everything else covers all
rows. Labels come from rows whose crc32(doc_id) mod 5 is not 0 only. Votes
are joined with labels by id, without the texts; word counts are summed up in
each batch and by Spark, and only words that pass the bar are collected.

Defined cases: null text is empty and gets the classifier's score of no
word at all; without labels the seed lexicon and the patterns still make a
model; rows with conflicting labels count as toxic where any is; a null id
is neither learned from nor held out; repeated rows score alike and count once in the sample; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, held_out, learnable, table

#: Rows that the classifier is fitted on, at most.
SAMPLE = 8_000
DIMENSIONS = 1 << 18
#: Lengths of word beginnings that are features and lexicon entries.
STEMS = (4, 5, 6, 7, 8)
LEAST_DOCS = 6
LEAST_LIFT = 8.0
ROUNDS = 40
EPOCHS = 8
_WORD = re.compile(r"[^\W\d_]+")

#: Seed lexicon: common English insults (fixed values).
SEED = frozenset("idiot moron stupid scum trash loser pathetic worthless disgusting clown dumb fool jerk filth garbage imbecile cretin vermin bastard bitch".split())
#: Second-person words, hostile phrases and courtesies (fixed values).
PERSON = frozenset("you your yourself tu vous toi du dich ihr tú vosotros usted".split())
HOSTILE = ("hate you", "shut up", "get lost", "go away", "drop dead", "go to hell", "nobody likes")
COURTEOUS = frozenset("please thanks thank regards sincerely welcome merci danke gracias bitte".split())
#: Words at a text's start, and words about which what is known is kept in a worker.
START, KNOWN = 20, 1 << 17
#: Stands before feature numbers for a listed beginning.
LISTED = -1


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def stems(words: set[str]) -> set[str]:
    return {w[:k] for w in words for k in STEMS if len(w) > k}


class _Numbers(dict):
    """Feature numbers of a word and its beginnings, as bytes of 32-bit integers; LISTED is among them where a beginning is listed.

    The first KNOWN words met are kept (frequent ones come early), others are worked out anew.
    """

    def __init__(self, beginnings: frozenset[str]):
        super().__init__()
        self.beginnings = beginnings

    def __missing__(self, word: str) -> bytes:
        numbers = [zlib.crc32(word.encode("utf-8", "surrogatepass")) % DIMENSIONS]
        crc, done = zlib.crc32(b"^"), 0
        for k in STEMS:
            if len(word) <= k:
                break
            crc, done = zlib.crc32(word[done:k].encode("utf-8", "surrogatepass"), crc), k
            numbers.append(crc % DIMENSIONS)
            if word[:k] in self.beginnings:
                numbers.append(LISTED)
        found = array("i", numbers).tobytes()
        if len(self) < KNOWN:
            self[word] = found
        return found


class Voters:
    """The voters over one text; lexicons are sets of words or of word beginnings."""

    NAMES = ("seed", "words", "stems", "dense", "shout", "person", "said", "start", "again", "hostile", "courteous", "short")

    def __init__(self, words: frozenset[str] = frozenset(), beginnings: frozenset[str] = frozenset()):
        self.words, self.beginnings = words, beginnings
        self.bad = SEED | words
        self._known = _Numbers(beginnings)

    def __reduce__(self):
        return Voters, (self.words, self.beginnings)

    def __call__(self, text: str | None) -> tuple[int, ...]:
        return self.judged(text)[0]

    def judged(self, text: str | None) -> tuple[tuple[int, ...], np.ndarray]:
        """The votes on a text and its feature numbers: of words and beginnings present, sorted, then one for each vote cast."""
        w = tokens(text)
        kinds = set(w)
        numbers = np.sort(np.frombuffer(b"".join(map(self._known.__getitem__, kinds)), np.int32))
        numbers = numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers
        stem = len(numbers) > 0 and numbers[0] == LISTED
        here = kinds & self.bad
        at = [i for i, x in enumerate(w) if x in here] if here else []
        near = any(y in PERSON for i in at for y in w[max(0, i - 3) : i + 4])
        said = any(y in PERSON for i in at for y in w[max(0, i - 2) : i])
        letters = sum(map(len, w))
        shout = letters > 40 and (text or "").count("!") * 12 > letters
        hostile = not kinds.isdisjoint(("hate", "shut", "lost", "away", "drop", "hell", "nobody")) and any(x in " ".join(w) for x in HOSTILE)
        votes = (
            int(not kinds.isdisjoint(SEED)), int(not kinds.isdisjoint(self.words)), int(stem), 1 if len(at) * 100 > len(w) else (-1 if at else 0),
            1 if shout else -1, 1 if near else -1, 1 if said else -1, 1 if at and at[0] < START else -1, 1 if len(at) > 1 else -1, 1 if hostile else -1,
            0 if not at and not kinds.isdisjoint(COURTEOUS) else -1, 0 if len(w) < 3 and not at else -1,
        )
        cast = [DIMENSIONS + 2 * i + v for i, v in enumerate(votes) if v >= 0]
        return votes, np.concatenate([numbers[int(stem) :], np.array(cast, np.int32)])


#: Words and beginnings that a task sums up before it hands the sums on.
HELD = 1 << 18


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label (word null, stem false), then documents by label of each word and beginning; text and label come in."""
    # By stem, then label.
    seen = ((Counter(), Counter()), (Counter(), Counter()))
    rows = [0, 0]

    def out() -> pa.RecordBatch:
        words, stem, by_label = [None], [False], ([rows[0]], [rows[1]])
        for s, pair in enumerate(seen):
            for label, counts in enumerate(pair):
                words += counts.keys()
                stem += [s == 1] * len(counts)
                by_label[label].extend(counts.values())
                by_label[1 - label].extend([0] * len(counts))
                counts.clear()
        rows[:] = 0, 0
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(stem, pa.bool_()), *(pa.array(n, pa.int64()) for n in by_label)], ["word", "stem", "clean", "toxic"])

    for b in batches:
        for text, label in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            kinds = set(tokens(text.as_py()))
            rows[label] += 1
            seen[0][label].update(kinds)
            seen[1][label].update(stems(kinds))
            if sum(map(len, (*seen[0], *seen[1]))) >= HELD:
                yield out()
    yield out()


def draw(rows: DataFrame) -> Voters:
    """Lexicons of words and beginnings that toxic rows carry far more often than others; rows (text, toxic) all have a label."""
    counts = rows.select("text", "toxic").mapInArrow(_words, "word string, stem boolean, clean long, toxic long")
    counts = counts.groupBy("word", "stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counts = Written(counts.filter((F.col("toxic") >= LEAST_DOCS) | F.col("word").isNull()), "toxic-words").df
    total = counts.filter("word is null").first()
    if total is None or not (total["clean"] and total["toxic"]):
        return Voters()
    lifted = F.col("toxic") / total["toxic"] >= LEAST_LIFT * (F.col("clean") + 1) / total["clean"]
    out: tuple[set, set] = (set(), set())
    for r in counts.filter((F.col("toxic") >= LEAST_DOCS) & F.col("word").isNotNull() & lifted).collect():
        out[r["stem"]].add(r["word"])
    return Voters(*map(frozenset, out))


class LabelModel:
    """Latent-class model over votes, with tables for groups of correlated voters."""

    def __init__(self, counts: dict[tuple[tuple[int, ...], int], int]):
        """counts: of (votes, label), label -1 where unknown."""
        self.prior = 0.1
        known = Counter()
        for (_, label), n in counts.items():
            known[label] += n
        if known[0] + known[1]:
            self.prior = (known[1] + 1) / (known[0] + known[1] + 2)
        self.width = max((len(v) for v, _ in counts), default=len(Voters.NAMES))
        self.groups = [(i,) for i in range(self.width)]
        self.tables: list[dict] = []
        # Start: a voter is right more often than not; where labels are known they count in full.
        post = {k: self._fixed(k[1], 0.5 if not any(v == 1 for v in k[0][:3]) else 0.9) for k in counts}
        for round_ in range(ROUNDS):
            self._maximise(counts, post)
            post = {k: self._fixed(k[1], self.posterior(k[0])) for k in counts}
            if round_ == ROUNDS // 2:
                self.groups = self._correlated(counts, post)

    @staticmethod
    def _fixed(label: int, otherwise: float) -> float:
        return float(label) if label >= 0 else otherwise

    def _maximise(self, counts, post) -> None:
        self.tables = []
        weight = np.array([1e-9, 1e-9])
        sums = [defaultdict(lambda: np.array([0.5, 0.5])) for _ in self.groups]
        for k, n in counts.items():
            share = n * np.array([1 - post[k], post[k]])
            weight += share
            for g, s in zip(self.groups, sums, strict=True):
                s[tuple(k[0][i] for i in g)] += share
        for s in sums:
            whole = sum(s.values(), np.array([0.5, 0.5]))
            self.tables.append({v: x / whole for v, x in s.items()} | {None: np.array([0.5, 0.5]) / whole})
        self.prior = float(np.clip(weight[1] / weight.sum(), 1e-4, 1 - 1e-4))

    def _correlated(self, counts, post) -> list[tuple[int, ...]]:
        """Groups of voters whose votes, class given, correlate by more than 0.3."""
        votes = np.array([k[0] for k in counts], float).reshape(-1, self.width)
        n = np.array(list(counts.values()), float)
        p = np.array([post[k] for k in counts])
        root = list(range(votes.shape[1]))
        for w in (n * p, n * (1 - p)):
            if w.sum() < 20:
                continue
            z = votes - (w @ votes) / w.sum()
            cov = (z * w[:, None]).T @ z / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            for i, j in zip(*np.nonzero(np.triu(np.abs(cov / np.outer(sd, sd)) > 0.3, 1)), strict=True):
                if sd[i] > 1e-3 and sd[j] > 1e-3:
                    root = [root[i] if r == root[j] else r for r in root]
        return [tuple(i for i, r in enumerate(root) if r == g) for g in sorted(set(root))]

    def posterior(self, votes: tuple[int, ...]) -> float:
        votes = (*votes, *[-1] * (self.width - len(votes)))
        odds = np.log(self.prior / (1 - self.prior))
        for g, t in zip(self.groups, self.tables, strict=True):
            x = t.get(tuple(votes[i] for i in g), t[None])
            odds += np.log(x[1] / x[0])
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


class Linear:
    """Logistic regression on sparse indices; the hashed part of a text is scaled by its size."""

    def __init__(self):
        self.w = np.zeros(DIMENSIONS + 2 * len(Voters.NAMES))
        self.bias = 0.0

    def _values(self, x: np.ndarray) -> np.ndarray:
        hashed = x < DIMENSIONS
        return np.where(hashed, 1 / np.sqrt(max(1, hashed.sum())), 1.0).astype(np.float32)

    def score(self, x: np.ndarray) -> float:
        s = self.bias + float(self.w[x] @ self._values(x))
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    def fit(self, rows: list[np.ndarray], target: np.ndarray, seed: int = 7) -> Linear:
        values = [self._values(x) for x in rows]
        g2, gb = np.full_like(self.w, 1e-8), 1e-8
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                x, v = rows[i], values[i]
                p = 1 / (1 + np.exp(-np.clip(self.bias + self.w[x] @ v, -30, 30)))
                g = p - target[i]
                d = g * v + 1e-5 * self.w[x]
                g2[x] += d * d
                self.w[x] -= 0.2 * d / np.sqrt(g2[x])
                gb += g * g
                self.bias -= 0.2 * g / np.sqrt(gb)
        return self


class Model:
    def __init__(self, voters: Voters, linear: Linear):
        self.voters, self.linear = voters, linear

    def score(self, text: str | None) -> float:
        return self.linear.score(self.voters.judged(text)[1])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Model, LabelModel]:
    """docs (doc_id, text) and labels (doc_id, toxic), both of learnable rows only."""
    spark = docs.sparkSession
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # Joined the same way at every size: labels grow with the corpus, so they are never broadcast.
    voters = draw(docs.join(marks.hint("merge"), "doc_id"))
    shared = spark.sparkContext.broadcast(voters)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [",".join(map(str, shared.value(t.as_py()))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.string())], ["doc_id", "votes"])

    # A row for each vote vector met (their number has a bound, whatever the corpus); every learnable row counts with its label, if it has one.
    votes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(vote, "doc_id long, votes string")
    every = votes.join(marks.hint("merge"), "doc_id", "left").groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("y")).agg(F.count(F.lit(1)).alias("n")).orderBy("votes", "y").collect()
    model = LabelModel({(tuple(map(int, r["votes"].split(","))), r["y"]): r["n"] for r in every})
    # The sample's bar is found on digests alone; its rows come as numbers, not as texts.
    digest = F.xxhash64("doc_id", "text")
    bar = docs.select(digest.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            votes, numbers = [], []
            for t in b.column(1):
                v, x = shared.value.judged(t.as_py())
                votes.append(",".join(map(str, v)))
                numbers.append(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.string()), pa.array(numbers, pa.list_(pa.int32()))], ["h", "votes", "x"])

    rows = []
    if bar is not None:
        chosen = docs.select(digest.alias("h"), "text").filter(F.col("h") <= bar).dropDuplicates(["h"]).mapInArrow(featured, "h long, votes string, x array<int>")
        rows = sorted(chosen.toLocalIterator(), key=lambda r: r["h"])
    target = np.array([model.posterior(tuple(map(int, r["votes"].split(",")))) for r in rows])
    return Model(voters, Linear().fit([np.array(r["x"], np.int32) for r in rows], target)), model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("score", scored(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model, _ = learn(docs.filter(learnable()), labels.filter(learnable()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
