"""URL filters: longest-rule verdicts, and a character language-model ratio for the rest (native).

Two variable-order Markov models over 32 symbols are learned from the URLs
that the rules accept and reject. A context is the longest suffix, of up to
``ORDER`` symbols, seen ``SEEN`` times or more, whatever the size of the corpus:
the model grows with the input, up to all 32 ** ORDER contexts. Probabilities
are interpolated with the next shorter context. A URL's score is the mean log
ratio of the two models over its symbols (all after ``://``, query and
fragment included; the scheme is not read); the threshold is calibrated on the
scores of the ruled URLs (balanced error is least). Under it, the verdict is
block.

Counting is one scan and one shuffle of at most 32 ** (ORDER + 1) keys; the
model is two fixed-size arrays (node of each context, ratio of each node and
symbol), folded into literals, so scoring is one more scan, without join.

Defined cases: a null url or one without ``://`` has an empty host and path;
null and empty urls get allow (nothing to score), others without ``://`` are
scored as they stand; with no accepted or no rejected URL to learn
from, all unruled URLs are allowed; repeated rows are judged alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: (host, path prefix, verdict), fixed values.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
ALPHABET = 32
ORDER = 3
#: Times that a context is seen, in both classes together, before it is a node.
SEEN = 8
#: Weight of the shorter context in interpolation.
SMOOTH = 4.0
BINS = 400
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), LETTERS.upper(), LETTERS)


def path_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def scored_of(url: Column) -> Column:
    """What the models read: all that follows the first ://, query and fragment included; the whole url without ://."""
    known = F.coalesce(url, F.lit(""))
    return F.when(known.contains("://"), F.regexp_extract(known, r"(?s)^.*?://(.*)$", 1)).otherwise(known)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits (host length, then path length), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def symbols(text: Column) -> Column:
    """Array of symbol numbers: a-z, digit, slash, dot, hyphen, query signs, other; end mark last."""
    lower = F.translate(text, LETTERS.upper(), LETTERS)
    # One character stands for each symbol: digits become 0, query signs =, all else but the listed ones ~.
    plain = F.regexp_replace(F.translate(lower, "123456789?&%#_+", "000000000======"), r"(?s)[^a-z0/.=-]", "~")
    order = LETTERS + "0/.-=~"
    return F.transform(F.split(F.concat(plain, F.lit("/")), ""), lambda c: F.instr(F.lit(order), c) - 1)


def contexts(syms: str) -> Column:
    """For each symbol the number of its ORDER predecessors and itself in base 32 (slashes before the start)."""
    s = F.col(syms)
    before = lambda i, k: F.coalesce(F.get(s, i - k), F.lit(27))  # noqa: E731  symbol 27: the slash

    def code(x: Column, i: Column) -> Column:
        out = F.lit(0)
        for k in range(ORDER, 0, -1):
            out = out * ALPHABET + before(i, k)
        return (out * ALPHABET + x).cast("int")

    return F.transform(s, code)


class Ratio:
    """Variable-order models of two classes, as node of each context and log ratio of each node and symbol."""

    def __init__(self, counts: list[tuple[int, int, int]]):
        """counts: (context and symbol code, times accepted, times rejected)."""
        tables = [defaultdict(lambda: [[0] * ALPHABET, [0] * ALPHABET]) for _ in range(ORDER + 1)]
        for code, a, r in counts:
            context, x = divmod(code, ALPHABET)
            for k in range(ORDER + 1):
                node = tables[k][context % ALPHABET**k]
                node[0][x] += a
                node[1][x] += r
        totals = [sum(sum(n[c]) for n in tables[0].values()) for c in (0, 1)]
        self.learned = all(totals)
        uniform = [1 / ALPHABET] * ALPHABET
        probabilities: dict[tuple[int, int], list[list[float]]] = {}
        self.nodes: dict[tuple[int, int], int] = {}
        for k in range(ORDER + 1):
            for context in sorted(tables[k]):
                counts_of = tables[k][context]
                if k and sum(map(sum, counts_of)) < SEEN:
                    continue
                shorter = self._node(context, k - 1) if k else None
                low = probabilities[shorter] if shorter else [uniform, uniform]
                # A longer context only refines a kept shorter one.
                probabilities[(k, context)] = [[(n + SMOOTH * q) / (sum(row) + SMOOTH) for n, q in zip(row, old, strict=True)] for row, old in zip(counts_of, low, strict=True)]
                self.nodes[(k, context)] = len(self.nodes)
        self.table = [round(1000 * math.log(a / r)) for key in self.nodes for a, r in zip(*probabilities[key], strict=True)]
        self.of_context = [self.nodes[self._node(c, ORDER)] for c in range(ALPHABET**ORDER)] if self.nodes else []

    def _node(self, context: int, k: int) -> tuple[int, int]:
        while k and (k, context % ALPHABET**k) not in self.nodes:
            k -= 1
        return (k, context % ALPHABET**k)

    def score(self, codes: str) -> Column:
        """Thousandths of the mean log ratio; null for no symbol."""
        literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
        node, ratio = literal(self.of_context), literal(self.table)
        c = F.col(codes)
        one = lambda acc, x: acc + F.get(ratio, F.get(node, (x / ALPHABET).cast("int")) * ALPHABET + x % ALPHABET)
        return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0).cast("long"), one) / F.size(c))


def calibrated(bins: list[tuple[int, int, int]]) -> float | None:
    """The cut, in bins, under which URLs are rejected, with least balanced error over (bin, accepted, rejected).

    It lies midway between the neighbouring bins that have URLs.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return None
    best, at, low_good, low_bad, last = 2.0, None, 0, 0, None
    for b, g, r in sorted(bins):
        error = low_good / good + (bad - low_bad) / bad
        if error < best:
            best, at = error, float(b) if last is None else (last + 1 + b) / 2
        low_good, low_bad, last = low_good + g, low_bad + r, b
    return at


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (thousandths; null where there is no model or symbol) of every row."""
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), scored_of(F.col(url)).alias("_u"))
    rows = rows.withColumns({"rule": rule, "_v": verdict})
    full = F.col("_u")
    rows = rows.withColumn("_s", F.when(full == "", F.array().cast("array<int>")).otherwise(symbols(full))).withColumn("_c", contexts("_s"))
    codes = rows.select("_v", F.explode_outer("_c").alias("c")).filter("_v is not null and c is not null")
    counts = codes.groupBy("c").agg(F.count_if(F.col("_v") == "allow").alias("a"), F.count_if(F.col("_v") == "block").alias("r"))
    model = Ratio([(x["c"], x["a"], x["r"]) for x in counts.collect()])  # 32 ** 4 rows at most
    if not model.learned:
        return rows.select("page_id", "host", "path", "rule", F.coalesce("_v", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    rows = rows.withColumn("score", model.score("_c"))
    step = 10_000 / BINS
    bins = rows.select("_v", F.least(F.greatest(F.floor(F.col("score") / step), F.lit(-BINS)), F.lit(BINS)).alias("b")).groupBy("b", "_v").agg(F.count(F.lit(1)).alias("n"))
    found: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for x in bins.collect():
        if x["_v"] is not None and x["b"] is not None:
            found[x["b"]][x["_v"] == "block"] += x["n"]
    cut = calibrated([(b, *n) for b, n in found.items()])
    low = F.lit(False) if cut is None else F.coalesce(F.col("score") < cut * step, F.lit(False))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_v", F.when(low, "block").otherwise("allow")).alias("verdict"), "score")


def op3(spark, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
