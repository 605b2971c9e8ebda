"""Mixing sources to target weights by hierarchical budgeting.

A token budget is handed down a tree of domain, language and source. At each
node it is shared by the children's weights; no child gets more than it can
give (its tokens times ``epochs``), and what it leaves goes to its siblings by
their weights. As a node's limit is the sum of its leaves' limits, only what a
whole family cannot give reaches the ancestor's other children. With children
in order of limit / weight, the common level is the greatest of
(budget - limits before) / (weights from here on), so no iteration is needed.

Each leaf takes its documents in seeded order, one epoch after another with a
new order each, up to its budget: whole epochs, then a token-prefix of the
last. Prefix sums do not gather a leaf in one task: order keys fall in 256
buckets by their first two hexadecimal digits, which are summed up first; the bucket in
which a leaf's budget ends is cut again by the next two digits until it holds ``ENOUGH``
documents at most, and only there the place is found where the budget ends. All
that happens on ids and token numbers; documents are then read once and each row
compared with its leaf's end. Leaf tables are joined as Spark sees fit by their size.

Defined cases: null text has no tokens; null languages and sources are leaves
of their own (empty names); repeated rows are documents of their own; ties in the
order key go by doc_id and tokens; weights not listed are ``DEFAULT``; an
empty table or budget gives an empty result; other columns are carried along, whatever
their names (domain, epoch and tokens give way); rows of one id and token number that the end falls among are taken by number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Written, packed, table, unpacked

#: Integer weights of domains and languages; sources weigh the same.
DOMAINS = {"web": 4, "news": 3, "reference": 2, "forum": 1}
LANGUAGES = {"en": 4, "fr": 2, "de": 2, "es": 2}
DEFAULT = 1
EPOCHS = 2
SEED = 17
#: Documents among which the end of a leaf is sought in one task, at most (more where one id repeats more often).
ENOUGH = 1 << 16
LEAF = ["domain", "language", "origin"]


def domain_of(source: Column) -> Column:
    """Domain of a source: by the remainder of its number by 4; web without one."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1)
    names = F.array(*map(F.lit, DOMAINS))
    return F.when(number == "", F.lit("web")).otherwise(F.get(names, (number.cast("int") % len(DOMAINS)).cast("int")))


def n_tokens(text: Column) -> Column:
    """White-space words."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def _weight(name: str, weights: dict[str, int]) -> Column:
    out = F.lit(DEFAULT)
    for k, v in weights.items():
        out = F.when(F.col(name) == k, F.lit(v)).otherwise(out)
    return out.cast("long")


def shared(children: DataFrame, parent: list[str], budget: str, limit: str, weight: Column) -> DataFrame:
    """children with ``share``: the parent's budget by weight within limits, whole tokens."""
    rows = children.withColumn("_w", weight).withColumn("_r", F.col(limit) / F.col("_w"))
    order = W.partitionBy(*parent).orderBy("_r", *LEAF[: len(parent) + 1]) if parent else W.partitionBy(F.lit(0)).orderBy("_r", LEAF[0])
    whole = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum(limit).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    onwards = F.sum("_w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col(budget) - before) / onwards)
    rows = rows.withColumn("_top", F.max("_level").over(whole))
    return rows.withColumn("share", F.floor(F.least(F.col(limit).cast("double"), F.col("_w") * F.greatest("_top", F.lit(0.0)))).cast("long")).drop("_w", "_r", "_level", "_top")


def leaf_budgets(slim: DataFrame, budget_share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """domain, language, origin, tokens and budget of every leaf; slim has the leaf columns and tokens."""
    leaves = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens")).withColumn("limit", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "language").agg(F.sum("limit").alias("limit"), F.sum("tokens").alias("tokens"))
    domains = langs.groupBy("domain").agg(F.sum("limit").alias("limit"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("budget", F.floor(F.sum("tokens").over(W.partitionBy(F.lit(0))) * F.lit(budget_share)).cast("long"))
    domains = shared(domains, [], "budget", "limit", _weight("domain", DOMAINS)).select("domain", F.col("share").alias("budget"))
    langs = shared(langs.join(domains, "domain"), ["domain"], "budget", "limit", _weight("language", LANGUAGES)).select("domain", "language", F.col("share").alias("budget"))
    out = shared(leaves.join(langs, ["domain", "language"]), ["domain", "language"], "budget", "limit", F.lit(1).cast("long"))
    return out.select(*LEAF, "tokens", F.col("share").alias("budget"))


def _key(doc_id: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _ends(slim: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each leaf's budget ends in its last epoch: the order key and tokens of the first documents not all taken, and how many of them are.

    slim has the leaf, id and tokens of each document, plan the leaf, whole and rest.
    """
    now = Written(plan.select(*LEAF, "whole", "rest", F.lit("").alias("head"), F.lit(0).cast("long").alias("before")), "mix-ends")
    while True:
        rows = slim.join(now.df, LEAF).withColumn("key", _key(F.col("id"), F.col("whole"))).filter(F.startswith("key", "head"))
        places = [*LEAF, "whole", "rest", "head", "before"]
        width = F.length("head") + 2
        sums = rows.groupBy(*places, F.substr("key", F.lit(1), width).alias("next")).agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
        upto = F.col("before") + F.sum("t").over(W.partitionBy(*LEAF).orderBy("next"))
        first = F.min(F.struct("next", (F.col("upto") - F.col("t")).alias("before"), "n"))
        ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy(*LEAF, "whole", "rest").agg(first.alias("e"))
        new = Written(ends.select(*LEAF, "whole", "rest", F.col("e.next").alias("head"), F.col("e.before").alias("before"), F.col("e.n").alias("n")), "mix-ends", most=F.max("n"), deep=F.max(F.length("head")))
        now.drop()
        now = new
        if not now.rows or now.metrics["most"] <= ENOUGH or now.metrics["deep"] >= 32:
            break
    rows = slim.join(now.df, LEAF).withColumn("key", _key(F.col("id"), F.col("whole"))).filter(F.startswith("key", "head"))
    # Documents of one id and size count as one entry, so a repeated id is no more than a number.
    alike = rows.groupBy(*LEAF, "whole", "rest", "before", "key", "tokens").agg((F.col("tokens") * F.count(F.lit(1))).alias("t"))
    order = W.partitionBy(*LEAF).orderBy("key", "tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    over = alike.withColumn("upto", F.col("before") + F.sum("t").over(order)).filter("upto > rest")
    end = over.groupBy(*LEAF, "whole").agg(F.min(F.struct("key", "tokens", whole_of(F.col("rest") - (F.col("upto") - F.col("t")), F.col("tokens")).alias("taken"))).alias("e"))
    return Written(end.select(*LEAF, "whole", "e.*"), "mix-end").df


def whole_of(rest: Column, tokens: Column) -> Column:
    return F.when(tokens > 0, F.floor(rest / tokens)).otherwise(0).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", budget_share: float = 1.0, epochs: int = EPOCHS) -> DataFrame:
    """The selected rows of docs with domain, epoch and tokens (a row for each epoch that takes it)."""
    named = {"domain": domain_of(F.col(source)), "language": F.coalesce(F.col(lang), F.lit("")), "origin": F.coalesce(F.col(source), F.lit("")), "tokens": n_tokens(F.col(text))}
    slim = Written(docs.select(F.col(doc_id).alias("id"), *(c.alias(k) for k, c in named.items())), "mix-slim").df
    plan = leaf_budgets(slim, budget_share, epochs).filter("tokens > 0")
    plan = plan.withColumn("whole", F.expr("budget DIV tokens").cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = Written(plan, "mix-leaves").df
    ends = _ends(slim, plan)
    leaf = lambda df: df.select(*(F.col(k).alias(f"_{k}") for k in LEAF), *(F.col(k) for k in df.columns if k not in LEAF))
    # Written, so that its size is known before texts are joined with it: a plan of few leaves then spares them the shuffle.
    last = Written(leaf(plan.select(*LEAF, "whole").join(ends.withColumnsRenamed({"tokens": "size"}).drop("whole"), LEAF, "left")), "mix-last").df
    rows = packed(docs, id=F.col(doc_id), tokens=named["tokens"], **{f"_{k}": named[k] for k in LEAF})
    rows = rows.join(last, [f"_{k}" for k in LEAF]).withColumn("place", _key(F.col("id"), F.col("whole")))
    before = (F.col("place") < F.col("key")) | ((F.col("place") == F.col("key")) & (F.col("tokens") < F.col("size")))
    among = (F.col("place") == F.col("key")) & (F.col("tokens") == F.col("size"))
    taken = F.when(F.coalesce(before, F.lit(False)), F.array(F.col("whole"))).otherwise(F.array().cast("array<int>"))
    full = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    out = lambda df, epoch: df.select(*unpacked(df, "domain", "epoch", "tokens"), F.col("_domain").alias("domain"), epoch.cast("int").alias("epoch"), "tokens")
    every = rows.withColumn("_e", F.explode(F.concat(full, taken)))
    ties = rows.filter(among & (F.col("taken") > 0)).withColumn("_n", F.row_number().over(W.partitionBy(*(f"_{k}" for k in LEAF)).orderBy("place"))).filter("_n <= taken")
    return out(every, F.col("_e")).unionByName(out(ties, F.col("whole")))


def op7(spark, sf_dir: str) -> DataFrame:
    """Documents selected for the target mixture, with their epoch."""
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the mixture, with domain, epoch and tokens beside the columns of documents."""
    return mix(docs)


_CASE = lambda name, weights: "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {DEFAULT} END"


def _shared_sql(src: str, parent: str, own: str, weight: str) -> str:
    part = f"PARTITION BY {parent} " if parent else ""
    return f"""(SELECT *, CAST(floor(least(CAST(lim AS DOUBLE), w * greatest(max(lvl) OVER ({part}), 0.0))) AS BIGINT) AS share FROM
      (SELECT *, CAST(budget - coalesce(sum(lim) OVER ({part} ORDER BY CAST(lim AS DOUBLE) / w, {own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(w) OVER ({part} ORDER BY CAST(lim AS DOUBLE) / w, {own} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl
       FROM (SELECT *, {weight} AS w FROM {src})))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
        CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) = '' THEN 'web'
             ELSE ['web', 'news', 'reference', 'forum'][CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 + 1] END AS domain,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
lf AS (SELECT domain, language, origin, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(tokens) * {EPOCHS} AS BIGINT) AS lim FROM d GROUP BY 1, 2, 3),
la AS (SELECT domain, language, CAST(sum(lim) AS BIGINT) AS lim FROM lf GROUP BY 1, 2),
dm AS (SELECT domain, CAST(sum(lim) AS BIGINT) AS lim, (SELECT CAST(sum(tokens) AS BIGINT) FROM lf) AS budget FROM lf GROUP BY 1),
sd AS (SELECT domain, share AS budget FROM {_shared_sql("dm", "", "domain", _CASE("domain", DOMAINS))}),
sl AS (SELECT domain, language, share AS budget FROM {_shared_sql("(SELECT la.*, sd.budget FROM la JOIN sd USING (domain))", "domain", "language", _CASE("language", LANGUAGES))}),
sf AS (SELECT domain, language, origin, tokens, share AS budget FROM {_shared_sql("(SELECT lf.*, sl.budget FROM lf JOIN sl USING (domain, language))", "domain, language", "origin", "1")}),
e AS (SELECT d.*, sf.budget, k.epoch, md5('{SEED}:' || k.epoch || ':' || d.doc_id) AS key FROM d JOIN sf USING (domain, language, origin), (SELECT unnest(range(0, {EPOCHS})) AS epoch) k WHERE sf.tokens > 0),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY epoch, key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, CAST(tokens AS BIGINT) AS tokens FROM r WHERE run <= budget
"""
