"""Template mining for records that no parser claims (Drain: He et al., ICWS 2017).

``masked`` is the per-record template: tokens that hold a digit become a
wildcard. ``mine`` clusters a whole column in two steps that do not depend on
how rows are dealt out: distinct masked messages are counted first (a message
that a third of all rows share becomes one row), then the messages of one
length, first and second word are clustered in text order, however many they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sqltext import of

WILD = "<*>"
SIMILAR = 0.4


def masked(text):
    """The text with every token that holds a digit masked; a Column for a Column."""
    f = of(text)
    return f.regexp_replace(f.coalesce(text, f.lit("")), r"(?d)[^\s]*\d[^\s]*", WILD)


def cluster(messages: list[list[str]]) -> list[int]:
    """Cluster number of each token list (all of one length): the most similar cluster so far, if similar enough."""
    found: list[list[str]] = []
    out = []
    for tokens in messages:
        best, at = -1.0, None
        for i, c in enumerate(found):
            same = sum(a == b for a, b in zip(c, tokens, strict=True)) / max(1, len(tokens))
            if same > best:
                best, at = same, i
        if at is None or best < SIMILAR:
            found.append(list(tokens))
            at = len(found) - 1
        else:
            found[at] = [a if a == b else WILD for a, b in zip(found[at], tokens, strict=True)]
        out.append(at)
    return out


def mine(df: DataFrame, text: str = "raw") -> DataFrame:
    """template, n (rows) and example of every cluster of the column's messages."""
    rows = df.select(masked(F.col(text)).alias("m"), F.col(text).alias("t")).filter("t is not null")
    distinct = rows.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("example"))
    token = F.split(F.trim("m"), r"\s+")
    keyed = distinct.withColumn("size", F.size(token)).withColumn("head", F.get(token, 0)).withColumn("second", F.coalesce(F.get(token, 1), F.lit("")))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("m", ignore_index=True)
        tokens = [m.split() for m in pdf["m"]]
        pdf["c"] = cluster(tokens)
        out = []
        for _, g in pdf.groupby("c"):
            kept = [a if all(tokens[i][k] == a for i in g.index) else WILD for k, a in enumerate(tokens[g.index[0]])]
            out.append((" ".join(kept), int(g["n"].sum()), g["example"].min()))
        return pd.DataFrame(out, columns=["template", "n", "example"]).astype({"template": object, "example": object})

    return keyed.select("size", "head", "second", "m", "n", "example").groupBy("size", "head", "second").applyInPandas(work, "template string, n long, example string")


def streaming_miner() -> type:
    """A stateful processor for transformWithStateInPandas: templates of one (length, first word) as state."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
    from pyspark.sql.types import StringType, StructField, StructType

    class Miner(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getListState("templates", StructType([StructField("template", StringType())]))

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
            known = [r[0].split() for r in self.known.get()]
            out = []
            for pdf in rows:
                for m in pdf["m"]:
                    tokens = m.split()
                    at = cluster([*known, tokens])[-1] if known else 0
                    if at >= len(known):
                        known.append(tokens)
                    else:
                        known[at] = [a if a == b else WILD for a, b in zip(known[at], tokens, strict=True)]
                    out.append((m, " ".join(known[at])))
            self.known.put([(" ".join(t),) for t in known])
            yield pd.DataFrame(out, columns=["m", "template"]).astype(object)

        def close(self) -> None:
            pass

    return Miner
