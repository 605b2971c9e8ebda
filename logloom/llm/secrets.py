"""Secret scans: base patterns plus corpus-wide ownership frequency (native).

Base spans are the matches of three patterns, each leftmost and
non-overlapping. The method looks beyond them: every long token with letters
and digits is a candidate. Candidate hashes are aggregated over the whole
corpus by distinct repositories and owners (columns; for ``documents``, source
stands for both). A value that many repositories or owners carry is a copied
example; one that stays with few and looks random is taken for a live
credential and added as a span of kind ``owner``.

One scan of the text makes the base spans and the candidates, written to the
shared folder without texts. Counting is two-step (value and repository first), so
a hot value is summed up before it is moved; a document's few candidates
come back by its key. All expressions are built in.

Offsets are code points: matches come from regexp_extract_all and what lies
between them from split by the same pattern, whose lengths add up.

Defined cases: null text is empty; empty texts have no span; repeated rows
get equal results and count once as owners; a null repository or owner is one
of its own; empty tables give an empty result; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, packed, table, unpacked

#: Base kinds in listed order: pattern, a cheap test that every text with a match passes, least lengths of whole match and group 2.
NAMES = "password passwd secret token api_?key"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = r"(" + "|".join(map(_either_case, NAMES.split())) + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The same as AKIA[A-Z0-9]+ and [0-9a-f]+ with the least length asked for afterwards: a run that is too short has no long part.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Candidates of the method: tokens of 20 characters or more, of any length, that hold letters and digits.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
#: A value in more repositories or owners than this is a copied example.
MAX_OWNERS = 2
#: Distinct characters that a live-looking value has at least.
LEAST_DISTINCT = 10
KINDS = ("assign", "access", "hex", "owner")

_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Matches folded at a time: appending to an array copies it.
BLOCK = 256


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Spans of all matches of a pattern, in order: within blocks of matches first, then shifted by what the blocks before hold."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        one = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["hit"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def shifted(block: Column, by: Column) -> Column:
        return F.transform(block["out"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))

    def joined(blocks: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        befores = F.aggregate(blocks, begin, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, befores, shifted))

    def cut(pairs: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(pairs), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(BLOCK)), start, step))

    once = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    pairs = F.filter(F.zip_with(gaps, found, lambda g, h: F.struct(g.alias("gap"), h.alias("hit"))), lambda p: p["hit"].isNotNull())
    return once(pairs, lambda p: once(cut(p), joined))


def _long_value(match: Column) -> Column:
    """Group 2 of an assignment: what follows the name, quotes, blanks and the first sign."""
    return F.regexp_extract(match, "^" + ASSIGN + "$", 2)


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds _base (sorted spans of the base kinds) and _more (candidate spans)."""
    out = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    t, none = F.col("_t"), F.array().cast(_SPAN)
    some = lambda pattern, kind, guard: F.when(guard, _spans(t, pattern, kind)).otherwise(none)
    assign = F.filter(some(ASSIGN, 0, t.rlike(ASSIGN)), lambda s: F.length(_long_value(s["value"])) >= LEAST_VALUE)
    out = out.withColumn("_a", assign).withColumn("_k", some(ACCESS, 1, t.contains("AKIA"))).withColumn("_x", some(HEX, 2, t.rlike(HEX)))
    out = out.withColumn("_base", F.array_sort(F.concat("_a", "_k", "_x")))
    live = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= LEAST_DISTINCT)
    return out.withColumn("_more", F.filter(some(TOKEN, 3, t.rlike(TOKEN)), live))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", repository: str = "source", owner: str = "source") -> DataFrame:
    """doc_id, a digest of the text, the base spans and all spans of every row of docs."""
    found = with_spans(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(repository).alias("_repo"), F.col(owner).alias("_owner")))
    keyed = found.select("doc_id", F.xxhash64("text").alias("_d"), "_repo", "_owner", "_base", "_more")
    rows = Written(keyed, "secret-spans").df
    tokens = rows.filter("size(_more) > 0").select("doc_id", "_d", "_repo", "_owner", F.explode_outer("_more").alias("s"))
    tokens = tokens.withColumn("_v", F.sha2(F.col("s.value"), 256))
    holders = tokens.groupBy("_v", "_repo", "_owner").agg(F.lit(1).alias("one"))
    # A null is one of its own, apart from an empty name.
    many = lambda c: F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")))
    own = holders.groupBy("_v").agg(many("_repo").alias("r"), many("_owner").alias("o")).filter((F.col("r") <= MAX_OWNERS) & (F.col("o") <= MAX_OWNERS)).select("_v")
    added = tokens.join(own, "_v", "left_semi").groupBy("doc_id", "_d").agg(F.collect_set("s").alias("_own"))
    added = added.select(F.col("doc_id").alias("_i"), F.col("_d").alias("_e"), "_own")
    whole = rows.join(added, rows["doc_id"].eqNullSafe(added["_i"]) & (rows["_d"] == added["_e"]), "left")
    spans = F.array_sort(F.concat(F.col("_base"), F.coalesce(F.col("_own"), F.array().cast(_SPAN))))
    return whole.select("doc_id", "_d", "_base", spans.alias("_spans"))


def op8(spark, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of every document."""
    out = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(F.col("_base")), 256).alias("base_sha256"), listed(F.col("_spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each stretch under spans replaced by one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        add = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], add)).alias("out"))

    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents stay; every span is replaced by a mark and n_chars follows."""
    hit = scan(docs).filter("size(_spans) > 0").select(F.col("doc_id").alias("_i"), F.col("_d").alias("_e"), "_spans").distinct()
    hit = Written(hit, "secret-hits").df
    rows = packed(docs, id=F.col("doc_id"), d=F.xxhash64("text"))
    joined = rows.join(hit, F.col("id").eqNullSafe(F.col("_i")) & (F.col("d") == F.col("_e")), "left")
    text, found = F.col("r.text"), F.col("_spans")
    joined = joined.withColumn("_text", F.when(found.isNull(), text).otherwise(redacted(text, found)))
    chars = F.when(found.isNull(), F.col("r.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType))
    new = {"text": F.col("_text"), "n_chars": chars}
    return joined.select(*(new[c].alias(c) if c in new else F.col(f"r.`{c}`").alias(c) for c in docs.columns))


def _span_sql(kind: int, pattern: str, keep: str) -> str:
    """Spans of one kind: matches, and the lengths of what lies between and before them."""
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {kind} AS kind, v, CAST(b AS BIGINT) AS s, CAST(b + length(v) AS BIGINT) AS e FROM
      (SELECT rid, m[i] AS v, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b
       FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d))) WHERE {keep}"""


_ASSIGN_SQL = ASSIGN.replace('\\"', '"')
_NAMED = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'owner' END || ':' || s || ':' || e"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
base AS ({_span_sql(0, _ASSIGN_SQL, f"length(regexp_extract(v, '^{_ASSIGN_SQL.replace(chr(39), chr(39) * 2)}$', 2)) >= {LEAST_VALUE}")}
  UNION ALL {_span_sql(1, ACCESS, "true")}
  UNION ALL {_span_sql(2, "[0-9a-f]{24,}", "true")}),
tok AS ({_span_sql(3, "[A-Za-z0-9+/_=-]{20,}", f"length(v) <= 200 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {LEAST_DISTINCT}")}),
own AS (SELECT v FROM tok JOIN d USING (rid) GROUP BY v HAVING count(DISTINCT source) <= {MAX_OWNERS}),
spans AS (SELECT * FROM base UNION ALL SELECT tok.* FROM tok JOIN own USING (v)),
b AS (SELECT rid, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS h, string_agg({_NAMED}, ',' ORDER BY s, kind) AS l FROM base GROUP BY 1),
f AS (SELECT rid, string_agg({_NAMED}, ',' ORDER BY s, kind) AS l FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(b.a, 0) AS n_assign, coalesce(b.k, 0) AS n_access, coalesce(b.h, 0) AS n_hex, sha256(coalesce(b.l, '')) AS base_sha256, coalesce(f.l, '') AS spans
FROM d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""
