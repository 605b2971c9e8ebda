"""Helpers over expressions as SQL text: pattern groups by one pass, small maps, white space, noted steps."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame

from . import sqltext as F
from .sqltext import Sql, of

#: White space that Python's strip() takes from ASCII text.
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
SEPARATOR = "\x01"
MAP = "map<string,string>"
PAIRS = "array<struct<k:string,v:string>>"


def strip(text):
    """The text without white space at its ends; a Column for a Column."""
    f = of(text)
    return f.btrim(text, f.lit(BLANK))


def blank(text: Sql) -> Sql:
    return F.coalesce(strip(text), F.lit("")) == ""


def java(pattern: str) -> tuple[str, list[str | None]]:
    """A Python pattern for java.util.regex: group names are taken out and listed by number."""
    names: list[str | None] = []
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "(" and not in_class:
            if m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
                names.append(m[1])
                out.append("(")
                i += m.end()
                continue
            if pattern[i + 1 : i + 2] != "?":
                names.append(None)
        out.append(c)
        i += 1
    return "".join(out), names


def separated(text: Sql) -> Sql:
    """The text without the separator, which hardly any holds."""
    return F.when(text.contains(SEPARATOR), F.translate(text, SEPARATOR, " ")).otherwise(text)


class Pattern:
    """A search pattern whose groups are taken in one pass: the text is rewritten to its groups and split.

    ``flags`` are Java's inline flags; ``d`` keeps line ends to newlines.
    """

    def __init__(self, pattern: str, flags: str = "d"):
        self.bare, self.names = java(pattern)
        self.flags = f"(?{flags})"
        self.search = self.flags + self.bare
        self._whole = rf"{self.flags}\A(?s:.*?)(?:{self.bare})(?s:.*)\z"

    def found(self, text: Sql) -> Sql:
        return F.coalesce(text.rlike(self.search), F.lit(False))

    def groups(self, text: Sql, order: tuple[str, ...] | list[str | None] | None = None) -> Sql:
        """Array of the groups ('' for one that took no part or that the pattern has not); only meaningful where found().

        ``order`` lists group names; without it all groups come as they stand.
        """
        if order is None:
            kept = [f"${i + 1}" for i in range(len(self.names))]
        else:
            kept = [f"${self.names.index(n) + 1}" if n in self.names else "" for n in order]
        return F.split(F.regexp_replace(separated(text), self._whole, SEPARATOR.join(kept)), SEPARATOR)

    def group(self, groups: Sql, name: str) -> Sql:
        """A named group out of groups(), null if empty."""
        return F.nullif(F.get(groups, self.names.index(name)), F.lit(""))


def guarded(flag: Sql, value: Sql) -> Sql:
    """value where flag holds, else null.

    The flag is tested by a lambda: that keeps the projection out of
    whole-stage code, where its many patterns would make one loop body that
    outgrows what the JVM compiles, while its parts stay compiled methods.
    """
    return F.when(F.exists(F.array(flag), lambda x: x), value)


def pairs(items: dict[str, Sql]) -> Sql:
    """Array of (k, v) for the non-empty values."""
    if not items:
        return F.array().cast(PAIRS)
    made = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in items.items()))
    return F.filter(made, lambda e: e["v"].isNotNull() & (e["v"] != ""))


def let(value: Sql, body) -> Sql:
    """body(value) with the value worked out once (a lambda works out what it mentions for every element)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_wins(entries: Sql) -> Sql:
    """Map of (k, v) entries, the first of equal keys."""
    kept = lambda e: let(e["k"], lambda keys: F.filter(e, lambda x, i: F.array_position(keys, x["k"]) == i + 1))
    return F.map_from_entries(let(entries, kept))


def as_map(items: dict[str, Sql]) -> Sql:
    return F.map_from_entries(pairs(items))


def literal_map(items: dict[str, str]) -> Sql:
    if not items:
        return F.map_from_arrays(F.array(), F.array()).cast(MAP)
    return F.create_map(*(F.lit(x) for kv in items.items() for x in kv))


def lookup(table: dict, key, kind: str = "string"):
    """Value of a small fixed table, null for other keys; a Column for a Column."""
    f = of(key)
    return f.element_at(f.create_map(*(f.lit(x) for kv in table.items() for x in kv)), key).cast(kind)


def at(values: Sql, keys: Sql, *names: str) -> Sql:
    """The value beside the first of the names that keys holds; null without any."""
    found = [F.get(values, F.nullif(F.array_position(keys, F.lit(n)), F.lit(0)).cast("int") - 1) for n in names]
    return found[0] if len(found) == 1 else F.coalesce(*found)


def some(value: Sql) -> Sql:
    """The text, null if empty."""
    return F.nullif(value, F.lit(""))


def how_many(*values: Sql) -> Sql:
    """How many of the texts hold something."""
    return sum((F.when(v != "", 1).otherwise(0) for v in values), F.lit(0))


def word(text: Sql, *options: str) -> Sql:
    """True where the lower-cased text holds any of the options."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.lit(False)
    for o in options:
        out = out | low.contains(o)
    return out


def by_number(number: Sql, values: list, kind: str = "string") -> Sql:
    """The number-th of fixed values (null where None): one array lookup."""
    text = F.split(F.lit("\x02".join("" if v is None else str(v) for v in values)), "\x02")
    return F.nullif(F.get(text, number), F.lit("")).cast(kind)


#: Steps in one SQL text.
AT_ONCE = 4


def _mentions(columns: dict[str, Sql]) -> set[str]:
    return {name for c in columns.values() for name in re.findall(r"`([^`]+)`", c.text)}


class Steps:
    """Expressions put together once and laid over any DataFrame with the same input column.

    Each step is a SELECT over the one before; AT_ONCE of them make one SQL text (the analyser goes over a text a limited number of times).
    """

    def __init__(self):
        self.todo: list[tuple[str, dict[str, Sql]]] = []

    def withColumn(self, name: str, column: Sql) -> Steps:
        return self.withColumns({name: column})

    def withColumns(self, columns: dict[str, Sql]) -> Steps:
        self.todo.append(("with", columns))
        return self

    def settle(self, name: str, column: Sql) -> Steps:
        """A column that filters on what is made of it are not pushed through (they would repeat all that made it)."""
        self.todo.append(("settle", {name: column}))
        return self

    def on(self, df: DataFrame, select: dict[str, Sql]) -> DataFrame:
        """The selected expressions over df and the steps' columns; steps that nothing selected leads to are left out."""
        needed = _mentions(select)
        todo = []
        for kind, columns in reversed(self.todo):
            if kept := {k: c for k, c in columns.items() if k in needed}:
                needed |= _mentions(kept)
                todo.insert(0, (kind, kept))
        for at in range(0, len(todo), AT_ONCE):
            df = self._over(df, "*", todo[at : at + AT_ONCE])
        return self._over(df, ", ".join(f"{c.text} AS `{k}`" for k, c in select.items()), [])

    @staticmethod
    def _over(df: DataFrame, select: str, steps: list[tuple[str, dict[str, Sql]]]) -> DataFrame:
        source = view = f"_steps_{uuid.uuid4().hex}"
        for kind, columns in steps:
            if kind == "with":
                source = f"(SELECT *, {', '.join(f'{c.text} AS `{k}`' for k, c in columns.items())} FROM {source})"
            else:
                source = f"(SELECT * FROM {source} LATERAL VIEW OUTER explode(array({next(iter(columns.values())).text})) AS `{next(iter(columns))}`)"
        spark = df.sparkSession
        df.createOrReplaceTempView(view)
        try:
            return spark.sql(f"SELECT {select} FROM {source}")
        finally:
            spark.catalog.dropTempView(view)
