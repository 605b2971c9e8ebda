"""Expressions as SQL text, with the names and signs of Column expressions.

An event takes some six thousand expression nodes. As Columns each costs a dozen
round trips to the JVM, about fifteen seconds in all; as text they are put together here
and parsed there at once. Used like ``pyspark.sql.functions``: a function is
its SQL namesake, text arguments name columns but where LITERALS says otherwise.
"""

from __future__ import annotations

import inspect
import itertools
import sys
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions

#: Arguments that are literals when given as text, by place.
LITERALS = {"array_contains": (1,), "array_position": (1,), "split": (1,), "regexp_replace": (1, 2), "regexp_extract": (1,), "substring_index": (1,), "translate": (1, 2), "array_join": (1,), "concat_ws": (0,), "lpad": (2,), "rpad": (2,), "locate": (0,), "date_format": (1,)}
_NAMES = itertools.count()


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    quoted = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    return f"'{quoted}'"


class Sql:
    """One expression."""

    def __init__(self, text: str):
        self.text = text

    def column(self) -> Column:
        return functions.expr(self.text)

    def _with(self, sign: str, other) -> Sql:
        return Sql(f"({self.text} {sign} {_text(other)})")

    def __eq__(self, other) -> Sql:  # type: ignore[override]
        return self._with("=", other)

    def __ne__(self, other) -> Sql:  # type: ignore[override]
        return self._with("<>", other)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other) -> Sql:
        return self._with("<", other)

    def __le__(self, other) -> Sql:
        return self._with("<=", other)

    def __gt__(self, other) -> Sql:
        return self._with(">", other)

    def __ge__(self, other) -> Sql:
        return self._with(">=", other)

    def __and__(self, other) -> Sql:
        return self._with("AND", other)

    def __or__(self, other) -> Sql:
        return self._with("OR", other)

    def __invert__(self) -> Sql:
        return Sql(f"(NOT {self.text})")

    def __add__(self, other) -> Sql:
        return self._with("+", other)

    def __sub__(self, other) -> Sql:
        return self._with("-", other)

    def __mul__(self, other) -> Sql:
        return self._with("*", other)

    def __truediv__(self, other) -> Sql:
        return self._with("/", other)

    def __getitem__(self, field: str) -> Sql:
        return Sql(f"({self.text}).`{field}`")

    __iter__ = None  # indexing would make it endless

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value: use &, | and ~")

    def alias(self, name: str) -> Named:
        return Named(self.text, name)

    def cast(self, kind: str) -> Sql:
        return Sql(f"CAST({self.text} AS {kind})")

    def try_cast(self, kind: str) -> Sql:
        return Sql(f"TRY_CAST({self.text} AS {kind})")

    def isNull(self) -> Sql:
        return Sql(f"({self.text} IS NULL)")

    def isNotNull(self) -> Sql:
        return Sql(f"({self.text} IS NOT NULL)")

    def isin(self, *values) -> Sql:
        return Sql(f"({self.text} IN ({', '.join(map(_text, values))}))")

    def contains(self, part) -> Sql:
        return Sql(f"contains({self.text}, {_text(part)})")

    def startswith(self, part) -> Sql:
        return Sql(f"startswith({self.text}, {_text(part)})")

    def endswith(self, part) -> Sql:
        return Sql(f"endswith({self.text}, {_text(part)})")

    def rlike(self, pattern: str) -> Sql:
        return Sql(f"rlike({self.text}, {_literal(pattern)})")

    def bitwiseAND(self, other) -> Sql:
        return self._with("&", other)


class Named(Sql):
    """An expression with a name, for structs."""

    def __init__(self, text: str, name: str):
        super().__init__(text)
        self.name = name


class Case(Sql):
    """CASE with branches to come."""

    def __init__(self, branches: tuple[str, ...], last: str | None = None):
        self.branches = branches
        super().__init__(f"CASE {' '.join(branches)}{f' ELSE {last}' if last else ''} END")

    def when(self, condition: Sql, value) -> Case:
        return Case((*self.branches, f"WHEN {condition.text} THEN {_text(value)}"))

    def otherwise(self, value) -> Case:
        return Case(self.branches, _text(value))


def _text(value) -> str:
    return value.text if isinstance(value, Sql) else _literal(value)


def _lambda(f: Callable) -> str:
    names = [f"x{next(_NAMES)}" for p in inspect.signature(f).parameters.values() if p.default is p.empty]
    body = f(*(Sql(n) for n in names))
    head = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{head} -> {_text(body)}"


def _argument(value, literal: bool) -> str:
    if callable(value):
        return _lambda(value)
    if isinstance(value, str) and not literal:
        return col(value).text
    return _text(value)


def col(name: str) -> Sql:
    return Sql(name if "`" in name else f"`{name}`")


def lit(value) -> Sql:
    return Sql(_text(value))


def expr(text: str) -> Sql:
    return Sql(f"({text})")


def when(condition: Sql, value) -> Case:
    return Case((f"WHEN {condition.text} THEN {_text(value)}",))


def struct(*fields: Named) -> Sql:
    return Sql(f"named_struct({', '.join(f'{_literal(f.name)}, {f.text}' for f in fields)})")


def create_map(*items) -> Sql:
    return Sql(f"map({', '.join(map(_text, items))})")


def from_xml(text: Sql, schema: str, options: dict[str, str]) -> Sql:
    return Sql(f"from_xml({text.text}, {_literal(schema)}, map({', '.join(_literal(x) for kv in options.items() for x in kv)}))")


def from_json(text: Sql, schema: str) -> Sql:
    return Sql(f"from_json({text.text}, {_literal(schema)})")


def sort_array(array, asc: bool = True) -> Sql:
    return Sql(f"sort_array({_argument(array, False)}, {_literal(asc)})")


def try_to_timestamp(text: Sql, pattern: str) -> Sql:
    return Sql(f"try_to_timestamp({text.text}, {_literal(pattern)})")


def of(expression):
    """The functions that go with an expression: these for text, PySpark's for Columns."""
    return functions if isinstance(expression, Column) else sys.modules[__name__]


def __getattr__(name: str) -> Callable[..., Sql]:
    if name.startswith("__"):
        raise AttributeError(name)
    places = LITERALS.get(name, ())

    def call(*arguments) -> Sql:
        return Sql(f"{name}({', '.join(_argument(a, i in places) for i, a in enumerate(arguments))})")

    return call
