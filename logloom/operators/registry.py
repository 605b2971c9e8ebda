"""Declarative parsers: scoring, selection and extraction compiled to expressions.

A registry is a list of specs (see functions.parser_specs). ``Registry`` also
loads specs from a folder of JSON files, first id wins, bad files skipped, and
lets callers list, get, create, update and test parsers.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from re import _constants, _parser

from pyspark.sql import DataFrame, SparkSession

from ..functions import sqltext as F
from ..functions.columns import PAIRS, Pattern, Steps, as_map, by_number, first_wins, guarded, let, literal_map, pairs, some
from ..functions.ocsf import CONSUMED
from ..functions.parser_specs import FIELDS, SPECS
from ..functions.sqltext import Sql
from .parsed import ALIASES, PATHS, Parsed
from .parsed import FIELDS as READ

LEAST_SCORE = 0.5
CBS = {
    "package.name": (r"(Package(?:_for_)?[A-Za-z0-9_.]*~[0-9a-fA-F]+~[a-zA-Z0-9]+~[^~]*~[\d.]+)", 1),
    "package.architecture": (r"Package(?:_for_)?[A-Za-z0-9_.]*~[0-9a-fA-F]+~([a-zA-Z0-9]+)~[^~]*~[\d.]+", 1),
    "package.version": (r"Package(?:_for_)?[A-Za-z0-9_.]*~[0-9a-fA-F]+~[a-zA-Z0-9]+~[^~]*~([\d.]+)", 1),
    "package.kb": (r"(KB\d{5,})", 1),
    "applicable_state": (r"(?is)ApplicableState:\s*(\d+).*?CurrentState:\s*\d+", 1),
    "current_state": (r"(?is)ApplicableState:\s*\d+.*?CurrentState:\s*(\d+)", 1),
}


def held(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds ('' without any)."""
    runs, now = [], []
    for kind, what in _parser.parse(pattern, re.MULTILINE):
        if kind is _constants.LITERAL:
            now.append(chr(what))
        else:
            runs.append("".join(now))
            now = []
    return max([*runs, "".join(now)], key=len)


class Registry:
    def __init__(self, specs: list[dict] | None = None):
        self.specs = list(SPECS if specs is None else specs)
        self._stamp = None

    @classmethod
    def from_folder(cls, path: str) -> Registry:
        out = cls([])
        out.path = path
        return out.reload()

    def reload(self) -> Registry:
        """Read the folder again if any file's name, time or size changed."""
        names = sorted(n for n in os.listdir(self.path) if n.endswith(".json"))
        stamp = [(n, (s := os.stat(os.path.join(self.path, n))).st_mtime, s.st_size) for n in names]
        if stamp == self._stamp:
            return self
        found: dict[str, dict] = {}
        for n in names:
            try:
                with open(os.path.join(self.path, n), encoding="utf-8") as f:
                    spec = json.load(f)
                found.setdefault(spec["parser_id"], {**dict.fromkeys(FIELDS), "weight": 0.5, "substrings": [], "signature": "", "processes": [], "pattern": "", "mapping": {}, "static": {}, "class_uid": 1001} | spec)
            except (ValueError, KeyError, TypeError):
                continue
        self.specs, self._stamp = list(found.values()), stamp
        return self

    def list(self) -> list[dict]:
        return [dict(s) for s in self.specs]

    def get(self, parser_id: str) -> dict | None:
        return next((dict(s) for s in self.specs if s["parser_id"] == parser_id), None)

    def put(self, spec: dict) -> str:
        """Create or update a parser; without an id it becomes a CUSTOM one."""
        spec = {**dict.fromkeys(FIELDS), "weight": 0.5, "substrings": [], "signature": "", "processes": [], "pattern": "", "mapping": {}, "static": {}, "class_uid": 1001, "source_name": "Unknown", "os_family": "Unknown", "category": "Unclassified"} | spec
        spec["parser_id"] = spec["parser_id"] or f"CUSTOM-{uuid.uuid4().hex[:8]}"
        self.specs = [s for s in self.specs if s["parser_id"] != spec["parser_id"]] + [spec]
        self.specs.sort(key=lambda s: s["parser_id"])
        return spec["parser_id"]

    @staticmethod
    def test(pattern: str, sample: str) -> dict | None:
        """Named groups of a pattern on a sample, null if it does not match."""
        m = re.search(pattern, sample, re.MULTILINE | re.DOTALL)
        return m.groupdict() if m else None

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(s["parser_id"], s["source_name"], s["os_family"], s["category"], int(s["class_uid"]), float(s["weight"])) for s in self.specs]
        return spark.createDataFrame(rows, "parser_id string, source_name string, os_family string, category string, class_uid int, weight double")

    @staticmethod
    def _scores(spec: dict) -> list[int]:
        """Ten-thousandths of the score for each number of substrings met, signature or not, and number of processes met."""
        words, known = spec["substrings"], spec["processes"]
        share = lambda m: 0.4 * (m / len(words)) if words else 0.0
        seen = lambda p: 0.1 * min(p / max(len(known) * 0.3, 1), 1.0) if p else 0.0
        return [round(10_000 * round(min(share(m) + (0.5 if sig else 0.0) + seen(p), 1.0), 4)) for m in range(len(words) + 1) for sig in (0, 1) for p in range(len(known) + 1)]

    @staticmethod
    def _signed(signature: str, raw: Sql) -> Sql:
        """1 where the signature is found; a part that every match holds is looked for first."""
        found = Pattern(signature, "md").found(raw)
        part = held(signature)
        return F.when(raw.contains(part) & found if part else found, 1).otherwise(0)

    def _keys(self, raw: Sql, whole: bool = True) -> Sql:
        """A number for each parser that orders them: by score, then weight, then place.

        Without ``whole``, processes count only where a substring or the signature is met; no other parser can win.
        """
        met = lambda words: sum((raw.contains(w).cast("int") for w in words), F.lit(0))
        ranks = {w: i for i, w in enumerate(sorted({float(s["weight"]) for s in self.specs}))}
        out = []
        for i, s in enumerate(self.specs):
            sig = self._signed(s["signature"], raw) if s["signature"] else F.lit(0)
            width = len(s["processes"]) + 1
            numbers = F.array(*(F.lit(n * 100_000_000 + ranks[float(s["weight"])] * 10_000 + 9_999 - i).cast("bigint") for n in self._scores(s)))
            cell = (met(s["substrings"]) * 2 + sig) * width
            if width == 1:
                out.append(F.get(numbers, cell))
            elif whole:
                out.append(F.get(numbers, cell + met(s["processes"])))
            else:
                out.append(let(cell, lambda c, n=numbers, s=s: F.get(n, F.when(c == 0, 0).otherwise(c + met(s["processes"])))))
        return F.array(*out).cast("array<bigint>")

    @staticmethod
    def _score(key: Sql) -> Sql:
        return F.floor(key / 100_000_000) / F.lit(10_000.0)

    @staticmethod
    def _place(key: Sql) -> Sql:
        return (F.lit(9_999) - F.pmod(key, F.lit(10_000))).cast("int")

    def _listed(self, keys: Sql) -> Sql:
        ids = [s["parser_id"] for s in self.specs]
        return F.transform(F.sort_array(keys, asc=False), lambda e: F.struct(by_number(self._place(e), ids).alias("parser_id"), self._score(e).alias("score")))

    def ranked(self, raw: Sql) -> Sql:
        """All parsers by score, then weight, then id order."""
        return self._listed(self._keys(raw))

    def best(self, raw: Sql) -> Sql:
        """The best score of all parsers."""
        return self._score(F.array_max(self._keys(raw)))

    def steps(self, out: Steps, text: str, open_: Sql) -> Parsed:
        """Adds the registry's columns (null where open_ is false; _rok where the best parser scores enough and its pattern fits)."""
        raw = F.col(text)
        out.withColumn("_rs", guarded(open_, self._keys(raw, whole=False)))
        best = F.array_max("_rs")
        out.withColumns({"_rc": self._score(best), "_rb": self._place(best)})
        out.withColumn("_rw", F.when(F.col("_rc") >= LEAST_SCORE, F.col("_rb")))
        win = F.col("_rw")
        groups = F.when(F.lit(False), F.array().cast("array<string>"))
        for i, s in enumerate(self.specs):
            p = Pattern(s["pattern"], "msd")
            groups = groups.when(win == i, F.when(p.found(raw), p.groups(raw)))
        out.withColumn("_rg", guarded(win.isNotNull(), groups)).withColumn("_rok", F.col("_rg").isNotNull())
        return self._parsed(raw, win)

    def _parsed(self, raw: Sql, win: Sql) -> Parsed:
        # What each parser's groups are for: an event path, a consumed field, or neither.
        paths: list[dict[str, int]] = []
        fields: list[dict[str, int]] = []
        left: list[list[tuple[str, int]]] = []
        mapped: list[list[int]] = []
        statics: list[dict[str, str]] = []
        for s in self.specs:
            at = {n: i for i, n in enumerate(Pattern(s["pattern"]).names) if n}
            # Sources and targets that start with an underscore stay internal.
            shown = {src: path for src, path in s["mapping"].items() if src in at and not src.startswith("_") and not path.startswith("_")}
            paths.append({path: at[src] for src, path in shown.items() if path in PATHS})
            mapped.append([at[src] for src in shown])
            fields.append({n: at[a] for n in READ for a in reversed(ALIASES[n]) if a in at})
            # What is mapped to a path that the event has not is kept under that path.
            left.append([(n, i) for n, i in at.items() if n not in s["mapping"] and n not in CONSUMED] + [(path, at[src]) for src, path in shown.items() if path not in PATHS])
            statics.append({k: str(v) for k, v in (s["static"] or {}).items() if not k.startswith("_")})
        group = lambda places: some(F.get("_rg", by_number(win, places, "int")))
        fixed = lambda name: by_number(win, [x.get(name) for x in statics])
        values: dict[str, Sql] = {}
        for path in PATHS:
            found = [x for x in (group([p.get(path) for p in paths]) if any(path in p for p in paths) else None, fixed(path) if path != "status" and any(path in x for x in statics) else None) if x is not None]
            if found:
                values[path] = F.coalesce(*found)
        for n in READ:
            if any(n in f for f in fields):
                values[n] = group([f.get(n) for f in fields])
        of = lambda key, kind="string": by_number(win, [s[key] for s in self.specs], kind)
        lists = lambda items: F.get(F.split(F.lit("\x02".join("\x03".join(map(str, x)) for x in items)), "\x02"), win)
        places = lambda items: F.filter(F.split(lists(items), "\x03"), lambda x: x != "")
        value = lambda g, i: F.coalesce(F.get(g, i.cast("int")), F.lit(""))
        names, spots = places([[n for n, _ in x] for x in left]), places([[i for _, i in x] for x in left])
        rest = let(F.col("_rg"), lambda g: F.zip_with(names, spots, lambda n, i: F.struct(n.alias("k"), value(g, i).alias("v")))).cast(PAIRS)
        n_mapped = let(F.col("_rg"), lambda g: F.size(F.filter(places(mapped), lambda i: value(g, i) != "")))
        ids = [s["parser_id"] for s in self.specs]
        cbs = ids.index("WIN-CBS-001") if "WIN-CBS-001" in ids else -1
        return Parsed(
            {
                "format": "registry", "parser_id": by_number(win, ids), "source_name": of("source_name"), "product": of("source_name"), "os_family": of("os_family"), "category": of("category"), "class_uid": of("class_uid", "int"),
                "activity_id": of("activity_id", "int"), "activity_name": of("activity_name"), "severity_id": fixed("severity_id").cast("int"), "status": fixed("status"), "status_id": fixed("status_id").cast("int"),
                "unmapped": first_wins(F.filter(rest, lambda e: e["v"] != "")), "n_mapped": n_mapped, "native": F.when(win == cbs, as_map(self._cbs(raw))).otherwise(literal_map({})), "confidence": F.col("_rc"), "candidates": self.ranked(raw),
            },
            values,
        )

    @staticmethod
    def _cbs(raw: Sql) -> dict[str, Sql]:
        component = F.when(raw.contains("CBS"), "CBS").when(raw.contains("CSI"), "CSI")
        return {k: F.regexp_extract(raw, p, g) for k, (p, g) in CBS.items()} | {"component": component}
