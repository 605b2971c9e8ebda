import hashlib
from collections import defaultdict

import pytest

pytest.importorskip("logloom.llm")
from logloom.llm import mixing as M

ROWS = [(i, "w " * (i % 7 + 1) if i % 11 else None, "en" if i % 3 else "fr", f"src{i % 6}" if i % 2 else "src1") for i in range(200)] + [(500, "a b", None, None), (501, "", "en", "odd"), (3, "w " * 4, "fr", "src3"), (502, "x " * 50000, "de", "src2"), (None, "n n n", "en", "src1")]


def fill(budget, children):
    """Shares by weight within limits, what is left over handed round again."""
    share = dict.fromkeys(children, 0.0)
    open_ = set(children)
    while open_:
        rest = budget - sum(share[c] for c in children if c not in open_)
        level = rest / sum(children[c][1] for c in open_)
        full = {c for c in open_ if children[c][0] <= level * children[c][1]}
        for c in full or open_:
            share[c] = children[c][0] if full else level * children[c][1]
        open_ = open_ - full if full else set()
    return {c: int(v + 1e-9) for c, v in share.items()}


def brute(rows):
    numbered = defaultdict(list)
    for d, t, lang, s in rows:
        digits = "".join(c for c in (s or "") if c.isdigit())
        domain = list(M.DOMAINS)[int(digits) % 4] if digits else "web"
        numbered[(domain, lang or "", s or "")].append((d, len((t or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in numbered.items()}
    up = lambda k: {p[: len(k) + 1]: sum(M.EPOCHS * tokens[q] for q in tokens if q[: len(k) + 1] == p[: len(k) + 1]) for p in tokens if p[: len(k)] == k}
    weight = [M.DOMAINS, M.LANGUAGES, {}]

    def down(k, budget):
        if len(k) == 3:
            return {k: budget}
        shares = fill(budget, {c: (n, weight[len(k)].get(c[-1], 1)) for c, n in up(k).items()})
        return {leaf: b for c, v in shares.items() for leaf, b in down(c, v).items()}

    out = []
    for k, b in down((), sum(tokens.values())).items():
        run = 0
        for e in range(M.EPOCHS):
            key = lambda x: (hashlib.md5(f"{M.SEED}:{e}:{'' if x[0] is None else x[0]}".encode()).hexdigest(), str(x[0]), x[1])  # noqa: B023, E731
            for d, n in sorted(numbered[k], key=key):
                run += n
                if run <= b and tokens[k]:
                    out.append((d, k[0], e, n))
    return sorted(out, key=str)


def test_selection_matches_brute_force(spark):
    docs = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, lang string, source string, domain int").repartition(5)
    out = M.mix(docs)
    assert sorted(((r.doc_id, r.domain, r.epoch, r.tokens) for r in out.collect()), key=str) == brute(ROWS)


def test_empty_table(spark):
    assert M.mix(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
