"""Operator 11 against an enumeration of all edits and a plain program on strings."""
from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from caseweave.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")


def enumerate_all(rows):
    """Every edit sequence with up to three insertions between rows: the cheapest, then the ASCII-least audit."""
    best = None
    choices = []
    for initial, fault in rows:
        out = [("D", "", 3)]
        if fault < cr.BLANK:
            more = fault == cr.CUT_SHORT
            out += [("K", initial, more), ("R", "u", 2 + more), ("R", "a", 2 + more)]
        choices.append(out)
    gaps = [("I" * n, "".join(w), 2 * n) for n in range(4) for w in itertools.product("ua", repeat=n)]
    for own in itertools.product(*choices):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            cost = sum(c[2] for c in own) + sum(g[2] for g in between)
            if best and cost > best[0]:
                continue
            parts = [between[0], *itertools.chain.from_iterable(zip(own, between[1:]))]
            if LEGAL.fullmatch("".join(p[1] for p in parts)):
                found = (cost, "".join(p[0] for p in parts))
                best = found if best is None else min(best, found)
    return best


def on_strings(rows):
    """The same program with whole strings in its cells."""
    def close(c):
        add = lambda q: [(c[q][0] + 2, c[q][1] + "I")] if q in c else []
        ended = add("a")
        for q, more in (("u", add("n") + add("s")), ("a", None), ("u", ended)):
            more = add("u") if q == "a" else more
            if q in c or more:
                c[q] = min(([c[q]] if q in c else []) + more)
        return c

    cells = close({"n": (0, "")})
    step = {("n", "s"): "s", ("n", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for initial, fault in rows:
        new = {}
        for q, (cost, text) in cells.items():
            new.setdefault(q, []).append((cost + 3, text + "D"))
            if fault < cr.BLANK:
                more = int(fault == cr.CUT_SHORT)
                if (q, initial) in step:
                    new.setdefault(step[q, initial], []).append((cost + more, text + "K"))
                new.setdefault("a" if q == "u" else "u", []).append((cost + 2 + more, text + "R"))
        cells = close({q: min(v) for q, v in new.items()})
    return min(cells[q] for q in "na" if q in cells)


def solve(rows, **kw):
    repair = cr.Repair(**kw)
    for initial, fault in rows:
        repair.add(initial, fault)
    return repair.result()


def test_short_conversations_equal_the_enumeration():
    kinds = [(i, f) for i in "sua " for f in range(4)]
    for rows in [(), *itertools.product(kinds, repeat=1), *itertools.product(kinds, repeat=2)]:
        want = enumerate_all(rows)
        assert solve(rows) == want == on_strings(rows)
    rng = random.Random(5)
    for _ in range(12):
        rows = [rng.choice(kinds) for _ in range(3)]
        assert solve(rows) == enumerate_all(rows)


@pytest.mark.parametrize("kw", [{}, {"settle_at": 8}, {"base": 1, "modulus": 2}, {"base": 3, "modulus": 5, "settle_at": 30}, {"modulus": 1}])
def test_long_conversations_equal_the_program_on_strings_also_when_hashes_collide(kw):
    rng = random.Random(8)
    for n in (5, 40, 300):
        for weights in ((1, 1, 1, 1), (8, 8, 1, 0), (1, 1, 0, 0), (0, 1, 9, 0)):
            for faults in ((6, 1, 1, 1), (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 1), (1, 4, 1, 0)):
                rows = list(zip(rng.choices("uas ", weights, k=n), rng.choices(range(4), faults, k=n)))
                assert solve(rows, **kw) == on_strings(rows)


def test_settled_prefixes_leave_few_nodes():
    repair = cr.Repair(settle_at=64)
    for i in range(20_000):
        repair.add("ua"[i % 2 if i % 97 else 0], 0)
    assert len(repair.audits.edit) < 400 and len(repair.result()[1]) >= 20_000


def plain(rows):
    """The report of one conversation, given as (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    seen, flags = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        flags.append(cr.BLANK if not body else cr.REPEAT if (role, text) in seen else cr.OK if body[-1] in ".!?" else cr.CUT_SHORT)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = on_strings(list(zip(initials, flags)))
    replay = cr.Replay(audit)
    edits = [e for _, role, text in rows for e in replay.row(role, text)]
    lines = [f"{role}:{text}" for _, e, role, text in edits if e != "D"]
    assert LEGAL.fullmatch("".join(x[0] for x in lines)) and [e[0] for e in edits] == list(range(1, len(audit) + 1))
    turns = {t for t, _, _ in rows if t is not None}
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, flags.count(cr.BLANK), flags.count(cr.REPEAT), flags.count(cr.CUT_SHORT),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_report_with_nulls_ties_long_conversations_and_clashing_columns(spark):
    rng = random.Random(2)
    texts = ["Hi.", "no end", "", None, " \t", "What?\n", "ü 日本.", "x" * 3000, "Hi.", "a:b\nc!"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", None, "tool", ""]),
             rng.choice(texts)) for _ in range(120)]
    rows += [(7, i, "ua"[i % 2].replace("u", "user").replace("a", "assistant") if i % 13 else "system", f"row {i % 800}.") for i in range(3000)]
    rows += [rows[3]] * 3 + [(8, None, None, None), (9, 4, "user", "Bye.")]
    df = spark.createDataFrame([(c, t, r, x, "k", 0, "z") for c, t, r, x in rows],
                               "conv_id long, turn long, role string, text string, audit string, row int, edit string").repartition(5)
    everything = df.select("conv_id").union(spark.createDataFrame([(55,)], "conv_id long"))
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair_report(df, everything).collect()}
    want = {c: plain([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    want[55] = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want
    assert cr.repair_report(df.where("false"), df.where("false")).count() == 0
    _, edited = cr.repair(df)
    out = edited.where("conv_id = 9").collect()
    assert sorted((r["position"], r["edit"], r["role"], r["text"]) for r in out) == [(1, "K", "user", "Bye."), (2, "I", "assistant", "")]
