"""Conversation repair against plain Python: a recursion from the end, over whole texts."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from touchpoint.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())) for c, v in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, audit), by the rest of the conversation from each row and state."""
    sys.setrecursionlimit(100_000)

    @lru_cache(None)
    def rest(i, state, inserted):
        options = []
        wanted = "a" if state == "u" else "u"
        if i == len(initials) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 2:
            cost, audit = rest(i, wanted, inserted + 1)
            options.append((cost + 2, "I" + audit))
        if i < len(initials):
            cost, audit = rest(i + 1, state, 0)
            options.append((cost + 3, "D" + audit))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                cost, audit = rest(i + 1, wanted, 0)
                options.append((cost + 2 + extra, "R" + audit))
                if initials[i] == wanted:
                    options.append((cost + extra, "K" + audit))
                if initials[i] == "s" and state == "":
                    cost, audit = rest(i + 1, "s", 0)
                    options.append((cost + extra, "K" + audit))
        return min(options, default=(10**9, ""))

    return rest(0, "", 0)


def edited(rows, audit):
    out, state, at = [], "", 0
    for e in audit:
        wanted = "assistant" if state == "u" else "user"
        if e == "I":
            out.append((wanted, ""))
            state = wanted[0]
            continue
        _, role, text = rows[at]
        at += 1
        if e != "D":
            role = wanted if e == "R" else role
            out.append((role, text))
            state = role[0]
    assert at == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[0][0] for r in out))
    return out


def repaired(rows):
    out = []
    for c, kept in damaged(rows).items():
        faults, initials = faults_of(kept), [r[1][:1] for r in kept]
        cost, audit = cheapest(initials, tuple(faults))
        turns = [t for t, *_ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        lines = "\n".join(f"{r}:{t}" for r, t in edited(kept, audit))
        out.append((c, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), len(kept)))
    return sorted(out, key=str)


def made(seed, conv, turns, odd=0.2):
    rnd = random.Random(seed)
    rows, role = [], "system" if rnd.random() < 0.3 else "user"
    for t in range(turns):
        text = rnd.choice(["Yes.", "No!", "Why?", "so", "", " \t", "end. ", "a\nb.", "été?"]) + (str(rnd.randrange(99)) + rnd.choice([".", ""]) if rnd.random() < 0.8 else "")
        rows.append((conv, t * (1 if rnd.random() < 0.9 else 2), role if rnd.random() > odd else rnd.choice(["user", "assistant", "system", "tool", "", None, "User"]), text if rnd.random() > 0.02 else None))
        role = "assistant" if role == "user" else "user"
    return rows


@pytest.fixture(scope="module")
def talks():
    rows = [r for k in range(150) for r in made(k, k, random.Random(k).randrange(1, 14), (k % 5) / 5)]
    rows += made(900, None, 9) + [(700, None, "user", "x."), (700, None, "user", "x."), (700, 3, "user", "x."), (700, None, "tool", "y"), (701, None, None, None)]
    rows += [(800, 1, "user", "same."), (800, 1, "user", "same."), (800, 1, "assistant", "other."), (800, 1, "assistant", "another."), (801, 5, "assistant", "long " * 30_000)]
    rows += [(c, 7, "user", "gone.") for c in range(1000, 1060)]  # some lose their only row
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).repartition(3)


def test_repair(spark, talks):
    given = frame(spark, talks).withColumns({n: F.lit(1) for n in ("kind", "piece", "fault", "digest", "audit", "cost", "gone")})
    got = C.repair(C.damage(given))
    assert got.columns[:9] == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = repaired(talks)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[9] == 0 and r[7] == "" for r in want)


def test_repaired_rows(spark, talks):
    got = {}
    for r in sorted(C.repaired_rows(C.damage(frame(spark, talks))).collect(), key=lambda r: r["position"]):
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = {}
    for c, kept in damaged(talks).items():
        lines = edited(kept, cheapest([r[1][:1] for r in kept], tuple(faults_of(kept)))[1])
        if lines:
            want[c] = lines
    assert got == want


def test_a_conversation_cut_into_pieces(spark, monkeypatch):
    rows = made(5, 1, 900, 0.6) + made(6, 2, 700, 0.9) + [(3, t, "user", f"{t}") for t in range(300)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hurt = C.damage(frame(spark, rows))
        got = sorted(map(tuple, C.repair(hurt).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == repaired(rows)


def plain(initials, faults):
    return cheapest(initials, tuple({C.BLANK: "blank", C.DUPLICATE: "duplicate", C.TRUNCATED: "truncated"}.get(f, "") for f in faults))


def solved(initials, faults):
    a = C.Audits(C.NONE)
    for i, f in zip(initials, faults):
        a.row(i, f)
    return min((a.best[s][0], a.text(a.best[s][1])) for s in (C.NONE, C.ASSISTANT) if a.best[s])


def drawn(seed, n):
    rnd = random.Random(seed)
    return [rnd.choice("suat") for _ in range(n)], [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]


@pytest.mark.parametrize("modulus", [C.MODULUS, 1, 5])
def test_audits_when_hashes_collide(monkeypatch, modulus):
    monkeypatch.setattr(C, "MODULUS", modulus)
    for seed in range(120):
        initials, faults = drawn(seed, seed % 40)
        assert solved(initials, faults) == plain(initials, faults)


def test_settled_beginnings(monkeypatch):
    monkeypatch.setattr(C, "SETTLE", 16)
    for seed in range(40):
        initials, faults = drawn(seed, 900 if seed == 0 else 120)
        assert solved(initials, faults) == plain(initials, faults)


def test_a_long_conversation_keeps_few_nodes():
    a = C.Audits(C.NONE)
    for k in range(20_000):
        a.row("ua"[k % 2] if k % 7 else "s", C.TRUNCATED if k % 11 == 0 else C.OK)
    node = max((h[1] for h in a.best if h), key=lambda n: n.depth)
    assert node.depth - a.base < 2 * C.SETTLE and len(a.text(node)) == node.depth


def test_empty(spark):
    assert C.repair(C.damage(spark.createDataFrame([], ROWS))).count() == 0
