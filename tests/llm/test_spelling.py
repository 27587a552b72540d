"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from touchpoint.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts_of(rows):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def near_of(n):
    out = {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)]
        out[w] = (len(near), min(near, key=lambda v: (-n[v], v)) if near else None)
    return out


def variants_of(rows):
    n = counts_of(rows)
    near = near_of(n)
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, (_, b) in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], near[w][0], n[form[w]] if form[w] else None) for w in n), key=str)


def made_words(seed, count, letters="abé", low=6, high=9):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(letters) for _ in range(rnd.randint(low, high))) for _ in range(count)]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(3)
    words = made_words(1, 150)
    weighted = [w for k, w in enumerate(words) for _ in range(3 + 200 // (k + 1))]
    long = made_words(2, 4, "ab", 300, 400) + made_words(5, 3, "xyz", 63, 66)
    weighted += [v for w in long for v in [w] * 60 + [w[:7] + w[8:]] * 6 + [w[:-2] + "é" + w[-2:]] * 5 + ["z" + w[1:]] * 5]
    weighted += ["colour"] * 290 + ["color"] * 50 + ["colours"] * 42 + ["colouts"] * 5 + ["COLOUR"] * 3 + ["Éclair", "éclair"] * 9
    rnd.shuffle(weighted)
    return [(k % 40 if k % 41 else None, " ".join(weighted[k::60]) + rnd.choice([".", "", " ×÷-1colour2"])) for k in range(60)]


def test_variants(make_docs, texts, odd_rows):
    rows = texts + texts[:5] + odd_rows
    got = spelling.variants(make_docs(rows, clashing=True))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = variants_of(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert any(r[1] and r[2] != r[1] for r in want) and any(len(r[0]) > 300 and r[1] for r in want)


def test_runs_lose_letters(make_docs):
    rows = [(k, "spelling variant grouping") for k in range(4000)]
    got = sorted(map(tuple, spelling.variants(make_docs(rows)).collect()), key=str)
    assert got == variants_of(rows)
    assert sum(r[2] == "spelling" for r in got) > 1


def as_words(spark, n):
    return spark.createDataFrame(list(n.items()), "word string, n long")


def near_rows(spark, n):
    return {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(as_words(spark, n)).collect()}


def test_groups_of_many_blocks(spark):
    # words that differ in one segment only: one group with hundreds of words
    letters = "abcdefghijklmnopqrstuvwxyz"
    n = {f"word{a}{b}": ord(a) * 100 + ord(b) for a in letters for b in letters}
    n |= {f"word{a}": 5 for a in letters if len(f"word{a}") > 5} | {"words": 3}
    assert near_rows(spark, n) == near_of(n)


def test_groups_of_long_words_are_cut(spark, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_BYTES", 2000)
    rnd = random.Random(7)
    base = "".join(rnd.choice("acgt") for _ in range(400))
    n = {base: 9}
    for k in range(120):
        at = 200 + rnd.randrange(8)
        n[base[:at] + rnd.choice(["", "acgt"[k % 4], "tt", "g" + base[at]]) + base[at + 1 :]] = 5 + k
        n[base[:at] + "ca"[k % 2] + base[at + 1 : at + 3] + "gt"[k % 2] + base[at + 4 :]] = 7 + k
    assert near_rows(spark, n) == near_of(n)


def test_empty(make_docs):
    assert spelling.variants(make_docs([])).count() == 0
    assert spelling.variants(make_docs([(1, None), (2, "")])).count() == 0
