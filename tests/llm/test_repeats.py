import hashlib
import random

import numpy as np
import pytest

from touchpoint.llm import repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for d, data in enumerate(texts):
        for p in range(len(data) - length + 1):
            seen.setdefault(data[p : p + length], []).append((d, p))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, p in places:
                gone[d][p : p + length] = b"\1" * length
    out = []
    for (doc_id, _), data, g in zip(rows, texts, gone):
        kept = bytes(b for b, x in zip(data, g) if not x)
        out.append((doc_id, len(data), sum(g), bytes(g).replace(b"\0", b" ").decode().split().__len__(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(8)
    passage, edge = prose(1, 40), prose(2, 25)
    rows = [(k, prose(10 + k, rnd.randrange(5, 90))) for k in range(25)]
    rows += [(100 + k, f"{prose(200 + k, rnd.randrange(0, 20))} {passage} {prose(300 + k, rnd.randrange(0, 20))}") for k in range(15)]
    rows += [(200 + k, f"{prose(400 + k, 8)} {edge[k:]}") for k in range(20)]
    rows += [(300, "ab" * 300), (301, "a" * 500), (302, passage), (303, passage), (304, "é" * 120 + passage)]
    return rows


@pytest.mark.parametrize(("length", "piece", "hot"), [(100, 16, 1 << 22), (100, 16, 300), (60, 16, 0), (400, 48, 1 << 22)])
def test_against_all_windows(make_docs, corpus, monkeypatch, length, piece, hot):
    monkeypatch.setattr(repeats, "HOT_BYTES", hot)
    got = sorted(map(tuple, repeats.dedup(make_docs(corpus), length, piece).collect()), key=str)
    assert got == brute(corpus, length)
    assert sum(r[2] for r in got) > 0


def test_odd_rows(make_docs, odd_rows):
    got = sorted(map(tuple, repeats.dedup(make_docs(odd_rows, clashing=True)).collect()), key=str)
    assert got == brute(odd_rows, repeats.LENGTH)
    assert repeats.dedup(make_docs([])).count() == 0


def test_long_documents_are_cut_with_overlap(make_docs, prose, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "BROADCAST_IDS", 0)
    text = prose(5, 900)
    rows = [(1, text), (2, prose(6, 30) + text[900:2600] + prose(7, 30)), (3, prose(8, 500))]
    assert sorted(map(tuple, repeats.dedup(make_docs(rows), 100, 16).collect()), key=str) == brute(rows, 100)


def test_matching_statistics():
    rnd = random.Random(3)
    for _ in range(100):
        strings = [bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(30))) for _ in range(rnd.randrange(1, 6))]
        strings += strings[:1] * rnd.randrange(2)
        index, begins = repeats.run_index(strings)
        got = repeats.matching_statistics(index)
        places = [(i, p) for i, s in enumerate(strings) for p in range(len(s))]

        def common(a, b):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            return n

        for i, p in places:
            assert got[begins[i] + p] == max((common(strings[i][p:], strings[j][q:]) for j, q in places if (i, p) != (j, q)), default=0)


def test_runs_are_few_in_repetitive_texts(prose):
    one = prose(4, 200).encode()
    index, _ = repeats.run_index([one] * 50)
    assert len(index.heads) < 2 * len(one) + 60 < index.size / 20
    assert np.diff(index.heads).sum() + 1 <= index.size


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(3)
    data = bytes(rnd.choice(b"abcd") for _ in range(3000))
    data = np.frombuffer(data + data[100:900] + b"a" * 900, np.uint8)
    offsets = np.array([0, 2000, 3300, len(data)])
    whose, start, n, anchor, _, place = repeats.stretches(data, offsets)
    seen = {}
    for k in range(len(whose)):
        for p in range(start[k], start[k] + n[k]):
            window = data[offsets[whose[k]] + p :][:400].tobytes()
            assert seen.setdefault(window, (anchor[k], place[k] - p)) == (anchor[k], place[k] - p)
    assert n.sum() == sum(max(0, b - a - 399) for a, b in zip(offsets, offsets[1:]))
