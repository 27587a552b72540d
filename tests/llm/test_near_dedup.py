import random
import re

import numpy as np
import pytest

from touchpoint.llm import near_dedup
from touchpoint.llm.components import components

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=4):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute(rows, size=4):
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rnd, text, share):
    words = text.split()
    for _ in range(max(1, int(len(words) * share))):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus(prose):
    rnd = random.Random(3)
    texts = [prose(100 + k, rnd.randrange(3, 300)) for k in range(60)]
    base = prose(77, 180)
    texts += [edited(rnd, base, rnd.choice([0.01, 0.02, 0.03, 0.05, 0.08])) for _ in range(60)]  # a cloud around one text
    texts += [base.upper(), base, base]
    shared = prose(55, 60)
    texts += [f"{prose(900 + k, 20)} {shared} {prose(990 + k, 25)}" for k in range(30)]  # a common passage
    chain = prose(500, 60)
    for _ in range(8):  # each near the one before it, the ends far apart
        chain = edited(rnd, chain, 0.02)
        texts.append(chain)
    texts += ["two words", "two words", "Two  Words", "three short words", "", None, " "]
    rnd.shuffle(texts)
    return [(k * 3 + 5, t) for k, t in enumerate(texts)]


@pytest.mark.parametrize("block", [256, 8])
@pytest.mark.parametrize("size", [4, 5])
def test_components_against_all_pairs(make_docs, corpus, monkeypatch, block, size):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup.star_blocks, "__defaults__", (block,))
    monkeypatch.setattr(near_dedup.cross_blocks, "__defaults__", (block,))
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(make_docs(corpus), size).collect()}
    want = brute(corpus, size)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_without_broadcast(make_docs, corpus, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_NODES", 0)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make_docs(corpus)).collect()}
    assert got == {i: c for i, (_, c) in brute(corpus).items()}


def test_odd_rows(make_docs, odd_rows):
    got = [tuple(r)[:4] for r in near_dedup.near_duplicates(make_docs(odd_rows, clashing=True)).collect()]
    want = brute(odd_rows)
    assert len(got) == len(odd_rows)
    for i, n, component, kept in got:
        if i is None:
            assert component is None and kept
        else:
            assert (n, component, kept) == (*want[i], want[i][1] == i)
    assert near_dedup.near_duplicates(make_docs([])).count() == 0
    blank = near_dedup.near_duplicates(make_docs([(1, ""), (2, None)])).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] and r["n_shingles"] == 0 for r in blank)


def test_one_of_each(make_docs, odd_rows):
    docs = make_docs(odd_rows, clashing=True)
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 9, 10] and ids.count(None) == 2
    assert near_dedup.one_of_each(make_docs([])).count() == 0


def test_estimates_and_intersections():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**62, 3000)
    sets = [np.unique(rng.choice(pool, n)) for n in (10, 500, 800, 900, 1000)]
    both = near_dedup.intersections(sets)
    assert all(both[a, b] == len(np.intersect1d(sets[a], sets[b])) for a in range(5) for b in range(5) if a != b)
    near = near_dedup.estimates([s[:64] for s in sets])
    exact = np.array([[len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for b in sets] for a in sets])
    assert np.abs(near - exact)[~np.eye(5, dtype=bool)].max() < 0.25


def test_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(1000, 1001), (1001, 1000), (5000, 5000)], "u long, v long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(n + 1)}, 1000: 1000, 1001: 1000}


def test_texts_that_share_an_id_are_told_apart(make_docs, prose):
    rnd = random.Random(8)
    a, b, c = prose(31, 120), prose(32, 120), prose(33, 120)
    rows = [(1, a), (1, b), (5, edited(rnd, a, 0.005)), (6, edited(rnd, b, 0.005)), (7, c), (None, edited(rnd, c, 0.005)), (None, prose(34, 90)), (None, prose(34, 90)), (9, None), (9, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(make_docs(rows)).collect() if r["doc_id"])
    assert got == [(1, 1, True), (1, 1, True), (5, 1, False), (6, 1, False), (7, 7, True), (9, 9, True), (9, 9, True)]
    out = near_dedup.one_of_each(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(1, a), (1, b), (7, c), (None, prose(34, 90)), (9, None)], key=str)


def test_no_text_vanishes_with_a_copy_under_its_id(make_docs, prose):
    a, b = prose(41, 90), prose(42, 90)
    out = near_dedup.one_of_each(make_docs([(1, a), (1, b), (2, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == sorted([(1, a), (1, b)])


def test_long_regular_words_are_told_apart(make_docs):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {word} y {word} z"), (2, f"x {other} y {other} z")]
    assert all(r["kept"] for r in near_dedup.near_duplicates(make_docs(rows)).collect())


def test_word_hashes_depend_on_the_word_only():
    data = np.frombuffer(b"one  two one\ttwo onetwo", np.uint8)
    starts, ends, _ = near_dedup.word_spans(data, np.array([0, len(data)]))
    h = near_dedup.word_hashes(data, starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_a_cloud_of_near_copies_needs_no_pairs(spark, make_docs, prose, monkeypatch):
    rnd = random.Random(5)
    base = prose(88, 400)
    rows = [(k, edited(rnd, base, 0.003)) for k in range(700)]
    seen = []
    star = near_dedup.star_blocks
    monkeypatch.setattr(near_dedup, "star_blocks", lambda members: seen.append(star(members, 16)) or seen[-1])
    monkeypatch.setattr(near_dedup, "cross_blocks", lambda *a: pytest.fail("nodes linked to their pivot are compared again"))
    got = near_dedup.near_duplicates(make_docs(rows)).collect()
    assert {r["component_id"] for r in got} == {0}
    # a row per node and cloud, and one more for every block of 16
    clouds_of = seen[0].where("node != pivot").count()
    assert seen[0].count() <= clouds_of * 18 / 16 + seen[0].select("pivot").distinct().count()


def test_recall_of_borderline_pairs(make_docs, prose, capsys):
    """Pairs with a Jaccard similarity just above the threshold."""
    rnd = random.Random(12)
    rows, wanted = [], {}
    for k in range(400):
        words = prose(3000 + k, 300).split()
        other = words[:]
        for _ in range(rnd.randrange(6, 9)):
            other[rnd.randrange(len(other))] = f"new{rnd.randrange(10**6)}"
        a, b = shingles(" ".join(words)), shingles(" ".join(other))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        share = len(a & b) / len(a | b)
        if 0.8 <= share <= 0.85:
            wanted[2 * k + 1] = 2 * k
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(make_docs(rows)).collect()}
    caught = sum(got[i] == c for i, c in wanted.items())
    with capsys.disabled():
        print(f"pairs at 0.80 to 0.85: {len(wanted)}, linked: {caught}")
    assert len(wanted) > 100 and caught == len(wanted)
