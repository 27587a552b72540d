"""Quality rules and decontamination, against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from touchpoint.llm import decontaminate, quality

WORD = "[^\x20\x09-\x0d]+"


def quality_of(text):
    text = text or ""
    words = re.findall(WORD, text)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    again = {k + o for k, g in enumerate(grams) if grams.count(g) > 1 for o in (0, 1, 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text))}
    m |= {"n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "n_lines": len(lines)}
    m |= {"n_bullet_lines": sum(bool(re.match("[-*•] ", x.lstrip(" "))) for x in lines), "n_cut_lines": sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)}
    m["n_stop_words"] = sum(w.lower() in quality.STOP_WORDS for w in words)
    base = len(words) < 50 or 100 * len(again) > 50 * len(words)
    ok = all((r.at_least is None or 1000 * m[r.part] >= r.at_least * m[r.whole]) and (r.at_most is None or 1000 * m[r.part] <= r.at_most * m[r.whole]) for r in quality.RULES)
    return m | {"base_failed": base, "kept": not base and ok}


@pytest.fixture(scope="module")
def pages(prose):
    text = prose(3, 80)
    return [
        (20, text),
        (21, "\n".join([prose(4, 12)] * 9)),
        (22, " ".join(w + "***" for w in text.split())),
        (23, "\n".join("- " + prose(k, 9) for k in range(8))),
        (24, "\n".join(prose(k, 9) + ("..." if k % 2 else "… ") for k in range(8))),
        (25, "xyzzy" * 1 + " qwrty plugh" * 40),
        (26, " ".join(f"w{k}" for k in range(60))),
        (27, "a b c a b c " + prose(6, 60)),
        (28, "\n\n \n" + prose(7, 60) + "\x0b\x0c\r\n" + prose(7, 60)),
        (29, "the of " * 40),
    ]


def test_quality(make_docs, odd_rows, pages):
    rows = [(i, t) for i, t in odd_rows if not t or len(t) < 5000] + pages
    got = quality.quality_rules(make_docs(rows, clashing=True)).collect()
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted((r.asDict() for r in got), key=key) == sorted(({"doc_id": i} | quality_of(t) for i, t in rows), key=key)
    assert {r["kept"] for r in got} == {True, False}
    assert quality.quality_rules(make_docs([])).count() == 0


def test_quality_is_one_pass_of_projections(make_docs, pages):
    plan = quality.quality_rules(make_docs(pages).limit(5))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "hashpartitioning" not in plan


def test_quality_of_a_long_text(make_docs, odd_rows):
    text = dict(odd_rows)[6]
    got = quality.quality_rules(make_docs([(6, text)])).first()
    words = text.split()
    seen = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    assert got["n_repeat_words"] == len({k + o for v in seen.values() if len(v) > 1 for k in v for o in (0, 1, 2)})


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def contamination_of(text, items):
    words = words_of(text)
    hit, found = set(), set()
    for item, content in items:
        own = words_of(content)
        for window in [own[k : k + 10] for k in range(len(own) - 9)] if len(own) > 10 else [own] * bool(own):
            for k in range(len(words) - len(window) + 1):
                if words[k : k + len(window)] == window:
                    hit |= set(range(k, k + len(window)))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items(prose):
    return [(1, prose(50, 30)), (2, prose(51, 10)), (10, prose(52, 4)), (3, "Unfindable"), (4, "lonely"), (5, None), (6, ""), (7, " .,;"), (8, prose(50, 30)), (None, prose(53, 12)), (9, "été à"), (11, prose(54, 11))]


@pytest.fixture(scope="module")
def leaked(prose, items):
    text = dict(items)
    return [
        (20, f"{prose(60, 20)} {text[1]} {prose(61, 5)}"),
        (21, text[2].upper().replace(" ", ", ")),
        (22, f"{prose(62, 9)} {text[10]} {text[10]}"),
        (23, " ".join(text[1].split()[5:19]) + " and " + " ".join(text[1].split()[15:])),
        (24, "a lonely word"),
        (25, prose(53, 12)),
        (26, "ÉTÉ à été à"),
        (27, " ".join(text[11].split()[:9])),
        (28, " ".join(reversed(text[1].split()))),
        (20, f"{prose(60, 20)} {text[1]} {prose(61, 5)}"),
        (20, "another text under the same id " + text[2]),
    ]


@pytest.mark.parametrize("small", [True, False])
def test_contamination(spark, make_docs, odd_rows, leaked, items, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(decontaminate, "BROADCAST_IDS", -1)
    rows = [(i, t) for i, t in odd_rows if not t or len(t) < 5000] + leaked
    tests = spark.createDataFrame([(*r, 0, "x") for r in items], "item_id long, text string, w int, term string")
    got = [tuple(r)[:6] for r in decontaminate.contamination(make_docs(rows, clashing=True), tests).collect()]
    assert sorted(got, key=str) == sorted(((i, *contamination_of(t, items)) for i, t in rows), key=str)
    assert sum(r[5] for r in got) >= 7


def near_of(rows, items, terms=3, span=20):
    """Items with a window whose rarest words lie within ``span`` words, for each row."""
    texts = [words_of(t) for _, t in rows]
    n = Counter(w for words in texts for w in words)
    sets = {}
    for item, content in items:
        own = words_of(content)
        for window in [own[k : k + 10] for k in range(len(own) - 9)] if len(own) > 10 else [own] * bool(own):
            need = min(terms, len(set(window)))
            rarest = sorted((n[w], w) for w in set(window) if n[w])[:need]
            if len(rarest) == need:
                sets.setdefault(frozenset(w for _, w in rarest), set()).add(item)
    out = []
    for words in texts:
        found = set()
        for wanted, owners in sets.items():
            if wanted <= set(words) and any(wanted <= set(words[k : k + span]) for k in range(len(words))):
                found |= owners
        out.append(len(found))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_proximity(spark, make_docs, odd_rows, leaked, items, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    rows = [(i, t) for i, t in odd_rows if not t or len(t) < 5000] + leaked
    got = [(r["doc_id"], r["n_words"], r["n_near_items"]) for r in decontaminate.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()]
    want = [(i, len(words_of(t)), n) for (i, t), n in zip(rows, near_of(rows, items))]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(n > 0 for *_, n in want) >= 8


def test_proximity_finds_reordered_and_interrupted_items(spark, make_docs, prose):
    t = [f"term{k}" for k in range(10)]
    item, other = " ".join(t), "a b c d e f g h i j"
    rows = [
        (1, " ".join(t[::-1])), (2, " ".join([*t[:5], "inserted", *t[5:]])), (3, (" " + prose(5, 40) + " ").join([" ".join(t[:2]), " ".join(t[2:5]), " ".join(t[5:])])),
        (4, f"{t[0]} {prose(6, 5)} {t[1]} {prose(7, 5)} {t[2]} {t[9]}"), (5, prose(6, 50)), (6, "a b of which the rest occurs nowhere"), (7, " ".join(t[k] for k in (3, 1, 4, 0, 5, 9, 2, 6, 8, 7))),
    ]
    items = [(1, item), (2, other)]
    got = {r["doc_id"]: (r["contaminated"], r["n_near_items"]) for r in decontaminate.contamination(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    near = dict(zip([i for i, _ in rows], near_of(rows, items)))
    assert got == {i: (False, n) for i, n in near.items()}
    assert near[1] == near[2] == near[7] == 1 and near[5] == near[6] == 0
    # with a verbatim copy in the corpus the same documents are found
    got = {r["doc_id"]: r["n_near_items"] for r in decontaminate.contamination(make_docs([*rows, (8, item)]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[1] == got[2] == got[7] == got[8] == 1


def test_contamination_of_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(make_docs(odd_rows), none).collect()
    assert len(got) == len(odd_rows) and not any(r["contaminated"] or r["n_items"] for r in got)
    assert decontaminate.contamination(make_docs([]), none).count() == 0


def test_clean_documents(spark, make_docs, odd_rows, leaked, items):
    rows = [(i, t) for i, t in odd_rows if not t or len(t) < 5000] + leaked
    docs = make_docs(rows, clashing=True)
    out = decontaminate.clean_documents(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in out.select("doc_id", "text").na.fill(-1).collect() if r["text"] is not None) == sorted((-1 if i is None else i, t) for i, t in rows if t is not None and not contamination_of(t, items)[4])
