import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from touchpoint.llm import bpe, queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    tokens = bpe.read_ranks(PATH)
    return bpe.Encoder(tokens, *bpe.merge_halves(tokens), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    tokens = bpe.read_ranks(PATH)
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_every_character_splits_and_encodes_alike(encoder, reference):
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF)
    for at in range(0, len(every), 4999):
        part = every[at : at + 4999]
        for text in (part, " ".join(part[:400]), "a".join(part[:400])):
            assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_random_texts(encoder, reference):
    rnd = random.Random(5)
    for _ in range(3000):
        text = "".join(rnd.choice("abcdetshing  \n\t'!.#é ñ1290\x1c\x85\xa0中文\U0001f600aaaa") for _ in range(rnd.randrange(60)))
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("unit", ["a", " ", "ab", "\n", "hello", "é"])
def test_long_runs_stay_linear(encoder, reference, unit):
    text = unit * 20_000
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == reference.encode_ordinary(text)


def test_documents(make_docs, odd_rows, reference):
    rows = bpe.encode_documents(make_docs(odd_rows, clashing=True), PATH, public_tokenizers.PATTERN)
    got = sorted(map(tuple, queries.bpe_digests(rows).collect()), key=str)
    want = []
    for doc_id, text in odd_rows:
        ids = np.array(reference.encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0


def test_ranks_must_be_complete(tmp_path):
    (tmp_path / "bad").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        bpe.read_ranks(str(tmp_path / "bad"))


def naive_sections(text, ids, tokens, rule):
    data = text.encode()
    lines = text.split("\n")
    cuts, at = [0], 0
    for k, line in enumerate(lines):
        at += len(line) + (k + 1 < len(lines))
        cuts.append(at)
    if len(cuts) > 2 and cuts[-1] == cuts[-2]:
        cuts.pop()
    char_of = [k for k, c in enumerate(text) for _ in c.encode()]
    counts, crossing, pos = [0] * (len(cuts) - 1), [0] * (len(cuts) - 1), 0
    for i in ids:
        chars = sorted(set(char_of[pos : pos + len(tokens[i])]))
        pos += len(tokens[i])
        lines_of = [max(k for k in range(len(cuts) - 1) if cuts[k] <= c) for c in chars]
        own = {"first": lines_of[0], "last": lines_of[-1], "largest": max(dict.fromkeys(lines_of), key=lambda x: (lines_of.count(x), -x))}[rule]
        counts[own] += 1
        crossing[own] += len(set(lines_of)) > 1
    assert pos == len(data)
    return [(k, cuts[k], cuts[k + 1], counts[k], crossing[k]) for k in range(len(counts))]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_section_tokens_against_a_loop(make_docs, odd_rows, reference, rule):
    tokens = bpe.read_ranks(PATH)
    extra = [(20, "a\n\n\n b\n\n\n\nc  \n\n d\n"), (21, "\n"), (22, "x\néé\n\n\n\n\n\n\n\U0001f600\n\n"), (23, "\n\n\n\n" * 30)]
    rows = [r for r in odd_rows if not r[1] or len(r[1]) < 5000] + extra
    out = token_counts.section_tokens(make_docs(rows, clashing=True), PATH, public_tokenizers.PATTERN, rule)
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = [(doc_id, *s) for doc_id, text in rows for s in naive_sections(text or "", reference.encode_ordinary(text or ""), tokens, rule)]
    assert got == sorted(want, key=str)
    assert any(r[5] for r in got)


def test_sections_add_up(make_docs, odd_rows, reference):
    out = token_counts.section_tokens(make_docs(odd_rows), PATH, public_tokenizers.PATTERN)
    assert out.where("doc_id = 6").agg({"n_tokens": "sum"}).first()[0] == len(reference.encode_ordinary(dict(odd_rows)[6]))
    assert token_counts.section_tokens(make_docs([]), PATH, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_tokens(make_docs([]), PATH, public_tokenizers.PATTERN, "middle")
