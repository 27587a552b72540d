"""Token counts per section (op9): offset-mapped attribution.

A document is encoded once, as a whole, since tokens found in its parts alone would not
be those the model sees. The byte lengths of the tokens give each token's character
span; the spans are joined as intervals to the sections of the document, and a token
that crosses a border goes to one section by an explicit rule:

``largest``  the section that holds most of its characters; of equal ones the first
``first``    the section of its first character
``last``     the section of its last character

So the counts of a document's sections add up to its own count. Sections are the lines
of a text; a line break belongs to the line it ends. A character that several tokens
spell belongs to each of their spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from touchpoint.llm.bpe import encoder_of, share_vocabulary

RULES = ("largest", "first", "last")
#: Sections in one Arrow batch.
OUT_ROWS = 50_000


def character_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end) of each token, given the bytes of the text and of each token."""
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters begun before a byte
    ends = np.cumsum(sizes)
    return begun[ends - sizes + 1] - 1, begun[ends]


def attribute(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str = "largest") -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) per section; section k spans borders[k] to borders[k + 1]."""
    n = len(borders) - 1
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends - 1, "right") - 1
    crosses = first != last
    if rule == "last":
        owner = last
    else:
        owner = first.copy()
        if rule == "largest" and crosses.any():
            c = np.flatnonzero(crosses)
            width = last[c] - first[c] + 1
            token = np.repeat(c, width)
            section = np.arange(len(token)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first[c], width)
            shared = np.minimum(ends[token], borders[section + 1]) - np.maximum(starts[token], borders[section])
            best = np.lexsort((section, -shared, token))
            head = best[np.concatenate(([True], token[best][1:] != token[best][:-1]))]
            owner[token[head]] = section[head]
    return np.bincount(owner, minlength=n), np.bincount(owner[crosses], minlength=n)


def line_borders(data: np.ndarray) -> np.ndarray:
    """Character positions where lines begin, and the end of the text. A text that ends
    with a line break has no empty line after it; an empty text has one empty line."""
    begun = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    cuts = begun[np.flatnonzero(data == 10) + 1]
    if len(cuts) and cuts[-1] == begun[-1]:
        cuts = cuts[:-1]
    return np.concatenate(([0], cuts, begun[-1:]))


def section_tokens(docs: DataFrame, ranks_path: str, pattern: str, rule: str = "largest") -> DataFrame:
    """One row per section: doc_id, section (from 0), start_char, end_char, n_tokens,
    n_crossing (of these, tokens that reach into another section).

    A null or empty text has one empty section without tokens. Repeated rows give
    repeated results; columns besides doc_id and text are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = share_vocabulary(docs.sparkSession, ranks_path, pattern)
    cut = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    names = ["section", "start_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            texts, rows, held, parts = batch.column("text"), [], 0, []
            for k in range(len(texts)):
                text = texts[k].as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ids = np.frombuffer(encoder.encode(text), "<u4")
                borders = line_borders(data)
                counts, crossing = attribute(*character_spans(data, encoder.sizes[ids]), borders, rule)
                rows.append(np.full(len(counts), k))
                parts.append(np.stack([np.arange(len(counts)), borders[:-1], borders[1:], counts, crossing]))
                held += len(counts)
                if held >= OUT_ROWS or k + 1 == len(texts):
                    columns = np.concatenate(parts, 1)
                    ids_of = batch.column("doc_id").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([ids_of, *map(pa.array, columns)], ["doc_id", *names])
                    rows, parts, held = [], [], 0

    return cut.mapInArrow(run, f"doc_id {dict(cut.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names))
