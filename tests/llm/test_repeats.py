import random

import numpy as np
import pytest

from standtally.llm import suffix_dedup
from tests.llm.cases import documents, odd_documents, words


def plain(rows, length):
    """Spans and kept bytes of every row, from a dictionary of all strings."""
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        if doc_id is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if doc_id is not None and first[b[i : i + length]] < doc_id:
                gone[i : i + length] = [True] * length
        edges = [i for i in range(len(b) + 1) if (i < len(b) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((doc_id, len(b), edges[::2], edges[1::2], bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def run(docs, length):
    return sorted(
        ((r.doc_id, r.n_bytes, r.starts, r.ends, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length).collect()),
        key=repr,
    )


def shared_passages(seed):
    rng = random.Random(seed)
    passages = [words(rng, 40, 10**5) for _ in range(8)]
    texts = []
    for _ in range(120):
        parts = [words(rng, rng.randrange(25), 10**5)]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) - 80)
            parts += [p[a : a + rng.randrange(30, 200)], words(rng, rng.randrange(6), 10**5)]
        texts.append(" ".join(parts))
    texts += ["ab" * 90, "ba" * 70, "a" * 300, "a" * 49, "é" * 40, "é" * 25, texts[3], texts[3] + "x"]
    return [(rng.randrange(1000), t) for t in texts]


@pytest.mark.parametrize(("seed", "length", "chunk", "block"), [(1, 50, 4 << 20, 1 << 20), (2, 50, 2000, 100), (3, 30, 5000, 777), (4, 100, 900, 4000)])
def test_against_all_strings(spark, monkeypatch, seed, length, chunk, block):
    rows = shared_passages(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    assert run(docs, length) == plain(rows, length)


def test_odd_rows(spark):
    rows = [r[:2] for r in odd_documents()]
    assert run(documents(spark), 50) == plain(rows, 50)
    assert run(documents(spark, []), 50) == []


@pytest.mark.parametrize("seed", range(5))
def test_intervals_equal_shared_prefixes(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, 12)
    text = rng.integers(0, 2 + seed, int(sizes.sum())).astype(np.uint8)
    ends = np.cumsum(sizes)
    left = ends[np.repeat(np.arange(len(sizes)), sizes)] - np.arange(len(text))
    for length in (1, 5, 9, 20):
        order, interval = suffix_dedup.repeated_prefixes(text, left, length)
        number = dict(zip(order.tolist(), interval.tolist(), strict=True))
        whole = [i for i in range(len(text)) if left[i] >= length]
        for i in whole:
            for j in whole:
                assert (number[i] == number[j]) == (text[i : i + length] == text[j : j + length]).all()
