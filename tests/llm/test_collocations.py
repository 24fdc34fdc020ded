import random
import re
from collections import Counter

import numpy as np
import pytest

from standtally.llm import collocations
from tests.llm.cases import documents, lower_ascii, odd_documents, simple, words


def plain(rows, min_count, longest=4, percent=80, top=2000):
    counts, totals, first = Counter(), Counter(), {}
    for doc_id, text, lang, *_ in rows:
        lang, at = lang or "und", 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower_ascii(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for n in range(1, longest + 1):
                for i in range(len(w) - n + 1):
                    key = (lang, tuple(w[i : i + n]))
                    counts[key] += 1
                    here = (doc_id is None, doc_id or 0, at + i)
                    first[key] = min(first.get(key, here), here)
            at += len(w)
    frequent = {k: f for k, f in counts.items() if f >= min_count}
    found = {}
    for (lang, p), a in frequent.items():
        if len(p) < 2:
            continue
        cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = any(
            g == lang and len(q) > len(p) and 100 * f >= percent * a
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            for (g, q), f in frequent.items()
        )
        if not inside:
            _, doc, word = first[lang, p]
            missing = first[lang, p][0]
            row = (" ".join(p), a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score, None if missing else doc, word)
            found.setdefault(lang, []).append(row)
    out = set()
    for lang, rows_ in found.items():
        rows_.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, i + 1, *r) for i, r in enumerate(rows_[:top])}
    return out


def got(df, **options):
    found = [tuple(r) for r in collocations.collocations(df, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("size", [collocations.SLICE, 64])
def test_odd_documents(spark, size):
    rows = odd_documents()
    assert got(documents(spark), min_count=3, size=size) == plain(rows, 3)


def test_pieces_languages_and_top(spark):
    rng = random.Random(4)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x0c", "\r\n", "; ", "\xa0"]
    rows = []
    for i in range(150):
        text = "".join(rng.choice(["New", "york", "CITY", "São", "Paulo", "ÀB", "x"]) + rng.choice(marks) for _ in range(80))
        rows.append((i if i % 9 else None, text, rng.choice(["en", "pt", None]), "s", 0, 1, "x", 0.0))
    want = plain(rows, 5, top=40)
    assert len(want) == 120
    assert got(documents(spark, rows), min_count=5, top=40, max_bits=1 << 12) == want


def test_empty_and_rare(spark):
    assert got(documents(spark, [])) == set()
    assert got(simple(spark, [None, "", "a b c", words(random.Random(1), 50)])) == set()


def test_words_are_compared_by_text():
    made = collocations.Words([(b"one two one two  three", 22, 0), (b"two\none", 7, 1)], ["en", "en"])
    made.word[:] = np.uint64(7)  # all fingerprints collide
    ids = made.word_ids()
    texts = [made.text(i, 1) for i in range(len(ids))]
    assert len(set(zip(texts, ids.tolist(), strict=True))) == len(set(texts)) == len(set(ids.tolist()))


def test_equal_fingerprints_with_other_texts_are_counted_apart():
    held = collocations.Counted()
    row = lambda n, doc, start, length: {
        c: np.array([v]) for c, v in zip(held.NUMBERS, (n, 0, 1, doc, 0, start, length), strict=True)
    }
    source = np.frombuffer(b"ab cd ab", np.uint8)
    for n, doc, start in ((3, 9, 0), (2, 5, 3), (4, 7, 6)):
        held.add(np.array([11], np.uint64), row(n, doc, start, 2), source)
    rows = [r for b in held.batches(["en"]) for r in b.to_pylist()]
    assert sorted((r["phrase"], r["n"], r["doc_id"]) for r in rows) == [("ab", 7, 7), ("cd", 2, 5)]
