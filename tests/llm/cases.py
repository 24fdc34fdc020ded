"""Documents that every operator must bear, and plain versions of shared rules."""

import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, _size string, score double"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents():
    """Nulls in any column, empty and very long texts, repeated rows, ties, other scripts."""
    rng = random.Random(5)
    base = words(rng, 120)
    near = base.replace("w1", "v1", 2)
    passage = words(rng, 70)
    texts = [
        base, base, near, None, "", "   \t\n", "one", "two words", words(rng, 60) + " " + passage,
        passage + " " + words(rng, 40), words(rng, 20000), "日本語の文章です。" * 30, "naïve café — “quotes” 🙂 " * 12,
        "a" * 400, "\x00 nul \x1f byte", base.upper(), words(rng, 3), passage,
    ]
    rows = [
        (i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 4}", None if t is None else len(t), 1, "x", 0.5)
        for i, t in enumerate(texts)
    ]
    rows.append((None, base, None, None, None, None, None, None))
    rows.append((None, None, None, None, None, None, None, None))
    return rows + rows[6:9]  # repeated rows


def documents(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)


def simple(spark, texts):
    """Documents numbered from 0 with nothing else of interest."""
    return documents(spark, [(i, t, "en", "s", len(t or ""), 1, "x", 0.0) for i, t in enumerate(texts)])


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
