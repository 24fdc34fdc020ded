import re

from standtally.llm import licenses
from tests.llm.cases import documents, lower_ascii, odd_documents, simple

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain(text):
    found = re.findall(WORD, lower_ascii(text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(found) - len(p) + 1):
            if found[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    "Released under the MIT License.",
    "under the mit license under the mit license",
    "CC-BY-NC cc by nc, Apache License, Version 2.0; apache\nlicense -- version 2",
    "under the mit licenses", "xunder the mit license", "cc by nc" * 3, "cc by nc " * 3,
    "// SPDX-License-Identifier: MIT OR Apache-2.0 WITH LLVM-exception\ncode",
    "SPDX-License-Identifier: (GPL-3.0-only AND mit", "İ under the MIT license \x85 cc\x00by\x7fnc",
]


def test_base_scan_against_plain_version(spark):
    texts = CASES + [t for _, t, *_ in odd_documents()]
    rows = licenses.scan_licenses(simple(spark, texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert got == plain(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score < 1 and (r.score > 0) == bool(r.labels)


def test_odd_rows(spark):
    assert licenses.scan_licenses(documents(spark)).count() == len(odd_documents())
    assert licenses.scan_licenses(documents(spark, [])).collect() == []


def value(expression):
    postfix = licenses.to_postfix(licenses._TOKENS.findall(expression))
    return None if postfix is None else licenses.evaluate(postfix)


def test_expressions():
    assert value("mit or gpl-3.0-only and isc") == ({"mit", "gpl-3", "isc"}, True)
    assert value("(mit or gpl-3.0-only) and gpl-2.0") == ({"mit", "gpl-3", "gpl-2"}, False)
    assert value("gpl-2.0+ with classpath-exception-2.0 or mit") == ({"gpl-2", "mit"}, True)
    assert value("apache-2.0 with llvm-exception") == ({"apache-2"}, True)
    for broken in ("mit or", "or mit", "(mit", "mit)", "mit isc", "()", ""):
        assert value(broken) is None


def test_tagged_expressions_add_labels(spark):
    rows = {r.doc_id: r for r in licenses.scan_licenses(simple(spark, CASES)).collect()}
    assert rows[7].labels == "apache-2,mit" and rows[7].permissive
    assert rows[8].labels == "gpl-3,mit" and not rows[8].permissive
    assert rows[7].score > rows[8].score
