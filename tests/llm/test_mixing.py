from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from standtally.llm import mixing
from tests.llm.cases import blank_words, documents, odd_documents


def plain_targets(sizes, epochs=3):
    """Water-filling on fractions: clamp, share the excess by weight, repeat."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total = Fraction(sum(sizes.values()))
    open_, target = set(order), {}
    while open_:
        free = total - sum(target.values())
        share = sum(weight[s] for s in open_)
        over = {s for s in open_ if free * weight[s] / share > epochs * sizes[s]}
        if not over:
            return target | {s: free * weight[s] / share for s in open_}
        for s in over:
            target[s] = Fraction(epochs * sizes[s])
        open_ -= over
    return target


def check(spark, rows):
    mixed = mixing.mix(documents(spark, rows))
    got = mixed.collect()
    sizes = Counter()
    for _, text, _, source, *_ in rows:
        sizes[source] += len(blank_words(text))
    targets = plain_targets(sizes)
    taken = Counter()
    for r in got:
        m = r.mix
        assert m.size == len(blank_words(r.text)) and m.source_size == sizes[r.source]
        assert m.target == pytest.approx(float(targets[r.source]))
        words = m.whole * m.size + m.extra
        assert 0 <= words <= 3 * m.size
        taken[r.source] += words
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(documents(spark, rows).repartition(7)).collect()))
    return mixed, got


def test_odd_rows(spark):
    rows = odd_documents()
    mixed, got = check(spark, rows)
    assert len(got) == len(rows) and mixed.columns == [*documents(spark).columns, "mix"]


def test_caps_and_hot_source(spark):
    rows = [(i, "a b c d " * (1 + i % 7), None, "hot" if i % 3 else f"s{i % 5}", 1, 1, "", 0.0) for i in range(6000)]
    check(spark, rows)
    check(spark, [(1, "a b", None, "x", 1, 1, "", 0.0), (2, "c " * 500, None, "y", 1, 1, "", 0.0)])


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
    rows = [(1, None, None, None, 1, 1, "", 0.0), (2, " ", None, "a", 1, 1, "", 0.0)]
    assert [(r.mix.target, r.mix.whole, r.mix.extra) for r in mixing.mix(documents(spark, rows)).collect()] == [(0.0, 0, 0)] * 2


def test_repetitions_hold_the_words_taken(spark):
    mixed = mixing.mix(documents(spark))
    want = defaultdict(int)
    for r in mixed.collect():
        want[r.source] += r.mix.whole * r.mix.size + r.mix.extra
    out = mixing.repeat_documents(mixed)
    assert out.columns == documents(spark).columns
    got = defaultdict(int)
    texts = [t for _, t, *_ in odd_documents() if t]
    for r in out.collect():
        got[r.source] += len(blank_words(r.text))
        assert not r.text or any(t.startswith(r.text) for t in texts)
    assert {k: v for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
