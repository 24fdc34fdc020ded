import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from standtally.llm import components, minhash
from tests.llm.cases import blank_words, documents, lower_ascii, odd_documents, simple, words


def shingles(text, size):
    w = blank_words(lower_ascii(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(texts, size, percent=80):
    """Component of each text, from all pairs."""
    sets = [shingles(t, size) for t in texts]
    links = [
        (i, j)
        for i, a in enumerate(sets)
        for j in range(i)
        if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j])
    ]
    return sets, roots(range(len(texts)), links)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**9)}"
    return " ".join(w)


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, size):
    """Groups of copies around an original and along a chain, near and past the threshold."""
    rng = random.Random(seed)
    passage = words(rng, 30, 10**6)
    texts = []
    for _ in range(6):
        base = words(rng, 150, 10**6)
        texts += [base, base] + [edited(rng, base, rng.randrange(1, 9)) for _ in range(25)]
        for _ in range(6):
            base = edited(rng, base, 3)
            texts.append(base)
    texts += [words(rng, 60, 10**6) + " " + passage for _ in range(40)]
    texts += [words(rng, n, 3) for n in range(1, 12)] + ["", None]
    rng.shuffle(texts)
    sets, want = plain(texts, size)
    rows = minhash.near_duplicates(simple(spark, texts), size).collect()
    assert Counter(r.doc_id for r in rows) == Counter(range(len(texts)))
    for r in rows:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_odd_rows(spark):
    rows = odd_documents()
    got = minhash.near_duplicates(documents(spark), 4).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    _, want = plain([r[1] for r in rows[:18]], 4)
    assert {k: v.component_id for k, v in by_id.items()} == want
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    kept = minhash.drop_near_duplicates(documents(spark), 4)
    assert kept.columns == documents(spark).columns
    ids = {k for k, root in want.items() if k == root}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in rows if r[0] is None or r[0] in ids)
    assert minhash.near_duplicates(documents(spark, []), 4).collect() == []


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = odd_documents()[10][1]
    whole = minhash.shingle_set(text, 4)
    monkeypatch.setattr(minhash, "BLOCK", 100)
    assert (minhash.shingle_set(text, 4) == whole).all()
    assert len(whole) == len(shingles(text, 4))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_components_of_any_graph(spark, edges):
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    want = roots({n for e in edges for n in e}, edges)
    touched = {n for a, b in edges if a != b for n in (a, b)}
    assert sorted((r.node, r.root) for r in got) == sorted((n, want[n]) for n in touched)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)]
    got = components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r.node, r.root) for r in got) == [(i, 0) for i in range(301)]


def test_rarest_shingles_hold_one_of_every_similar_pair(spark):
    """Sets over few shingles, so that most are frequent: no similar pair goes unseen."""
    rng = random.Random(11)
    sets = [frozenset(rng.sample(range(26), rng.randrange(8, 24))) for _ in range(40)]
    sets += [x - {min(x)} for x in sets[:20]] + [x | {30} for x in sets[10:30]]
    rows = [(i, sorted(x)) for i, x in enumerate(sets)]
    got = minhash.rarest_shingles(spark.createDataFrame(rows, "doc_id bigint, `set` array<bigint>"), 80)
    held = {}
    for r in got.collect():
        held.setdefault(r.shingle, []).append((r.doc_id, r.n, r.place))
    seen = set()
    for owners in held.values():
        for i, n, a in owners:
            for j, m, b in owners:
                least = -(-80 * (n + m) // 180)
                if i < j and a <= n - least + 1 and b <= m - least + 1:
                    seen.add((i, j))
    similar = {
        (i, j)
        for j, y in enumerate(sets)
        for i, x in enumerate(sets[:j])
        if 100 * len(x & y) >= 80 * len(x | y)
    }
    assert similar and similar <= seen


def test_hot_group_past_the_threshold(spark):
    """Many copies too far from their original share buckets; the few links among them stay."""
    rng = random.Random(12)
    base = words(rng, 200, 10**6)
    texts = [base] + [edited(rng, base, 13) for _ in range(150)]
    texts += [edited(rng, t, 1) for t in texts[1:150:10]]
    sets, want = plain(texts, 4)
    assert len(set(want.values())) > 100
    rows = minhash.near_duplicates(simple(spark, texts), 4).collect()
    assert {r.doc_id: r.component_id for r in rows} == want
