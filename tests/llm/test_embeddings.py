import numpy as np
import pytest

from standtally.llm import cap_filters
from tests.llm.test_minhash import roots

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links string"


def frame(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], schema)


def plain(vectors, cosine=0.9):
    good = {}
    for k, (i, v) in enumerate(vectors):
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.asarray(v, np.float32).astype(float)
        good[k] = x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max())
    links = [
        (a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine
    ]
    return links


def clusters(seed, dim, n_clusters, members, spread):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n_clusters):
        c = rng.normal(size=dim)
        out += [(c + spread * rng.normal(size=dim)).tolist() for _ in range(members)]
    return out + rng.normal(size=(60, dim)).tolist()


@pytest.mark.parametrize(("dim", "spread", "block"), [(64, 0.1, 1000), (64, 0.3, 8), (7, 0.2, 5), (1, 0.1, 1000)])
def test_against_all_pairs(spark, monkeypatch, dim, spread, block):
    monkeypatch.setattr(cap_filters, "BLOCK", block)
    vectors = list(enumerate(clusters(dim, dim, 6, 25, spread)))
    links = plain(vectors)
    rows = {r.vec_id: r for r in cap_filters.near_vectors(frame(spark, vectors)).collect()}
    assert len(rows) == len(vectors)
    want = np.zeros(len(vectors), int)
    for a, b in links:
        want[a] += 1
        want[b] += 1
    got = np.array([rows[i].n_links for i, _ in vectors])
    assert (got <= want).all(), "links below the threshold"
    assert got.sum() >= 0.97 * want.sum()
    if got.sum() == want.sum():
        component = roots(range(len(vectors)), links)
        assert {i: r.component_id for i, r in rows.items()} == component
    assert all(r.kept == (r.component_id == r.vec_id) for r in rows.values())


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, v), (2, v), (3, [-x for x in v]), (4, [0.0] * 4), (5, None), (6, [1.0, None, 3.0, 4.0]),
            (7, [1.0, float("nan"), 0.0, 0.0]), (8, [float("inf"), 0.0, 0.0, 0.0]), (9, []), (10, v[:3]),
            (None, v), (11, [x * 2 for x in v]), (12, [x * 1e30 for x in v]), (13, [0.0, -0.0, 0.0, 1.0])]
    got = cap_filters.near_vectors(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got}
    assert by_id[1] == (4, 1, True) and by_id[2] == (4, 1, False)
    assert by_id[11] == (4, 1, False) and by_id[12] == (4, 1, False)
    for k in (3, 4, 5, 6, 7, 8, 9, 10, 13):
        assert by_id[k] == (0, k, True)
    assert by_id[None] == (0, None, True)
    double = SCHEMA.replace("float", "double")
    assert {r.vec_id: r.n_links for r in cap_filters.near_vectors(frame(spark, rows, double)).collect()}[12] == 4
    assert cap_filters.near_vectors(frame(spark, [])).collect() == []
