import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from standtally.llm import language_model as lm
from tests.llm.cases import blank_words, documents, lower_ascii, odd_documents, simple


def plain(rows):
    """Base scores by the formula."""
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    tokens = [(r[0], [*blank_words(lower_ascii(r[1] or "")), None]) for r in rows]
    c = Counter(t for d, ts in tokens if not out(d) for t in ts)
    n, v = sum(c.values()), len(c)
    return sorted(
        (repr(d), out(d), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6))
        for d, ts in tokens
    )


@pytest.mark.parametrize("known", [lm.KNOWN, 5])
def test_base_scores_and_odd_rows(spark, known):
    rows = odd_documents()
    got = lm.score_documents(documents(spark, rows), known=known).collect()
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == plain(rows)


def test_empty_tables(spark):
    assert lm.score_documents(documents(spark, [])).collect() == []
    only = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    (row,) = lm.score_documents(documents(spark, [(only, "a b", "en", "s", 3, 1, "x", 0.0)])).collect()
    assert (row.train_tokens, row.n_known, row.n_tokens, row.base_score) == (0, 0, 3, 0.0)


def test_probabilities_sum_to_one_and_contexts_are_learnt(spark):
    rng = random.Random(6)
    follows = {"a": "b", "b": "c", "c": "a"}
    texts = []
    for _ in range(300):
        w = [rng.choice("abc")]
        for _ in range(500):
            w.append(follows[w[-1]] if rng.random() < 0.9 else rng.choice(["d", "e", "f"]) if rng.random() < 0.5 else w[-1])
            if w[-1] not in follows:
                w.append(rng.choice("abc"))
        texts.append(" ".join(w))
    texts += ["a b c a b c a b c", "c b a c b a c b a"]
    got = {r.doc_id: r for r in lm.score_documents(simple(spark, texts), rounds=4).collect()}
    assert got[300].score > got[301].score + 2
    held = [r for r in got.values() if r.held_out and r.doc_id < 300]
    assert len(held) > 20 and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    model = lm.Model.first(np.array([0.1, 0.2, 0.3, 0.4]))
    model.target[:] = np.random.default_rng(2).normal(0, 1, model.target.shape)
    scorer, every = lm.Scorer(model), np.arange(4)
    for c1, c2 in [(0, 3), (4, 4), (2, 1)]:
        logs = scorer.log10(np.full(4, c1), np.full(4, c2), every)
        assert abs(sum(10**x for x in logs) - 1) < 1e-5


def test_held_out_documents_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in lm.score_documents(docs).collect() if r.held_out]
    model, base = sum(r.score for r in held), sum(r.base_score for r in held)
    tokens = sum(r.n_tokens for r in held)
    print("log10 a token: base", base / tokens, "model", model / tokens)
    assert model > base


def test_steps_follow_the_slope():
    """The step's slopes are those of the likelihood, by differences."""
    share = np.array([0.2, 0.3, 0.5])
    rng = np.random.default_rng(0)
    model = lm.Model.first(share, 4)
    model.target[:] = rng.normal(0, 0.5, model.target.shape)
    c1, c2, t = (rng.integers(0, 3, 20) for _ in range(3))
    trainer = lm.Trainer(model, share, 7)
    before = model.flat.astype(np.float64)
    noise = np.minimum(np.searchsorted(np.cumsum(share), np.random.default_rng(7).random(lm.NOISE)), 2)

    def likelihood(flat):
        m = lm.Model(3, 4)
        m.flat = flat
        parts = np.split(flat, np.cumsum([16, 8, 12]))
        context, place, target, bias = parts[0].reshape(4, 4), parts[1].reshape(2, 4), parts[2].reshape(3, 4), parts[3]
        p = place[0] * context[c1] + place[1] * context[c2]
        offset = np.log(lm.NOISE * share)
        true = (p * target[t]).sum(1) + bias[t] - offset[t]
        false = p @ target[noise].T + bias[noise] - offset[noise]
        return -np.logaddexp(0, -true).sum() - np.logaddexp(0, false).sum()

    trainer.step(c1, c2, t)
    slope = trainer.slope.flat
    for i in range(0, len(before), 3):
        up, down = before.copy(), before.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert abs((likelihood(up) - likelihood(down)) / 2e-5 - slope[i]) < 1e-2


@pytest.mark.parametrize("spread", [0.5, 60.0])
def test_sums_of_weights_are_those_of_all_classes(spread):
    """Also for vectors so long that no class is likely by both tokens."""
    rng = np.random.default_rng(3)
    model = lm.Model(40, 4)
    model.flat[:] = rng.normal(0, spread, len(model.flat))
    c1, c2 = (x.ravel() for x in np.meshgrid(np.arange(41), np.arange(41)))
    weights = model.predicted(c1, c2).astype(np.float64) @ model.target.T + model.bias
    want = np.logaddexp.reduce(weights, axis=1)
    got = lm.Scorer(model).sums[c1, c2]
    assert np.allclose(got, want, rtol=1e-5, atol=1e-4)


def test_scores_do_not_depend_on_neighbours(spark):
    """The end mark of a text follows the text's own last words, whatever text comes next."""
    texts = ["a b c a b c a b"] * 40 + ["c b a", ""] * 3 + ["a b c a b c a b"]
    found = lm.score_documents(simple(spark, texts).coalesce(1), rounds=4).collect()
    assert len({round(r.score, 9) for r in found if r.n_tokens == 9}) == 1


def test_pieces_hold_the_words_of_texts(monkeypatch):
    """Blank, long and odd texts, with slices and groups of few bytes."""
    monkeypatch.setattr(lm, "SLICE", 50)
    texts = [(r[1] or "").encode() for r in odd_documents()] + [b" \x1c A\x85 \xff \x0b", b" ", b"x" * 200, b"y " * 100]
    for most in (1, 60, 4000):
        found, open_text = [[] for _ in texts], False
        for first, words, counts, begins, ends in lm._pieces(pa.array(texts, pa.binary()), most):
            assert begins != open_text and len(words) == sum(counts)
            open_text, at = not ends, 0
            for i, n in enumerate(counts):
                found[first + i] += words[at : at + n].to_pylist()
                at += n
        assert found == [t.lower().split() for t in texts] and not open_text
