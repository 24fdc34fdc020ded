import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from standtally.llm import packing
from standtally.llm.common import BATCH_BYTES, small_batches
from tests.llm.cases import documents, odd_documents

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")


def plain_ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizers():
    ids, encode = plain_ids(), packing.encoder(PATH).encode
    rng = random.Random(2)
    marks = [" ", "  ", "\n", " \n", "\t", "'s", "a", "Bc", "é", "日", "🙂", "12", "###", "<|endoftext|>", " ", "Ω", "\x85"]
    texts = [t for _, t, *_ in odd_documents() if t] + ["".join(rng.choices(marks, k=30)) for _ in range(500)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(text), repr(text)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_pieces_and_places(spark, rows):
    docs = documents(spark, None if rows == "odd" else [])
    got = packing.pack(packing.tokenize_pieces(docs, PATH, 64), 64).collect()
    if rows == "none":
        assert got == []
        return
    ids = plain_ids()
    want = sorted(tuple(ids(t)) + (2,) for _, t, *_ in odd_documents())
    texts = defaultdict(list)
    sequences = defaultdict(list)
    owner, seen = None, []
    for r in sorted(got, key=lambda r: (r.part, r.position)):
        if r.piece == 0:
            seen.append([])
        assert r.start == len(seen[-1])
        assert r.length == 64 or r.piece == 0
        seen[-1] += np.frombuffer(r.ids, "<u4").tolist()
        sequences[r.sequence_id].append(r)
    assert sorted(map(tuple, seen)) == want
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    total = sum(map(len, want))
    assert len(sequences) <= -(-total // 64) + 3
    assert owner is None and not texts


@pytest.mark.parametrize("seed", range(6))
def test_fillings_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(1, 101): rng.randrange(1, 60) for _ in range(30)}
    left = dict(counts)
    bins = 0
    for times, filling in packing.best_two_fit(counts, 100):
        assert sum(filling) <= 100 and times > 0
        bins += times
        for length in filling:
            left[length] -= times
    assert not any(left.values())
    slots = packing.slots_of(packing.best_two_fit(counts, 100))
    for length, n in counts.items():
        ranks = sorted((a, b) for size, a, b, *_ in slots if size == length)
        assert ranks[0][0] == 0 and ranks[-1][1] == n - 1
        assert all(x[1] + 1 == y[0] for x, y in zip(ranks, ranks[1:], strict=False))
    # Never worse than one filling per oversized half plus the rest by volume.
    assert bins >= -(-sum(k * n for k, n in counts.items()) // 100)


def test_two_pieces_replace_the_smallest():
    # Greedy takes 60 and 30; 30 gives way to 25 and 15, which fill the sequence.
    assert packing.best_two_fit({60: 1, 30: 1, 25: 1, 15: 1}, 100)[0] == (1, [60, 25, 15])


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_very_long_runs_of_white_space(blank):
    ids, encode = plain_ids(), packing.encoder(PATH).encode
    for text in (blank * 2_000_000, "a" + blank * 2_000_000 + "b c"):
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(text)


def test_latin_texts_go_whole_to_the_merger(monkeypatch):
    ids, encoder = plain_ids(), packing.Encoder(PATH)
    calls = []
    merged = packing.Encoder._merged
    monkeypatch.setattr(packing.Encoder, "_merged", lambda self, text: calls.append(text) or merged(self, text))
    rng = random.Random(4)
    latin = " ".join(f"{rng.randrange(10**9):x}é" for _ in range(2000))
    assert np.frombuffer(encoder.encode(latin), "<u4").tolist() == ids(latin)
    assert calls == [latin] and not encoder.seen
    mixed = f"{latin} Ж 日本  {latin}"
    assert np.frombuffer(encoder.encode(mixed), "<u4").tolist() == ids(mixed)
    assert len(calls) == 3 and len(encoder.seen) == 2


def test_cuts_at_words_cross_no_token():
    ids, encode = plain_ids(), packing.encoder(PATH).encode
    rng = random.Random(8)
    marks = [" ", " ", "  ", "\n ", " \n", "\xa0", "\x1c", "\u180e", "\u2003", "'s", " 's", "a", "é", "ɏ", "ɐ", "Ж", "\u0301", "…", "7", "#"]
    for _ in range(3000):
        text = "".join(rng.choices(marks, k=rng.randrange(1, 25)))
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(text), repr(text)


def test_python_gets_small_batches(spark, monkeypatch):
    """A batch of 10,000 rows is held several times outside an executor's heap."""
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    usual = spark.conf.get(key)
    monkeypatch.setattr(packing, "stage", lambda df, name: seen.append(spark.conf.get(key)) or df)
    packing.tokenize_pieces(documents(spark), PATH)
    assert seen == [str(BATCH_BYTES)] and spark.conf.get(key) == usual

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    rows = spark.range(9000, numPartitions=1).selectExpr("repeat('x', 3000) text")
    with small_batches(spark):
        got = [r.n for r in rows.mapInArrow(sizes, "n bigint").collect()]
    assert len(got) > 10 and max(got) < 2 * BATCH_BYTES
