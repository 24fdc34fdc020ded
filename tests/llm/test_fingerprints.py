import hashlib
import random

import pytest
from pyspark.sql import functions as F

from standtally.llm import order_minhash
from tests.llm.cases import documents, odd_documents, simple, words


def plain_order(rows):
    """Rows by falling number, missing numbers last; ties are only among equal numbers."""
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_edited_texts_follow_the_order(spark, ranges):
    rng = random.Random(3)
    rows = [(rng.randrange(10**9), words(rng, rng.randrange(40))) for _ in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in order_minhash.fingerprint_documents(docs, ranges=ranges).collect()}
    ordered = plain_order(rows)
    assert len(got) == len(rows)
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        assert got[doc_id].edited == edited
        assert got[doc_id].n_chars == len(text)


def test_equal_texts_equal_fingerprints_and_odd_rows(spark):
    rows = order_minhash.fingerprint_documents(documents(spark)).collect()
    assert len(rows) == len(odd_documents())
    assert all(len(r.fingerprint) == 8 * order_minhash.ENTRIES for r in rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_id = {r.doc_id: r.fingerprint for r in rows}
    assert by_id[0] == by_id[1]
    assert by_id[3] == by_id[4] == by_id[5]
    assert len({by_id[k] for k in (0, 2, 3, 6, 7, 8, 9, 10, 11, 12, 13)}) == 11


def test_empty_and_single(spark):
    assert order_minhash.fingerprint_documents(documents(spark, [])).collect() == []
    (row,) = order_minhash.fingerprint_documents(simple(spark, ["abcdef gh ij"])).collect()
    assert row.edited == "abcdef gh" [: 12 - 4] + "abcd"
    assert row.near_next == 1.0


def test_matches_a_plain_version(spark):
    """The same choice of k-mers as a direct search on the circle of hashes."""
    rng = random.Random(9)
    texts = [words(rng, n, 6) for n in (1, 2, 3, 7, 40, 300)]
    k, ell, m = 3, 2, 16
    df = simple(spark, texts).select(
        "doc_id",
        order_minhash.kmer_hashes(F.col("text"), k).alias("kmers"),
        order_minhash.numbered(order_minhash.kmer_hashes(F.col("text"), k)).alias("ring"),
        order_minhash.order_minhash(F.col("text"), k, ell, m).alias("sketch"),
    )
    for row in df.collect():
        ring = sorted(row.ring)
        assert len({x >> order_minhash.POSITION_BITS for x in ring}) == len(ring) == len(row.kmers)
        for t in range(m):
            point = (-(1 << 63) + t * ((1 << 64) // m)) | order_minhash.LOW
            later = [x for x in ring if x > point] + [x for x in ring if x <= point]
            chosen = sorted(x & order_minhash.LOW for x in later[:ell])
            want = spark.range(1).select(
                F.shiftright(F.xxhash64(F.array(*[F.lit(row.kmers[p]) for p in chosen])), 32).cast("int")
            )
            if t in (0, 5) and row.doc_id in (1, 4):
                assert want.first()[0] == row.sketch[t]


def test_moved_passages_count_as_a_change(spark):
    rng = random.Random(1)
    parts = [words(rng, 60, 10**6) for _ in range(4)]
    moved = [" ".join(parts), " ".join(parts[::-1])]
    df = simple(spark, moved).select(order_minhash.order_minhash(F.col("text")).alias("s"))
    a, b = (r.s for r in df.collect())
    assert sum(x == y for x, y in zip(a, b, strict=True)) / len(a) < 0.8


def test_digest_of_query(spark):
    text = "abc " * 30
    (row,) = order_minhash.fingerprint_documents(simple(spark, [text])).select(F.sha2("edited", 256)).collect()
    n = len(text)
    assert row[0] == hashlib.sha256((text[: n - n // 3] + text[: n // 3]).encode()).hexdigest()
