"""MinHash near-duplicates: banding, verification on full sets, connected components.

A document is the set of its word shingles. Documents with equal sets are one class, and
only a class's first document goes on. Minima of many universal hash functions are cut into
bands; documents that agree in a band are candidates. Of each bucket of candidates, all are
first held against the member that shares most buckets: copies of one original need no more,
however many they are. Members that this leaves in another component are then held against
the rest, unless a link is ruled out: by the sizes, by the signatures, by the shingles that a
member shares with no other one, or as the two share none of their rarest shingles, of which
similar sets must have one in common. None of these bounds loses a link between members that
the buckets bring together. Links are confirmed on full sets.

With 40 bands of 5 minima a pair of similarity 0.8 goes unseen with probability 1e-7. The
signature keeps one bit of each of the 200 minima; a pair of similarity 0.8 differs in 20
bits on average, and one of more than 48 different bits is ruled out, over six standard
deviations away.

Texts without words, missing texts and rows without doc_id are linked with nothing. Rows
that share a doc_id are one document, kept or removed together. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standtally.llm.common import frugal
from standtally.llm.components import components
from standtally.sources.staging import broadcast_if_small, stage

BANDS = 40
ROWS = 5
MAX_BITS = 48
# Bytes of a text that are hashed at once.
BLOCK = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_GROWN = {"n": 0}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _GROWN["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        _GROWN.update(n=size, up=_powers(_BASE, size), down=_powers(_INVERSE, size))
    return _GROWN["up"], _GROWN["down"]


def _forget_tables() -> None:
    _GROWN.clear()
    _GROWN["n"] = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, from running sums over the bytes of the text."""
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER)
    blocks, at = [], 0
    while at < len(lowered):
        cut = lowered.find(b" ", at + BLOCK)
        end = len(lowered) if cut < 0 else cut
        blocks.append(_hash_block(np.frombuffer(lowered, np.uint8, end - at, at)))
        at = end
    return np.concatenate(blocks) if blocks else np.zeros(0, np.uint64)


def _hash_block(data: np.ndarray) -> np.ndarray:
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    # A position's weight is the inverse power; multiplying by the power at a word's start
    # makes equal words equal wherever they stand.
    np.cumsum(_BYTE[data] * down[: len(data)], out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * up[starts])


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run."""
    words = word_hashes(text)
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    h = np.full(n, np.uint64(min(len(words), size)))
    for k in range(min(size, len(words))):
        h = _mix(h * np.uint64(_BASE) + words[k : k + n])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of all hash functions, one row per non-empty set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), len(_A)), np.uint64)
    for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
        out[:, k] = np.minimum.reduceat(joined * a + b, starts)
    return out >> np.uint64(32)


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, band hashes and signature bits, staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                few = batch.slice(at, 200)
                sets = [shingle_set(t or "", size) for t in few.column(1).to_pylist()]
                full = [k for k, s in enumerate(sets) if len(s)]
                digests: list[bytes | None] = [None] * len(sets)
                bands: list[np.ndarray | None] = [None] * len(sets)
                bits: list[np.ndarray | None] = [None] * len(sets)
                if full:
                    minima = signatures([sets[k] for k in full])
                    keys = np.full((len(full), BANDS), np.uint64(7))
                    cut = minima.reshape(len(full), BANDS, ROWS)
                    for r in range(ROWS):
                        keys = _mix(keys * np.uint64(_BASE) + cut[:, :, r])
                    keys = _mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)
                    low = np.packbits((minima & np.uint64(1)).astype(np.uint8), axis=1)
                    low = np.pad(low, ((0, 0), (0, -low.shape[1] % 8))).view(np.int64)
                    for row, k in enumerate(full):
                        digests[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
                        bands[k], bits[k] = keys[row], low[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                        pa.array(bits, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "digest", "bands", "bits"],
                )

    read = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    return stage(
        read.mapInArrow(
            frugal(run, _forget_tables), "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, bits array<bigint>"
        ),
        "sketches",
    )


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, set) of the wanted documents, staged; the set as an array of its hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                few = batch.slice(at, 100)
                sets = [shingle_set(t or "", size).view(np.int64) for t in few.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([few.column(0), listed], names=["doc_id", "set"])

    read = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").join(
        broadcast_if_small(wanted), "doc_id", "left_semi"
    )
    return stage(read.mapInArrow(frugal(run, _forget_tables), "doc_id bigint, set array<bigint>").dropDuplicates(["doc_id"]), "full-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough; a task holds one pair of sets at a time."""
    with_u = pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("set").alias("set_u")), "u")
    with_v = with_u.join(sets.select(F.col("doc_id").alias("v"), F.col("set").alias("set_v")), "v")
    both = F.size("set_u").cast("bigint") + F.size("set_v")
    shared = F.size(F.array_intersect("set_u", "set_v")).cast("bigint")
    return with_v.filter((100 + percent) * shared >= percent * both).select("u", "v")


def shared_shingles(sets: DataFrame) -> DataFrame:
    """(doc_id, n_shared): how many shingles of each set occur in any other of the sets."""
    single = (
        sets.select("doc_id", F.explode("set").alias("shingle"))
        .groupBy("shingle")
        .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("owners"))
        .filter("owners = 1")
        .groupBy("doc_id")
        .agg(F.count("*").alias("alone"))
    )
    return sets.join(single, "doc_id", "left").select(
        "doc_id", (F.size("set") - F.coalesce("alone", F.lit(0))).alias("n_shared")
    )


def rarest_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, shingle, place): of each set the rarest shingles that any other set holds.

    Places count all shingles by rising number of owners. Two similar sets of n and m
    shingles share at least ``_least_shared`` of them, so one of those they share stands
    among the first n - least + 1 places of the one and the first m - least + 1 of the other.
    """
    tokens = sets.select("doc_id", F.size("set").cast("bigint").alias("n"), F.explode("set").alias("shingle"))
    owners = tokens.groupBy("shingle").agg(F.count("*").alias("owners"))
    by_rarity = Window.partitionBy("doc_id").orderBy("owners", "shingle")
    return (
        tokens.join(owners, "shingle")
        .withColumn("place", F.row_number().over(by_rarity))
        # The smallest similar set has percent of n shingles, all of them shared.
        .filter((F.col("owners") > 1) & (100 * (F.col("n") - F.col("place") + 1) >= percent * F.col("n")))
        .select("doc_id", "n", "shingle", "place")
    )


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """How many shingles similar sets of n and m share at least."""
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``."""
    sketches = sketch(docs, size)
    classes = (
        sketches.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"))
    )
    members = stage(
        sketches.filter(F.col("doc_id").isNotNull()).join(classes, "digest", "left").drop("digest"), "members"
    )
    reps = members.filter(F.col("rep") == F.col("doc_id")).select("rep", "n_shingles", "bands", "bits")

    banded = reps.select("rep", F.explode("bands").alias("bucket")).distinct()
    shared = banded.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    buckets = stage(banded.join(shared, "bucket"), "buckets")
    degrees = buckets.groupBy("rep").agg(F.sum("members").alias("degree"))
    leaders = stage(
        buckets.join(degrees, "rep")
        .groupBy("bucket")
        .agg(F.max(F.struct("degree", -F.col("rep"))).alias("_best"))
        .select("bucket", (-F.col("_best")["col2"]).alias("leader")),
        "leaders",
    )
    sizes = reps.select("rep", "n_shingles", "bits").dropDuplicates(["rep"])
    first = buckets.join(leaders, "bucket").filter("rep <> leader").select(
        F.least("rep", "leader").alias("u"), F.greatest("rep", "leader").alias("v")
    ).distinct()
    sets = full_sets(docs, buckets.select(F.col("rep").alias("doc_id")).distinct(), size)
    close = _possible(first, sizes, percent)
    links = stage(confirmed(close, sets, percent), "links")
    found = components(links)

    # Whoever is not with the leader of a bucket yet meets those of its other components.
    rooted = stage(
        buckets.join(found, F.col("rep") == F.col("node"), "left")
        .select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
        .join(sizes.select("rep", "n_shingles"), "rep"),
        "rooted",
    )
    undecided = (
        rooted.groupBy("bucket")
        .agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.min("n_shingles").alias("least_n"))
        .filter("_low < _high")
        .select("bucket", "least_n")
    )
    open_rows = stage(rooted.join(undecided, "bucket"), "undecided")
    bounds = shared_shingles(
        sets.join(open_rows.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    )
    # A set that shares at most o shingles is no more than o / (n + m - o) like one of m.
    shared_most, n = F.col("n_shared"), F.col("n_shingles")
    placed = stage(
        open_rows.join(bounds.withColumnRenamed("doc_id", "rep"), "rep")
        .filter(100 * shared_most >= percent * (n + F.greatest("least_n", shared_most) - shared_most))
        .join(sizes.select("rep", "bits"), "rep")
        .select("bucket", "rep", "root", "bits"),
        "placed",
    )
    heads = open_rows.select("bucket", F.col("rep").alias("leader"), F.col("root").alias("leader_root"))
    apart = stage(
        placed.join(leaders.join(heads, ["bucket", "leader"]), "bucket")
        .filter("root <> leader_root")
        .select("bucket", "rep", "root"),
        "apart",
    )
    near_apart = placed.join(apart.select("bucket").distinct(), "bucket", "left_semi")
    rare = rarest_shingles(
        sets.join(near_apart.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"), percent
    )
    rare = stage(
        rare.withColumnRenamed("doc_id", "rep").join(placed.select("rep", "root", "bits").dropDuplicates(["rep"]), "rep"),
        "rare",
    )
    alone = rare.join(apart.select("rep").distinct(), "rep", "left_semi").select(
        "shingle", *[F.col(c).alias(f"{c}_u") for c in ("rep", "root", "n", "place", "bits")]
    )
    least = _least_shared(F.col("n_u"), F.col("n"), percent)
    differing = sum(
        (F.bit_count(F.col("bits_u")[k].bitwiseXOR(F.col("bits")[k])) for k in range(-(-BANDS * ROWS // 64))),
        F.lit(0),
    )
    second = (
        alone.join(
            rare.withColumnRenamed("shingle", "_shingle"),
            (F.col("shingle") == F.col("_shingle"))
            & (F.col("root_u") != F.col("root"))
            & (F.col("place_u") <= F.col("n_u") - least + 1)
            & (F.col("place") <= F.col("n") - least + 1)
            & (differing <= MAX_BITS),
        )
        .select(F.least("rep", "rep_u").alias("u"), F.greatest("rep", "rep_u").alias("v"))
        .distinct()
    )
    more = stage(confirmed(second, sets, percent), "links")
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))

    component = F.coalesce("root", "rep", "doc_id")
    numbered = members.join(roots, F.col("rep") == F.col("node"), "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (component == F.col("doc_id")).alias("kept"),
    )
    return numbered.union(
        sketches.filter(F.col("doc_id").isNull()).select(
            "doc_id", "n_shingles", F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept")
        )
    )


def _possible(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose set sizes allow the similarity."""
    u = sizes.select(F.col("rep").alias("u"), F.col("n_shingles").alias("_nu"))
    v = sizes.select(F.col("rep").alias("v"), F.col("n_shingles").alias("_nv"))
    return (
        pairs.join(u, "u")
        .join(v, "v")
        .filter(100 * F.least("_nu", "_nv") >= percent * F.greatest("_nu", "_nv"))
        .select("u", "v")
    )


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that a smaller number of their group stands for."""
    removed = near_duplicates(docs, size, percent).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(broadcast_if_small(stage(removed, "removed")), "doc_id", "left_anti").select(
        *[f"`{c}`" for c in docs.columns]
    )
