"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A vector is rotated at random and cut into two halves. Each half has a small random code; a
pair of code words is a filter direction, so a few hundred words stand for many thousand
directions. Decoding a vector lists all directions whose cap it lies in. Near vectors lie in
common caps, so vectors meet by joining on filters and are compared there in double
precision. Several rotations are used: as many as a simulation of pairs at the threshold
needs to find the asked share of them.

The codes grow with the number of vectors, so that a cap holds about as many of them at any
size. Equal vectors are one class with a count. A cap with very many vectors is cut into
blocks, and blocks meet pairwise in tasks of their own; only counts and a spanning star leave
a task, never its pairs. A pair that shares several caps is counted in the first of them.

Vectors that are missing, zero, or hold a missing or non-finite component link with nothing,
and so do rows without vec_id. Vectors of different length don't link. Repeated rows count
as vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.llm.components import components
from standtally.sources.staging import broadcast_if_small, stage

# Filters of a vector in one rotation, on average.
PER_ROTATION = 8
# Vectors of a cap that one block holds, if the cap is cut.
BLOCK = 1000
RECALL = 0.99


@lru_cache(maxsize=16)
def codes(dim: int, words: int, rotations: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Per rotation: both halves' code words in the given space, and the cap's height.

    The height is set on random directions, such that a vector has PER_ROTATION filters.
    """
    out = []
    half = max(1, dim // 2)
    for r in range(rotations):
        rng = np.random.default_rng([dim, words, r])
        turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        both = []
        for columns in (turn[:, :half], turn[:, half:]):
            word = rng.standard_normal((words, columns.shape[1]))
            word /= np.maximum(np.linalg.norm(word, axis=1, keepdims=True), 1e-300)
            both.append(columns @ word.T)
        x = rng.standard_normal((256, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        sums = ((x @ both[0])[:, :, None] + (x @ both[1])[:, None, :]).ravel()
        keep = min(PER_ROTATION * len(x), len(sums) - 1)
        out.append((both[0], both[1], float(np.partition(sums, len(sums) - 1 - keep)[-1 - keep])))
    return out


def decode(x: np.ndarray, words: int, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all caps that the unit vectors ``x`` lie in; filters are numbers.

    Only first words that the best second word can lift over the height are followed.
    """
    rows, filters = [], []
    for r, (first, second, height) in enumerate(codes(x.shape[1], words, rotations)):
        a, b = x @ first, x @ second
        row, i = np.nonzero(a >= height - b.max(axis=1, keepdims=True))
        for at in range(0, len(row), 20_000):
            few, word = row[at : at + 20_000], i[at : at + 20_000]
            k, j = np.nonzero(a[few, word][:, None] + b[few] >= height)
            rows.append(few[k])
            filters.append((r * words + word[k].astype(np.int64)) * words + j)
    return np.concatenate(rows), np.concatenate(filters)


@lru_cache(maxsize=16)
def rotations_for(dim: int, words: int, cosine: float, recall: float = RECALL) -> int:
    """Rotations with which random pairs at the threshold share a cap often enough."""
    if dim < 2 or cosine >= 1:
        return 4
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((1000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((1000, dim))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    most = 64
    row_x, filter_x = decode(x, words, most)
    row_y, filter_y = decode(y, words, most)
    span = np.int64(words) * words
    shared = np.intersect1d(row_x * (span * most) + filter_x, row_y * (span * most) + filter_y)
    first = np.full(len(x), most)
    np.minimum.at(first, shared // (span * most), shared % (span * most) // span)
    for rotations in range(1, most + 1):
        if (first < rotations).mean() >= recall:
            return rotations
    return most


def unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; the largest component goes first, against overflow."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def read_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, dim, vec), staged: the components as bytes, missing where nothing can link."""
    field = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if field == "float" else "<f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors: list[bytes | None] = []
            dims: list[int | None] = []
            for v in batch.column(1):
                values = v.values
                ok = values is not None and len(values) > 0 and values.null_count == 0
                x = values.to_numpy(zero_copy_only=False).astype(kind) + 0.0 if ok else None
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                vectors.append(x.astype(kind).tobytes() if ok else None)
                dims.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(dims, pa.int32()), pa.array(vectors, pa.binary())],
                names=["vec_id", "dim", "vec"],
            )

    read = embeddings.selectExpr("cast(vec_id as bigint) vec_id", "embedding")
    return stage(read.mapInArrow(run, "vec_id bigint, dim int, vec binary"), "vectors")


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept, one row per row of ``embeddings``."""
    field = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if field == "float" else "<f8"
    vectors = read_vectors(embeddings)
    valid = vectors.filter(F.col("vec").isNotNull() & F.col("vec_id").isNotNull())
    classes = stage(
        valid.groupBy("dim", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    n = classes.count()
    words = 32
    while words * words * 3 < n:
        words *= 2
    dims = [r["dim"] for r in classes.select("dim").distinct().limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 different lengths")
    turns = {d: rotations_for(d, words, cosine, recall) for d in dims}

    def filters_of(raw: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = unit(np.frombuffer(b"".join(raw), kind).reshape(len(raw), dim))
        return x, *decode(x, words, turns[dim])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                few = batch.slice(at, 500)
                dim = few.column(0).to_numpy()
                for d in np.unique(dim):
                    mine = few.filter(pa.array(dim == d))
                    _, row, found = filters_of(mine.column(1).to_pylist(), int(d))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found, pa.int64()), *(c.take(pa.array(row)) for c in mine.columns)],
                        names=["filter", *mine.schema.names],
                    )

    listed = classes.select("dim", "vec", "rep", "copies").mapInArrow(
        spread, "filter bigint, dim int, vec binary, rep bigint, copies bigint"
    )
    counts = stage(listed.groupBy("dim", "filter").agg(F.count("*").alias("held")), "filter-counts")
    met = counts.filter("held > 1")
    total = met.agg(F.sum("held")).first()[0] or 0
    tasks = max(1, -(-total // 5000))
    hot = broadcast_if_small(met.filter(F.col("held") > 2 * BLOCK))
    cells = (
        listed.join(hot, ["dim", "filter"], "left")
        .withColumn("_blocks", F.coalesce(F.ceil(F.col("held") / BLOCK), F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("_blocks")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
        .withColumn("low", F.least("block", "_other"))
        .withColumn("high", F.greatest("block", "_other"))
        .withColumn("task", F.pmod(F.xxhash64("dim", "filter", "low", "high"), F.lit(tasks)))
        .select("task", "dim", "filter", "low", "high", "block", "rep", "copies", "vec")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dim", "filter", "low", "high", "rep"], kind="stable", ignore_index=True)
        keys = pdf[["dim", "filter", "low", "high"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)])
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(pdf)], strict=True):
            if b - a > 1:
                dim, filter_id, low, high = (int(k) for k in keys[a])
                cell = pdf.iloc[a:b]
                x = unit(np.frombuffer(b"".join(cell["vec"]), kind).reshape(b - a, dim))
                near = x @ x.T >= cosine
                np.fill_diagonal(near, False)
                if low != high:
                    block = cell["block"].to_numpy()
                    near &= block[:, None] != block[None, :]
                some = np.flatnonzero(near.any(1))
                if not len(some):
                    continue
                near = near[np.ix_(some, some)]
                found = cell.iloc[some]
                rep = found["rep"].to_numpy()
                root = rep.copy()
                while True:
                    least = np.minimum(root, np.where(near, root[None, :], root.max()).min(1))
                    if (least == root).all():
                        break
                    root = least
                # A pair belongs to the first cap that holds both.
                row, other = decode(x[some], words, turns[dim])
                row, other = row[other < filter_id], other[other < filter_id]
                _, column = np.unique(other, return_inverse=True)
                width = int(column.max()) + 1 if len(column) else 0
                for at in range(0, width, 2000):
                    here = (column >= at) & (column < at + 2000)
                    earlier = np.zeros((len(some), min(2000, width - at)), np.float32)
                    earlier[row[here], column[here] - at] = 1
                    near = near & (earlier @ earlier.T < 0.5)
                links = near @ found["copies"].to_numpy()
                out.append(pd.DataFrame({"rep": rep, "links": links.astype(np.int64), "root": root}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")

    seen = stage(
        cells.groupBy("task").applyInPandas(compare, "rep bigint, links bigint, root bigint"), "near-vectors"
    )
    roots = components(seen.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    links = seen.groupBy("rep").agg(F.sum("links").alias("links"))
    summed = classes.join(links, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        F.col("dim").alias("_dim"),
        F.col("vec").alias("_vec"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
        F.coalesce("root", "rep").alias("_component"),
    )
    component = F.coalesce("_component", "vec_id")
    return vectors.join(
        summed,
        (F.col("dim") == F.col("_dim")) & (F.col("vec") == F.col("_vec")) & F.col("vec_id").isNotNull(),
        "left",
    ).select(
        "vec_id",
        F.coalesce("_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
