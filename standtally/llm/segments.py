"""Running sums inside groups of any size, over rows that a range sort spreads over tasks.

A window would send a group to one task. Here every task sums its own stretch of the sorted
rows, and what a stretch adds to a group that goes on in the next one is known from one row
per task: two rows per task come to the driver, however large the table or a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.llm.common import shuffle_partitions
from standtally.sources.staging import stage

# Odd multipliers of the two prefix polynomials, modulo 2**64.
MULTIPLIERS = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
WRAP = (1 << 64) - 1

# What a stretch hands on: group, number of rows, sums, polynomials.
Carry = tuple[int, int, tuple[int, ...], tuple[int, ...]]


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base`` to each exponent, modulo 2**64."""
    out = np.ones(len(exponents), np.uint64)
    left = exponents.astype(np.uint64)
    square = base
    while left.any():
        np.multiply(out, np.uint64(square), out=out, where=(left & np.uint64(1)).astype(bool))
        left >>= np.uint64(1)
        square = square * square & WRAP
    return out


def _inside(values: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at every group's first row."""
    total = np.cumsum(values, dtype=values.dtype)
    before = total - values
    return total - before[first[at]]


class _Stretch:
    """Running values of one task's rows, batch by batch."""

    def __init__(self, n_sums: int, n_polynomials: int) -> None:
        self.group: int | None = None
        self.k = 0
        self.sums = [0] * n_sums
        self.polynomials = [0] * n_polynomials

    def add(self, group: np.ndarray, sums: list[np.ndarray], terms: list[np.ndarray]):
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        first = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        goes_on = self.group is not None and int(group[0]) == self.group
        same = (at == 0) & goes_on
        k = np.arange(len(group)) - first[at] + 1
        k[same] += self.k
        out_sums = []
        for j, values in enumerate(sums):
            s = _inside(values.astype(np.int64), first, at)
            s[same] += self.sums[j]
            out_sums.append(s)
        out_terms = []
        for j, values in enumerate(terms):
            p = _inside(values.view(np.uint64) * power(MULTIPLIERS[j], k), first, at)
            p[same] += np.uint64(self.polynomials[j])
            out_terms.append(p)
        self.group, self.k = int(group[-1]), int(k[-1])
        self.sums = [int(s[-1]) for s in out_sums]
        self.polynomials = [int(p[-1]) for p in out_terms]
        return k, out_sums, out_terms


def scan(
    df: DataFrame, group: str, order: list, sums: list[str], terms: list[str], name: str
) -> DataFrame:
    """``df`` with running values of its stretch, staged.

    ``order`` sorts the rows and begins with ``group``, a whole number. Added are ``part``,
    the task's number; ``k``, the row's place in its group; ``sum_<c>`` for each column of
    ``sums``; ``poly_<c>`` for each of ``terms``, the sum of value times multiplier to the
    power k; ``last``, 1 for the last row of its group in the stretch; and ``edge``, 1 for a
    task's first row, 2 for its last, 3 for an only one.
    """
    added = "part int, k bigint, last int, edge int"
    added += "".join(f", sum_{c} bigint" for c in sums) + "".join(f", poly_{c} bigint" for c in terms)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)

    def numbered(batch: pa.RecordBatch, stretch: _Stretch, part: int, first: bool, after: int | None):
        get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        groups = get(group)
        k, s, p = stretch.add(groups, [get(c) for c in sums], [get(c) for c in terms])
        edge, last = np.zeros(len(k), np.int32), np.ones(len(k), np.int32)
        edge[0] += first
        edge[-1] += 2 * (after is None)
        last[:-1] = groups[1:] != groups[:-1]
        last[-1] = after is None or after != groups[-1]
        new = [np.full(len(k), part, np.int32), k, last, edge, *s, *[x.view(np.int64) for x in p]]
        names = ["part", "k", "last", "edge", *[f"sum_{c}" for c in sums], *[f"poly_{c}" for c in terms]]
        return pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], names=[*batch.schema.names, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, part, held, first = _Stretch(len(sums), len(terms)), TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield numbered(held, stretch, part, first, batch.column(group)[0].as_py())
                first = False
            held = batch
        if held is not None:
            yield numbered(held, stretch, part, first, None)

    spread = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    return stage(spread.mapInArrow(run, f"{fields}, {added}"), name)


def carries(scanned: DataFrame, group: str, sums: list[str], terms: list[str]) -> tuple[dict[int, Carry], set[int]]:
    """What earlier stretches add to the first group of a stretch, by the stretch's number;
    and the stretches whose last group goes on in the next. Two rows a stretch are read."""
    columns = ["part", "edge", group, "k", *[f"sum_{c}" for c in sums], *[f"poly_{c}" for c in terms]]
    parts: dict[int, dict[int, tuple]] = {}
    for row in scanned.filter("edge > 0").select(*columns).collect():
        for bit in (1, 2):
            if row.edge & bit:
                parts.setdefault(row.part, {})[bit] = tuple(row)[2:]
    found: dict[int, Carry] = {}
    goes_on: set[int] = set()
    before: tuple[int, Carry] | None = None
    n = len(sums)
    for part in sorted(parts):
        first, last = parts[part][1], parts[part][2]
        carry = None
        if before and before[1][0] == first[0]:
            carry = found[part] = before[1]
            goes_on.add(before[0])
        k, s, p = last[1], last[2 : 2 + n], tuple(x & WRAP for x in last[2 + n :])
        if carry and first[0] == last[0]:
            shift = [pow(MULTIPLIERS[j], carry[1], 1 << 64) for j in range(len(p))]
            s = tuple(a + b for a, b in zip(s, carry[2], strict=True))
            p = tuple((b + q * a) & WRAP for a, b, q in zip(p, carry[3], shift, strict=True))
            k += carry[1]
        before = (part, (last[0], k, tuple(s), p))
    return found, goes_on


def whole_sums(scanned: DataFrame, group: str, sums: list[str]) -> DataFrame:
    """``scanned`` with ``k`` and the sums counted over whole groups."""
    found, _ = carries(scanned, group, sums, [])
    added = [f"_add_{c}" for c in ["k", *sums]]
    schema = f"part int, {group} bigint, " + ", ".join(f"{c} bigint" for c in added)
    table = scanned.sparkSession.createDataFrame(
        [(part, c[0], c[1], *c[2]) for part, c in found.items()], schema
    )
    # At most one row a task.
    both = scanned.join(F.broadcast(table), ["part", group], "left")
    for c, a in zip(["k", *[f"sum_{c}" for c in sums]], added, strict=True):
        both = both.withColumn(c, F.col(c) + F.coalesce(a, F.lit(0)))
    return both.drop("part", "last", "edge", *added)


def whole_polynomials(
    columns: dict[str, np.ndarray], group: str, terms: list[str], found: dict[int, Carry]
) -> tuple[np.ndarray, list[np.ndarray]]:
    """(place, polynomials) over whole groups of some rows of a scan."""
    k, part = columns["k"].astype(np.int64), columns["part"]
    polynomials = [columns[f"poly_{c}"].view(np.uint64).copy() for c in terms]
    for number in np.unique(part):
        carry = found.get(int(number))
        if carry is None:
            continue
        rows = np.flatnonzero((part == number) & (columns[group] == carry[0]))
        for j, p in enumerate(polynomials):
            p[rows] = np.uint64(carry[3][j]) + p[rows] * np.uint64(pow(MULTIPLIERS[j], carry[1], 1 << 64))
        k[rows] += carry[1]
    return k, polynomials


def by_batch(work: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable:
    """A function for ``mapInArrow`` from one on batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return run
