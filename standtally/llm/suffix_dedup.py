"""Removal of byte strings that an earlier document holds, by a threshold-bounded BWT.

A byte goes if some string of ``length`` bytes that covers it also starts in a document with
a smaller doc_id. Suffixes that share their first ``length`` bytes form an interval of the
suffix array. The intervals are found from the Burrows-Wheeler transform: all suffixes share
the empty prefix, and extending the intervals of one length backward by a byte gives those of
the next. So common prefixes become known by increasing value, and at ``length`` it stops.

A suffix array of the whole corpus has no place in one task. Every string of ``length`` bytes
is therefore assigned to the smallest hash among its shorter strings (its anchor), which equal
texts share. Documents travel in chunks; for each anchor a chunk sends only a fingerprint of
it, is told which of them other documents have too, and sends the distinct surroundings of
those. Surroundings of one anchor meet in one task, where transforms of about a megabyte each
are expanded. What comes back is the smallest doc_id of each string that repeats. Copies of
whole documents are set aside first. A chunk sends a surrounding once however many of its
documents hold it, and two chunks never exchange pairs.

Documents shorter than ``length`` and missing texts lose nothing. Rows without doc_id lose
nothing and are not matched. Rows with equal doc_id don't take from each other. What is left
of a text need not be valid UTF-8, so it is binary. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.sources.staging import broadcast_if_small, stage

LENGTH = 50
# Bytes of an anchor, of a chunk, of the windows looked at in one go, of one transform.
ANCHOR = 24
CHUNK = 4 << 20
BLOCK = 1 << 20
TRANSFORM = 1 << 20

_PLACE = np.uint64((1 << 24) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from every position on, where so many are left."""
    words = np.array(np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)))
    n = len(data) - ANCHOR + 1
    h = _mix(words[:n] * np.uint64(0x9E3779B97F4A7C15))
    for at in range(8, ANCHOR, 8):
        h = _mix((h ^ words[at : at + n]) * np.uint64(0x94D049BB133111EB))
    return h


def _sliding_minimum(v: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    return v if have == width else np.minimum(v[: len(v) - (width - have)], v[width - have :])


def anchored_runs(
    data: np.ndarray, ends: np.ndarray, length: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block: (hash of the anchor, its offset in the run, first window, last window).

    A run is a stretch of windows (strings of ``length`` bytes within one document) with one
    anchor. ``ends`` are the ends of the documents in ``data``.
    """
    spread = length - ANCHOR + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        here = data[at : at + BLOCK + length - 1]
        h = anchor_hashes(here)
        v = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (_sliding_minimum(v, spread) & _PLACE).astype(np.int64)
        window = np.arange(len(place))
        document = np.searchsorted(ends, window + at, "right")
        valid = window + at + length <= ends[document]
        new = np.r_[True, (place[1:] != place[:-1]) | (document[1:] != document[:-1])]
        breaks = np.flatnonzero(new & valid)
        if not len(breaks):
            continue
        # A run ends before the next break or the next window that leaves its document.
        stops = np.flatnonzero(np.r_[new | ~valid, True])
        last = stops[np.searchsorted(stops, breaks, "right")] - 1
        yield h[place[breaks]], place[breaks] - breaks, breaks + at, last + at


def _chunked(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) in chunks of some megabytes, staged: ids, lengths, packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        ids: list[int] = []
        texts: list[bytes] = []
        size = count = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([base + count], pa.int64()),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                    pa.array([pa.compress(b"".join(texts), "zstd", asbytes=True)], pa.binary()),
                ],
                names=["chunk", "ids", "lengths", "packed"],
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids.append(doc_id.as_py())
                texts.append(text.as_buffer().to_pybytes())
                size += len(texts[-1])
                if size >= CHUNK:
                    yield flush()
                    ids, texts, size, count = [], [], 0, count + 1
        if ids:
            yield flush()

    return stage(
        docs.select("doc_id", "text").mapInArrow(
            run, "chunk bigint, ids array<bigint>, lengths array<bigint>, packed binary"
        ),
        "text-chunks",
    )


def _opened(ids, lengths, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ends, bytes) of a chunk."""
    ends = np.cumsum(np.array(lengths, np.int64))
    data = np.frombuffer(pa.decompress(packed, int(ends[-1]), "zstd", asbytes=True), np.uint8)
    return np.array(ids, np.int64), ends, data


def _short(h: np.ndarray, bits: int) -> np.ndarray:
    """The bucket (so many bits) and 32 further bits of a hash."""
    return h >> np.uint64(32 - bits)


def _fingerprints(chunks: DataFrame, bits: int, length: int) -> DataFrame:
    """(bucket, chunk, prints, several): sorted distinct fingerprints of a chunk's anchors.

    ``several`` marks those that more than one of the chunk's documents have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, ids, lengths, packed = (batch.column(j)[k].as_py() for j in range(4))
                _, ends, data = _opened(ids, lengths, packed)
                shorts, owners = [], []
                for h, _, first, _ in anchored_runs(data, ends, length):
                    shorts.append(_short(h, bits))
                    owners.append(np.searchsorted(ends, first, "right"))
                if not shorts:
                    continue
                short, owner = np.concatenate(shorts), np.concatenate(owners)
                order = np.argsort(short, kind="stable")
                short, owner = short[order], owner[order]
                starts = np.flatnonzero(np.r_[True, short[1:] != short[:-1]])
                several = np.maximum.reduceat(owner, starts) != np.minimum.reduceat(owner, starts)
                short = short[starts]
                bucket = (short >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
                low = short.astype(np.uint32)
                pieces = list(zip(cuts[:-1], cuts[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(bucket[a]) for a, _ in pieces], pa.int32()),
                        pa.array([chunk] * len(pieces), pa.int64()),
                        pa.array([low[a:b].tobytes() for a, b in pieces], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in pieces], pa.binary()),
                    ],
                    names=["bucket", "chunk", "prints", "several"],
                )

    return chunks.select("chunk", "ids", "lengths", "packed").mapInArrow(
        run, "bucket int, chunk bigint, prints binary, several binary"
    )


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: which of each chunk's fingerprints some other document has as well."""
    lists = [np.frombuffer(p, np.uint32) for p in pdf["prints"]]
    several = [
        np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)).astype(bool)
        for s, p in zip(pdf["several"], lists, strict=True)
    ]
    every = np.sort(np.concatenate(lists))
    twice = every[1:][every[1:] == every[:-1]]
    known = np.unique(np.concatenate([twice, *[p[s] for p, s in zip(lists, several, strict=True)]]))
    rows = []
    for bucket, chunk, p in zip(pdf["bucket"], pdf["chunk"], lists, strict=True):
        if len(known):
            at = np.minimum(np.searchsorted(known, p), len(known) - 1)
            hit = known[at] == p
            if hit.any():
                rows.append((chunk, bucket, np.packbits(hit).tobytes()))
    return pd.DataFrame(rows, columns=["chunk", "bucket", "bits"])


PARTS = "chunk bigint, bucket int, prints binary, rows binary, least binary, most binary, firsts binary, numbers binary"


def _surroundings(left: pd.DataFrame, right: pd.DataFrame, bits: int, length: int) -> pd.DataFrame:
    """One chunk: the distinct surroundings of its repeated anchors, by bucket, and their places.

    A surrounding is a run of windows and the bytes they cover, in a row of fixed width with
    its length and a closing byte. Rows of bucket -1 keep the chunk's places to itself.
    """
    if not len(left) or not len(right):
        return pd.DataFrame(columns=[c.split()[0] for c in PARTS.split(", ")])
    chunk = int(left["chunk"][0])
    ids, ends, data = _opened(left["ids"][0], left["lengths"][0], left["packed"][0])
    runs = list(anchored_runs(data, ends, length))
    every = np.unique(np.concatenate([_short(h, bits) for h, *_ in runs]))
    bucket = (every >> np.uint64(32)).astype(np.int64)
    repeated = np.zeros(len(every), bool)
    for b, found in zip(right["bucket"], right["bits"], strict=True):
        a, z = np.searchsorted(bucket, [b, b + 1])
        repeated[a:z] = np.unpackbits(np.frombuffer(found, np.uint8), count=z - a).astype(bool)
    width = 2 * length - ANCHOR
    shorts, texts, leasts, mosts, firsts, numbers = [], [], [], [], [], []
    count = 0
    for h, _, first, last in runs:
        short = _short(h, bits)
        keep = repeated[np.searchsorted(every, short)]
        if not keep.any():
            continue
        short, first, last = short[keep], first[keep], last[keep]
        size = last - first + length
        column = np.arange(width)
        grid = data[np.minimum(first[:, None] + column, len(data) - 1)]
        grid[column >= size[:, None]] = 0
        row = np.ones((len(first), width + 6), np.uint8)
        row[:, :4] = short.astype(">u4").view(np.uint8).reshape(-1, 4)
        row[:, 4 : width + 4] = grid
        row[:, width + 4] = size
        # The bucket leads, so that equal surroundings of one bucket stand together.
        keyed = np.concatenate([(short >> np.uint64(32)).astype(">u4").view(np.uint8).reshape(-1, 4), row], axis=1)
        distinct, at, inverse = np.unique(
            np.ascontiguousarray(keyed).view(f"S{width + 10}").ravel(), return_index=True, return_inverse=True
        )
        owner = ids[np.searchsorted(ends, first, "right")]
        order = np.argsort(inverse, kind="stable")
        starts = np.searchsorted(inverse[order], np.arange(len(distinct)))
        shorts.append(short[at])
        texts.append(row[at])
        leasts.append(np.minimum.reduceat(owner[order], starts))
        mosts.append(np.maximum.reduceat(owner[order], starts))
        firsts.append(first)
        numbers.append(inverse + count)
        count += len(distinct)
    if not count:
        return pd.DataFrame(columns=[c.split()[0] for c in PARTS.split(", ")])
    short, text = np.concatenate(shorts), np.concatenate(texts)
    least, most = np.concatenate(leasts), np.concatenate(mosts)
    bucket = (short >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    renumbered = np.empty(count, np.int64)
    renumbered[order] = np.arange(count)
    bucket = bucket[order]
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        mine = order[a:b]
        packed = pa.compress(text[mine].tobytes(), "zstd", asbytes=True)
        rows.append((chunk, int(bucket[a]), int(a).to_bytes(8, "little"), packed, least[mine].tobytes(), most[mine].tobytes(), None, None))
    places = np.concatenate(firsts), renumbered[np.concatenate(numbers)]
    order = np.argsort(places[1], kind="stable")
    rows.append((chunk, -1, None, None, None, None, places[0][order].tobytes(), places[1][order].tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PARTS.split(", ")])


def suffix_order(text: np.ndarray, left: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in order of their first ``length`` bytes at least, by doubling.

    ``left`` says how many bytes follow a position in its row; a suffix ends there.
    """
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.array(np.ndarray((n,), ">u8", padded, strides=(1,))).astype(np.uint64)
    cut = np.minimum(left, 8)
    words &= np.uint64(2**64 - 1) << ((8 - cut).astype(np.uint64) * np.uint64(8))
    order = np.lexsort((cut, words))
    new = np.r_[False, (words[order][1:] != words[order][:-1]) | (cut[order][1:] != cut[order][:-1])]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new)
    have = 8
    while have < length:
        following = np.where(left > have, rank[np.minimum(np.arange(n) + have, n - 1)] + 1, 0)
        key = rank * (n + 1) + following
        order = np.argsort(key, kind="stable")
        rank[order] = np.cumsum(np.r_[False, key[order][1:] != key[order][:-1]])
        have *= 2
    return order


def repeated_prefixes(text: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, interval number of each) for prefixes of ``length`` bytes.

    Breadth-first by length: with the intervals of one length known, the suffix one byte
    earlier belongs to the interval of (that byte, interval). The step from a suffix to the
    next one in the text is the inverse of the backward step of the transform, so a suffix
    opens a new interval if its first byte or the interval of its next suffix differs from
    its predecessor's. Suffixes that end before ``length`` bytes stay alone.
    """
    n = len(text)
    order = suffix_order(text, left, length)
    where = np.empty(n, np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    ends = left[order] <= 1
    nexts = np.where(ends, n + np.arange(n), where[np.minimum(order + 1, n - 1)]).astype(np.int32)
    byte = text[order]
    opens = np.r_[True, byte[1:] != byte[:-1]]
    number = np.zeros(2 * n, np.int32)
    for _ in range(length):
        of_next = number[nexts]
        now = opens.copy()
        now[1:] |= of_next[1:] != of_next[:-1]
        number[:n] = np.cumsum(now, dtype=np.int32)
        number[n:] = -1 - np.arange(n, dtype=np.int32)  # no further byte: like nothing else
    return order, number[:n]


def _least_by_window(rows: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For every window of the rows, in order: the smallest doc_id that has its string."""
    inside = np.arange(rows.shape[1]) < sizes[:, None]
    text = rows[inside]
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    left = ends[row] - np.arange(len(text))
    order, interval = repeated_prefixes(text, left, length)
    starts = np.flatnonzero(np.r_[True, interval[1:] != interval[:-1]])
    smallest = np.minimum.reduceat(least[row[order]], starts)
    by_suffix = np.empty(len(text), np.int64)
    by_suffix[order] = smallest[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(text)]))]
    return by_suffix[left >= length]


FOUND = "chunk bigint, number binary, offset binary, windows binary, source binary"


def _sources(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """One bucket: runs of windows of each chunk's surroundings with a smaller doc_id elsewhere."""
    width = 2 * length - ANCHOR
    counts = [len(x) // 8 for x in pdf["least"]]
    full = b"".join(
        pa.decompress(r, n * (width + 6), "zstd", asbytes=True) for r, n in zip(pdf["rows"], counts, strict=True)
    )
    keyed = np.frombuffer(full, f"S{width + 6}")
    entry_least = np.frombuffer(b"".join(pdf["least"]), np.int64)
    entry_most = np.frombuffer(b"".join(pdf["most"]), np.int64)
    chunk = np.repeat(pdf["chunk"].to_numpy(), counts)
    number = np.concatenate(
        [int.from_bytes(f, "little") + np.arange(n) for f, n in zip(pdf["prints"], counts, strict=True)]
    )
    distinct, at, inverse = np.unique(keyed, return_index=True, return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    least = np.minimum.reduceat(entry_least[order], np.searchsorted(inverse[order], np.arange(len(distinct))))
    grid = np.frombuffer(full, np.uint8).reshape(-1, width + 6)[at]
    sizes = grid[:, width + 4].astype(np.int64)
    windows = sizes - length + 1
    first = np.r_[0, np.cumsum(windows)]
    source = np.repeat(least, windows)
    anchor = np.ascontiguousarray(grid[:, :4]).view(">u4").ravel()
    # Surroundings of an anchor that are all alike need no comparing.
    groups = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True])
    mixed = np.repeat(np.diff(groups) > 1, np.diff(groups))
    picked = np.flatnonzero(mixed)
    a = 0
    total = np.cumsum(sizes[picked])
    while a < len(picked):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + TRANSFORM, "right"))
        b = min(max(b, a + 1), len(picked))
        while b < len(picked) and anchor[picked[b]] == anchor[picked[b - 1]]:
            b += 1
        some = picked[a:b]
        found = _least_by_window(grid[some, 4 : width + 4], sizes[some], least[some], length)
        source[np.repeat(first[some], windows[some]) + _ramp(windows[some])] = found
        a = b
    # Runs of windows with one source, then for every chunk that has the surrounding.
    row = np.repeat(np.arange(len(distinct)), windows)
    starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (source[1:] != source[:-1])])
    run_row, run_source = row[starts], source[starts]
    run_offset = starts - first[run_row]
    run_windows = np.diff(np.r_[starts, len(row)])
    bounds = np.searchsorted(run_row, np.arange(len(distinct) + 1))
    per_entry = np.diff(bounds)[inverse]
    entry = np.repeat(np.arange(len(inverse)), per_entry)
    run = np.repeat(bounds[inverse], per_entry) + _ramp(per_entry)
    useful = run_source[run] < entry_most[entry]
    entry, run = entry[useful], run[useful]
    out = []
    order = np.argsort(chunk[entry], kind="stable")
    entry, run = entry[order], run[order]
    cuts = np.flatnonzero(np.r_[True, chunk[entry][1:] != chunk[entry][:-1], True]) if len(entry) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        e, r = entry[a:b], run[a:b]
        out.append(
            (
                int(chunk[e[0]]),
                number[e].astype(np.int64).tobytes(),
                run_offset[r].astype(np.uint8).tobytes(),
                run_windows[r].astype(np.uint8).tobytes(),
                run_source[r].tobytes(),
            )
        )
    return pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each of the counts, end to end."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


KEPT = "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary"


def _cut_out(left: pd.DataFrame, right: pd.DataFrame, length: int) -> pd.DataFrame:
    """One chunk: every document with the spans it loses and the bytes it keeps."""
    if not len(left):
        return pd.DataFrame(columns=[c.split()[0] for c in KEPT.split(", ")])
    ids, ends, data = _opened(left["ids"][0], left["lengths"][0], left["packed"][0])
    starts: list[np.ndarray] = []
    stops: list[np.ndarray] = []
    places = right[right["firsts"].notna()]
    if len(places):
        first = np.frombuffer(places["firsts"].iloc[0], np.int64)
        number = np.frombuffer(places["numbers"].iloc[0], np.int64)
        owner = ids[np.searchsorted(ends, first, "right")]
        for n, o, w, s in right.loc[right["number"].notna(), ["number", "offset", "windows", "source"]].itertuples(index=False):
            asked = np.frombuffer(n, np.int64)
            a, b = np.searchsorted(number, asked), np.searchsorted(number, asked, "right")
            run = np.repeat(np.arange(len(asked)), b - a)
            at = np.repeat(a, b - a) + _ramp(b - a)
            later = np.frombuffer(s, np.int64)[run] < owner[at]
            run, at = run[later], at[later]
            starts.append(first[at] + np.frombuffer(o, np.uint8)[run])
            stops.append(starts[-1] + np.frombuffer(w, np.uint8)[run] - 1 + length)
    change = np.zeros(len(data) + 1, np.int32)
    if starts:
        np.add.at(change, np.concatenate(starts), 1)
        np.add.at(change, np.concatenate(stops), -1)
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    for doc_id, a, b in zip(ids, np.r_[0, ends[:-1]], ends, strict=True):
        mine = gone[a:b]
        edges = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
        kept = data[a:b] if not len(edges) else data[a:b][~mine]
        rows.append((int(doc_id), int(b - a), edges[::2].tolist(), edges[1::2].tolist(), kept.tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in KEPT.split(", ")])


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, starts and ends of the spans removed, and kept, per row of ``docs``."""
    if not ANCHOR < length <= 128:
        raise ValueError(f"length must be over {ANCHOR} and up to 128")
    text = F.coalesce("text", F.lit(""))
    read = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text.alias("text"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        F.xxhash64(text).alias("_h1"),
        F.xxhash64(F.lit(1), text).alias("_h2"),
    )
    candidates = (F.col("n_bytes") >= length) & F.col("doc_id").isNotNull()
    copied = (
        read.filter(candidates)
        .groupBy("_h1", "_h2", "n_bytes")
        .agg(F.min("doc_id").alias("_first"), F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    originals = broadcast_if_small(stage(copied.select("_h1", "_h2", "_first"), "copies"))
    told = read.join(originals, ["_h1", "_h2"], "left").withColumn(
        "_state",
        F.when(~F.coalesce(candidates, F.lit(False)), "kept")
        .when(F.col("_first") < F.col("doc_id"), "copy")
        .otherwise("searched"),
    )
    chunks = _chunked(told.filter("_state = 'searched'"))
    total = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b))).first()[0] or 0
    bits = min(24, max(6, int(np.ceil(np.log2(max(total, 1) ** 0.5 / 64)))))

    flags = (
        _fingerprints(chunks, bits, length)
        .groupBy("bucket")
        .applyInPandas(_repeated, "chunk bigint, bucket int, bits binary")
    )
    parts = stage(
        chunks.groupBy("chunk")
        .cogroup(flags.groupBy("chunk"))
        .applyInPandas(lambda a, b: _surroundings(a, b, bits, length), PARTS),
        "surroundings",
    )
    found = (
        parts.filter("bucket >= 0")
        .groupBy("bucket")
        .applyInPandas(lambda pdf: _sources(pdf, length), FOUND)
    )
    answers = parts.filter("bucket = -1").select("chunk", "firsts", "numbers").unionByName(
        found, allowMissingColumns=True
    )
    searched = (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(lambda a, b: _cut_out(a, b, length), KEPT)
    )
    none = F.array().cast("array<bigint>")
    copy = F.col("_state") == "copy"
    others = told.filter("_state <> 'searched'").select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.array(F.lit(0).cast("bigint"))).otherwise(none).alias("starts"),
        F.when(copy, F.array("n_bytes")).otherwise(none).alias("ends"),
        F.when(copy, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"),
    )
    return searched.unionByName(others)
