"""Best-two-fit packing of tokenized documents into sequences of a fixed capacity.

A sequence is filled greedily with the longest pieces that fit. Then its smallest piece is
given up if two unpacked pieces fill the gap that opens more tightly. As lengths are whole
numbers up to the capacity, the choice depends on how many pieces there are of each length
and on nothing else: it is made once for every distinct filling, over a table of at most
``capacity`` counts, and the pieces then find their places by their rank among the pieces of
their length.

Missing and empty texts are one token, the end mark. Repeated rows are packed once each; an
empty table gives an empty result. Only documents longer than a sequence are cut; their
first piece is the short one.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standtally.llm.common import frugal, small_batches
from standtally.sources.staging import stage

CAPACITY = 1024
END_ID = 2
# Words beyond the Latin blocks whose ids a Python worker remembers.
REMEMBERED = 20_000
# Runs of white space beyond this go to ``tokenizers``, as the faster merger recurses on them.
LONG_RUN = 5000
LONG_BLANK = re.compile(rf"\s{{{LONG_RUN}}}")
# Beyond the Latin blocks the two libraries' Unicode tables may differ in age.
BEYOND_LATIN = re.compile("[\u0250-\U0010ffff]")
# No token crosses the place before a blank that stands before a word.
WORD_START = re.compile(r"(?= [^\s\u180e])")
# Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PIECES = (
    "part int, position bigint, doc_id bigint, piece int, start bigint, length bigint,"
    " local_rank bigint, ids binary"
)


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, equal to those of ``tokenizers``.

    Texts in Latin letters go whole to a faster merger of the same vocabulary. Others are cut
    before the blank that starts a word, which no token crosses: runs of Latin words go to the
    faster merger too, and the words left to ``tokenizers``, as do very long runs of white
    space. These words' ids are remembered. ``tokenizers`` also gets texts that hold special
    tokens, and all texts under other kinds of vocabulary.
    """

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._merge_table(spec)
        self.seen: dict[str, bytes] = {}

    @cached_property
    def whole(self):
        """The complete tokenizer, read when a text first needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @staticmethod
    def _merge_table(spec: dict):
        """The same vocabulary for a faster merger, where ids follow the order of merges."""
        model = spec.get("model", {})
        if model.get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            return None
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
            return None
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable}
        letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        merged = [
            model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]
        ]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            return None
        ranks = {
            bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in added
        }
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _merged(self, text: str) -> bytes:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()

    def _encode_whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self.seen.get(word)
        if ids is None:
            ids = self._encode_whole(word)
            if len(self.seen) < REMEMBERED and len(word) < 64:
                self.seen[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.fast or any(s in text for s in self.special):
            return self._encode_whole(text)
        if not _is_apart(text):
            return self._merged(text)
        out = []
        for apart, words in groupby(WORD_START.split(text), _is_apart):
            if apart:
                out.extend(map(self._word, words))
            else:
                out.append(self._merged("".join(words)))
        return b"".join(out)


def _is_apart(text: str) -> bool:
    """Whether only ``tokenizers`` reads it right."""
    if not text.isascii() and BEYOND_LATIN.search(text):
        return True
    return len(text) >= LONG_RUN and LONG_BLANK.search(text) is not None


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def tokenize_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """Pieces of all documents with their ids, staged.

    ``part`` and ``position`` name a piece; ``local_rank`` counts the earlier pieces of its
    length in its part. They are settled by staging, whatever is computed again later.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path).encode
        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        position = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                few = batch.slice(at, 500)
                for doc_id, text in zip(few.column(0).to_pylist(), few.column(1).to_pylist(), strict=True):
                    ids = (ids_of(text) if text else b"") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        piece = ids[4 * start : 4 * (start + length)]
                        rows.append((part, position, doc_id, k, start, length, int(ranks[length]), piece))
                        ranks[length] += 1
                        position += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(c), t)
                        for c, t in zip(
                            zip(*rows, strict=True),
                            (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()),
                            strict=True,
                        )
                    ],
                    names=["part", "position", "doc_id", "piece", "start", "length", "local_rank", "ids"],
                )

    read = docs.selectExpr("cast(doc_id as bigint) doc_id", "text")
    # Executors hold several copies of each batch that goes to Python, outside the heap.
    with small_batches(docs.sparkSession):
        return stage(read.mapInArrow(frugal(run), PIECES), "pieces")


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(number of sequences, lengths in them) for so many pieces of each length.

    One entry per distinct filling: while the same filling can be repeated, the greedy
    choice repeats it, so the number of entries depends on the capacity, not on the pieces.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    fillings = []
    while lengths:
        used: dict[int, int] = {}
        gap = capacity

        def free(length: int) -> int:
            return left[length] - used.get(length, 0)

        at = len(lengths)
        while True:
            at = bisect.bisect_right(lengths, gap, 0, at) - 1
            if at < 0:
                break
            length = lengths[at]
            take = min(free(length), gap // length)
            if take:
                used[length] = used.get(length, 0) + take
                gap -= take * length
        while gap:
            smallest = min(used)
            pair = _closest_pair(lengths, free, smallest, gap + smallest)
            if pair is None:
                break
            used[smallest] -= 1
            if not used[smallest]:
                del used[smallest]
            for length in pair:
                used[length] = used.get(length, 0) + 1
            gap += smallest - sum(pair)
        times = min(left[length] // n for length, n in used.items())
        filling = [length for length in sorted(used, reverse=True) for _ in range(used[length])]
        fillings.append((times, filling))
        for length, n in used.items():
            left[length] -= times * n
            if not left[length]:
                del left[length]
                lengths.pop(bisect.bisect_left(lengths, length))
    return fillings


def _closest_pair(lengths: list[int], free, smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked pieces with the largest sum over ``smallest`` and up to ``room``."""
    low, high = 0, bisect.bisect_right(lengths, room) - 1
    best, pair = smallest, None
    while low <= high:
        a, b = lengths[low], lengths[high]
        if not free(a):
            low += 1
        elif not free(b) or a + b > room or (low == high and free(a) < 2):
            high -= 1
        else:
            if a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            low += 1
    return pair


def slots_of(fillings: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, copies in a sequence, first sequence, first offset)."""
    slots = []
    given: dict[int, int] = {}
    sequence = 0
    for times, filling in fillings:
        offset = 0
        for length in dict.fromkeys(filling):
            copies = filling.count(length)
            rank = given.get(length, 0)
            slots.append((length, rank, rank + times * copies - 1, copies, sequence, offset))
            given[length] = rank + times * copies
            offset += copies * length
        sequence += times
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (part, length, local_rank and any others) with sequence_id and offset.

    The counts of lengths, at most ``capacity`` rows, are gathered on the driver, and the
    slots they lead to are broadcast; their number is bounded by the capacity as well. A
    piece's rank among all of its length is its rank in its part plus the pieces of that
    length in the parts before, from one row per part and length.
    """
    spark = pieces.sparkSession
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = slots_of(best_two_fit(counts, capacity))
    table = spark.createDataFrame(
        slots, "length bigint, _from bigint, _to bigint, _copies bigint, _sequence bigint, _offset bigint"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_part.select("part", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(starts, ["part", "length"]).withColumn("_rank", F.col("_before") + F.col("local_rank"))
    nth = F.col("_rank") - F.col("_from")
    return (
        ranked.join(F.broadcast(table), "length")
        .filter(F.col("_rank").between(F.col("_from"), F.col("_to")))
        .withColumn("sequence_id", F.col("_sequence") + F.floor(nth / F.col("_copies")))
        .withColumn("offset", F.col("_offset") + (nth % F.col("_copies")) * F.col("length"))
        .drop("_before", "_rank", "_from", "_to", "_copies", "_sequence", "_offset")
    )
