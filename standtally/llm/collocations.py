"""Collocations: frequent phrases whose parts seldom stand apart, mined by Rabin-Karp fingerprints.

Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces, and those at
blanks and tabs into words. Prefix polynomials in numpy give every word, and from words every
phrase, a 64-bit fingerprint that holds its language; only fingerprints and counts are shuffled.
Phrases of n words are looked at where both phrases of n - 1 words in them are frequent, as no
other can be. Frequent fingerprints of each length become a bitmap of a fixed largest size; past
it more is shuffled, with the same result. A last scan takes the occurrences that the bitmaps
admit, compares them byte by byte with the text that their fingerprint's first occurrence points
to, and writes out a phrase once a task, with its count and a pointer to its first occurrence.
Counts are then added by text, so no collision is left in them.

Missing texts are empty, missing languages are ``und``. Repeated rows count each. Texts are
worked on in slices of a megabyte that overlap by the words a phrase may still need; a single
word longer than that is held whole. An empty table has no phrases. Rows without ``doc_id``
count, and are pointed to last. Further columns are ignored. Building the plan runs jobs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from standtally.llm.common import frugal, join_many_to_one
from standtally.sources.staging import stage

LONGEST = 4
MIN_COUNT = 30
INSIDE_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
NO_LANGUAGE = "und"

SLICE = 1 << 20
BUFFER = 1 << 20
# Fingerprints that a task collects before it counts and sends them.
GATHERED = 3_000_000
# Phrases that a task holds before it sends them.
COUNTED = 1_000_000
# Splits of the input that one task of the last scan reads, where there are many: the more
# text a task sees, the fewer rows it sends for a phrase.
SPLITS = 4
# Bits in the bitmap of a length: 8 MB.
MAX_BITS = 1 << 26

_SEPARATORS = b".,;:!?\x0a\x0b\x0c\x0d"
_CLEAN = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _SEPARATORS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_SEPARATORS)
)
_BLANKS = re.compile(rb"  +")
_BASE = 0xD1342543DE82EF95
_STEP = 0x9E3779B97F4A7C15
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the usual buffer."""
    size = 2 * BUFFER
    if n > size:
        return _table(_BASE, n), _table(pow(_BASE, -1, 1 << 64), n)
    if not _POWERS:
        _POWERS["up"], _POWERS["down"] = _table(_BASE, size), _table(pow(_BASE, -1, 1 << 64), size)
    return _POWERS["up"], _POWERS["down"]


def _table(base: int, n: int) -> np.ndarray:
    table = np.full(n, base, np.uint64)
    table[0] = 1
    return np.cumprod(table, out=table)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[0])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(32))


def _language(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.sha256(lang.encode()).digest()[:8], "little"))


def _slices(data: bytes, longest: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, how many of them are the slice's own); the others only complete its phrases."""
    more = re.compile(rb"(?: *[^ \n]+){0,%d}" % (longest - 1))
    at = 0
    while at < len(data):
        cut = min(at + size, len(data))
        if cut < len(data):
            found = re.compile(rb"[ \n]").search(data, cut)
            cut = found.start() if found else len(data)
        yield data[at : more.match(data, cut).end()], cut - at
        at = cut


class Words:
    """The words of some slices with their fingerprints."""

    def __init__(self, slices: list[tuple[bytes, int, int]], languages: list[str]) -> None:
        self.raw = b"\n".join(s for s, *_ in slices) + b"\n"
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.inside = (self.bytes != 32) & (self.bytes != 10)
        edge = np.diff(self.inside.view(np.int8), prepend=np.int8(0))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = np.array([len(s) + 1 for s, *_ in slices])
        offset = np.cumsum(size) - size
        own = np.array([n for _, n, _ in slices])
        doc = np.array([d for *_, d in slices])
        at = np.searchsorted(offset, self.start, "right") - 1
        self.own = self.start < (offset + own)[at]
        self.slice, self.doc = at, doc[at]
        self.piece = np.cumsum(self.bytes == 10, dtype=np.int32)[self.start]
        up, down = _powers(len(self.bytes))
        prefix = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum((self.bytes + np.uint64(1)) * up[: len(self.bytes)], out=prefix[1:])
        length = (self.end - self.start).astype(np.uint64)
        self.word = _mixed((prefix[self.end] - prefix[self.start]) * down[self.start] + length * np.uint64(_STEP))
        self.language = np.array([_language(x) for x in languages], np.uint64)[self.doc]

    def phrases(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of the phrases of n words, and which of them are phrases of the slices."""
        m = max(len(self.word) - n + 1, 0)
        total, step = np.zeros(m, np.uint64), 1
        for j in range(n):
            total += self.word[j : m + j] * np.uint64(step)
            step = step * _BASE & ((1 << 64) - 1)
        one_piece = self.own[:m] & (self.piece[:m] == self.piece[n - 1 : m + n - 1])
        return _mixed(total + self.language[:m] * np.uint64(_STEP) + np.uint64(n)), one_piece

    def word_ids(self) -> np.ndarray:
        """Numbers that are equal where the words are, byte by byte."""
        _, first, ids = np.unique(self.word, return_index=True, return_inverse=True)
        model, length = first[ids], self.end - self.start
        at = np.flatnonzero(self.inside)
        same = (length == length[model]).all()
        if same and (self.bytes[at + np.repeat(self.start[model] - self.start, length)] == self.bytes[at]).all():
            return ids
        known: dict[bytes, int] = {}
        pairs = zip(self.start, self.end, strict=True)
        return np.array([known.setdefault(self.raw[a:b], len(known)) for a, b in pairs])

    def text(self, i: int, n: int) -> bytes:
        return self.raw[self.start[i] : self.end[i + n - 1]]


def _gather(source: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The named stretches of some bytes, one after the other."""
    before = np.cumsum(length) - length
    return source[np.arange(length.sum()) + np.repeat(start - before, length)]


class Counted:
    """Phrases of a task by fingerprint: text, count, first occurrence.

    A phrase whose fingerprint is held with another text is counted apart, by its text.
    """

    KINDS = {
        "n": np.int64, "lang": np.int32, "size": np.int16, "doc": np.int64, "word": np.int64,
        "start": np.int64, "length": np.int32,
    }
    NUMBERS = tuple(KINDS)
    NO_DOC = np.iinfo(np.int64).max

    def __init__(self) -> None:
        self.fingerprint = np.zeros(0, np.uint64)
        self.held = {c: np.zeros(0, kind) for c, kind in self.KINDS.items()}
        self.bytes = np.zeros(0, np.uint8)
        self.apart: dict[tuple, list] = {}

    def add(self, fingerprint: np.ndarray, new: dict[str, np.ndarray], source: np.ndarray) -> None:
        """Add sorted fingerprints; ``start`` and ``length`` of new tell where in source their texts are."""
        held = self.held
        at = np.searchsorted(self.fingerprint, fingerprint)
        known = np.zeros(len(at), bool)
        inside = at < len(self.fingerprint)
        known[inside] = self.fingerprint[at[inside]] == fingerprint[inside]
        rows = np.flatnonzero(known)
        old = at[rows]
        same = np.ones(len(rows), bool)
        for c in ("lang", "size", "length"):
            same &= held[c][old] == new[c][rows]
        rows_, old_ = rows[same], old[same]
        length = new["length"][rows_]
        equal = _gather(source, new["start"][rows_], length) == _gather(self.bytes, held["start"][old_], length)
        wrong = np.unique(np.repeat(np.arange(len(rows_)), length)[~equal])
        good = np.ones(len(rows_), bool)
        good[wrong] = False
        same[np.flatnonzero(same)[wrong]] = False
        rows_, old_ = rows_[good], old_[good]
        held["n"][old_] += new["n"][rows_]
        doc, word = new["doc"][rows_], new["word"][rows_]
        first = (doc < held["doc"][old_]) | ((doc == held["doc"][old_]) & (word < held["word"][old_]))
        held["doc"][old_[first]], held["word"][old_[first]] = doc[first], word[first]
        for i in rows[~same].tolist():
            text = source[new["start"][i] : new["start"][i] + new["length"][i]].tobytes()
            self.add_apart(text, *(int(new[c][i]) for c in ("lang", "size", "n", "doc", "word")))
        fresh = np.flatnonzero(~known)
        added = {c: new[c][fresh] for c in self.NUMBERS}
        texts = _gather(source, added["start"], added["length"])
        added["start"] = len(self.bytes) + np.cumsum(added["length"]) - added["length"]
        self.bytes = np.concatenate([self.bytes, texts])
        self.fingerprint = np.concatenate([self.fingerprint, fingerprint[fresh]])
        order = np.argsort(self.fingerprint, kind="stable")
        self.fingerprint = self.fingerprint[order]
        for c, kind in self.KINDS.items():
            held[c] = np.concatenate([held[c], added[c].astype(kind)])[order]

    def add_apart(self, text: bytes, lang: int, size: int, n: int, doc: int, word: int) -> None:
        old = self.apart.get((text, lang, size))
        self.apart[text, lang, size] = [n, doc, word] if old is None else [old[0] + n, *min(old[1:], [doc, word])]

    def batches(self, languages: list[str]) -> Iterator[pa.RecordBatch]:
        h = self.held
        for at in range(0, len(self.fingerprint), 10_000):
            few = slice(at, at + 10_000)
            texts = [self.bytes[a : a + b].tobytes() for a, b in zip(h["start"][few].tolist(), h["length"][few].tolist(), strict=True)]
            yield self._batch(languages, texts, *(h[c][few] for c in ("lang", "size", "n", "doc", "word")))
        if self.apart:
            texts, langs, sizes = zip(*self.apart, strict=True)
            numbers = (np.array(x, np.int64) for x in (langs, sizes, *zip(*self.apart.values(), strict=True)))
            yield self._batch(languages, list(texts), *numbers)

    def _batch(self, languages, texts, lang, size, n, doc, word) -> pa.RecordBatch:
        langs = pa.array([languages[i] for i in lang.tolist()], pa.string())
        phrases = pa.array(texts, pa.binary()).cast(pa.string())
        doc = pa.array(doc, mask=doc == self.NO_DOC)
        columns = [langs, pa.array(size.astype(np.int32)), phrases, pa.array(n), doc, pa.array(word)]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n", "doc_id", "word"])


def _buffers(batch: pa.RecordBatch, longest: int, size: int) -> Iterator[tuple[Words, list[str], list]]:
    """Words of a batch (doc_id, lang, text), a bounded number of bytes at a time.

    Documents go by number, so that first occurrences are those of the smallest.
    """
    ids, langs, texts = (batch.column(i) for i in range(3))
    doc_ids = ids.to_pylist()
    order = sorted(range(batch.num_rows), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0))
    slices: list[tuple[bytes, int, int]] = []
    languages: list[str] = []
    owners: list = []
    held = 0
    for i in order:
        data = _BLANKS.sub(b" ", texts[i].as_py().translate(_CLEAN))
        languages.append(langs[i].as_py())
        owners.append(doc_ids[i])
        for part, own in _slices(data, longest, size):
            if held and held + len(part) > BUFFER:
                yield Words(slices, languages), languages, owners
                slices, languages, owners, held = [], languages[-1:], owners[-1:], 0
            slices.append((part, own, len(owners) - 1))
            held += len(part) + 1
    if slices:
        yield Words(slices, languages), languages, owners


def _admitted(words: Words, n: int, bitmaps: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of length n, and those whose two parts of n - 1 words may be frequent."""
    fingerprint, valid = words.phrases(n)
    if n > 1:
        part = _marked(words.phrases(n - 1)[0], bitmaps[n - 1])
        valid = valid & part[: len(valid)] & part[1 : len(valid) + 1]
    return fingerprint, valid


def _marked(fingerprint: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    bit = fingerprint & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def count_fingerprints(docs: DataFrame, n: int, shared, longest: int, size: int = SLICE) -> DataFrame:
    """(fingerprint, n) of phrases of n words, counted in the task and then over all tasks."""

    def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["fingerprint", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _read_bitmaps(shared)
        held: list[np.ndarray] = []
        for batch in batches:
            for words, _, _ in _buffers(batch, longest, size):
                fingerprint, valid = _admitted(words, n, bitmaps)
                held.append(fingerprint[valid])
                if sum(map(len, held)) > GATHERED:
                    yield batch_of(held)
                    held = []
        if any(map(len, held)):
            yield batch_of(held)

    parts = docs.mapInArrow(frugal(run), "fingerprint bigint, n bigint")
    return parts.groupBy("fingerprint").agg(F.sum("n").alias("n"))


def _read_bitmaps(shared) -> dict[int, np.ndarray]:
    return {n: np.frombuffer(b, np.uint64) for n, b in (shared.value if shared else {}).items()}


def bitmap_of(fingerprints: DataFrame, max_bits: int = MAX_BITS) -> bytes:
    """A bit for the low bits of each fingerprint; up to ``max_bits`` of them, whatever the table."""
    count = fingerprints.count()
    bits = min(max_bits, max(1 << 12, 1 << (64 * count).bit_length()))
    bit = F.col("fingerprint").bitwiseAND(F.lit(bits - 1))
    cells = fingerprints.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.expr("bit_or(shiftleft(1L, cast(fingerprint & 63 as int)))").alias("marks")
    )
    found = cells.toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[found.column("cell").to_numpy()] = found.column("marks").to_numpy().view(np.uint64)
    return bitmap.tobytes()


def count_texts(docs: DataFrame, shared, longest: int, size: int = SLICE) -> DataFrame:
    """(lang, size, phrase, f, first) of all phrases that the bitmaps admit, counted by text.

    ``first`` points to the first occurrence, by document and number of the word in it. Rows
    of size 0 count the words of a language.
    """
    schema = "lang string, size int, phrase string, n bigint, doc_id bigint, word bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmaps = _read_bitmaps(shared)
        counted, codes = Counted(), {}
        for batch in batches:
            before: dict[int, int] = {}
            for words, languages, owners in _buffers(batch, longest, size):
                number, seen = _word_numbers(words, len(languages), before)
                code = np.array([codes.setdefault(x, len(codes)) for x in languages])
                owner = np.array([Counted.NO_DOC if d is None else d for d in owners], np.int64)
                for d in np.flatnonzero(seen).tolist():
                    counted.add_apart(b"", int(code[d]), 0, int(seen[d]), Counted.NO_DOC, 0)
                if not len(words.start):
                    continue
                ids = words.word_ids()
                for n in range(1, longest + 1):
                    fingerprint, valid = _admitted(words, n, bitmaps)
                    at = np.flatnonzero(valid & _marked(fingerprint, bitmaps[n]))
                    if not len(at):
                        continue
                    value, first, group = np.unique(fingerprint[at], return_index=True, return_inverse=True)
                    model = at[first[group]]
                    same = words.language[at] == words.language[model]
                    for j in range(n):
                        same &= ids[at + j] == ids[model + j]
                    i = at[first]
                    d, start = words.doc[i], words.start[i]
                    new = {
                        "n": np.bincount(group[same], minlength=len(first)), "lang": code[d], "size": np.full(len(i), n),
                        "doc": owner[d], "word": number[i], "start": start, "length": words.end[i + n - 1] - start,
                    }
                    counted.add(value, new, words.bytes)
                    for k in at[~same].tolist():
                        d = words.doc[k]
                        counted.add_apart(words.text(k, n), int(code[d]), n, 1, int(owner[d]), int(number[k]))
                if len(counted.fingerprint) > COUNTED:
                    yield from counted.batches(list(codes))
                    counted = Counted()
        yield from counted.batches(list(codes))

    missing = F.col("doc_id").isNull()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    fewer = docs.coalesce(max(2 * cores, docs.rdd.getNumPartitions() // SPLITS))
    return (
        fewer.mapInArrow(frugal(run), schema)
        .groupBy("lang", "size", "phrase")
        .agg(F.sum("n").alias("f"), F.min(F.struct(missing.alias("missing"), "doc_id", "word")).alias("first"))
    )


def _word_numbers(words: Words, n_docs: int, before: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Each own word's number in its document, and own words of each document of the buffer.

    Only the last document of a buffer goes on in the next, where it is the first.
    """
    own = words.own
    seen = np.bincount(words.doc[own], minlength=n_docs)
    running = np.cumsum(own) - own
    first_of_doc = np.cumsum(seen) - seen
    numbers = running - first_of_doc[words.doc]
    numbers[words.doc == 0] += before.get(0, 0)
    last = n_docs - 1
    before[0] = int(seen[last]) + (before.get(0, 0) if last == 0 else 0)
    return numbers, seen


def frequent_phrases(
    docs: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, max_bits: int = MAX_BITS, size: int = SLICE
) -> DataFrame:
    """All phrases of up to ``longest`` words that stand ``min_count`` times in a language.

    Staged, as count_texts gives them, with the rows of size 0.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.col("doc_id").cast("bigint"),
        F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    bitmaps: dict[int, bytes] = {}
    shared = None
    for n in range(1, longest + 1):
        counts = count_fingerprints(read, n, shared, longest, size)
        bitmaps[n] = bitmap_of(stage(counts.filter(F.col("n") >= min_count).select("fingerprint"), "fingerprints"), max_bits)
        shared = spark.sparkContext.broadcast(dict(bitmaps))
    counted = count_texts(read, shared, longest, size)
    return stage(counted.filter((F.col("size") == 0) | (F.col("f") >= min_count)), "phrases")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    min_count: int = MIN_COUNT,
    inside_percent: int = INSIDE_PERCENT,
    top: int = TOP,
    **limits: int,
) -> DataFrame:
    """The best phrases of each language by their weakest cut.

    A phrase of a occurrences, cut into parts of l and r, scores floor(2000000 a / (l + r));
    its lowest-scoring cut counts, the earliest of equal ones. A phrase leaves if its words
    stand inside a longer one with ``inside_percent`` of its occurrences. Returns lang, rank,
    phrase, a, l, r, n (words of the language), score, first_doc_id and first_word.
    """
    counted = frequent_phrases(docs, longest, min_count, **limits)
    parts = counted.filter("size > 0").select("lang", "phrase", "f")
    candidates = counted.filter("size > 1").withColumnRenamed("f", "a")
    cut = candidates.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
    cut = stage(cut.withColumn("tail", F.expr("substring(phrase, length(head) + 2)")), "cuts")
    # A frequent word begins or ends very many phrases.
    headed = stage(join_many_to_one(cut, parts.toDF("lang", "head", "l"), ["lang", "head"], "inner"), "cuts")
    both = join_many_to_one(headed, parts.toDF("lang", "tail", "r"), ["lang", "tail"], "inner")
    wide = "decimal(20,0)"
    score = F.expr(f"cast(a as {wide}) * cast({SCALE} as decimal(8,0)) div (cast(l as {wide}) + cast(r as {wide}))")
    weakest = (
        both.withColumn("score", score)
        .groupBy("lang", "phrase")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1),"
        " s -> array_join(slice(split(phrase, ' '), s, m), ' '))))"
    )
    longer = (
        candidates.filter("size > 2")
        .select("lang", F.explode(inner).alias("phrase"), "a")
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("longer"))
    )
    held = F.col("longer").cast(wide) * 100 >= F.col("a").cast(wide) * inside_percent
    kept = (
        candidates.join(longer, ["lang", "phrase"], "left")
        .filter(F.col("longer").isNull() | ~held)
        .join(weakest, ["lang", "phrase"])
        .select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r", "first")
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    totals = counted.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score",
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.word").alias("first_word"),
    )
