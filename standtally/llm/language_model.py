"""A log-bilinear language model, trained with noise-contrastive estimation, and its scores.

Tokens are the words of a text, lower-cased in A-Z, and an end mark. The most frequent words
are classes of their own; all others share one. The model predicts a token's class from the
two tokens before it: each context word has a vector, scaled by its place, and their sum is
compared with a vector of each class. A word of the shared class then has its share of that
class, (c + 1) / (its tokens + its distinct words + 1), which leaves one part for an unseen
word, so that probabilities of all words sum to one.

Training goes over all training documents in every round. Each task starts from the same
parameters and follows its own rows in numpy, telling each token from noise drawn by class
frequency; parameters are then averaged by tokens, in two steps of bounded groups. Scores are
normalised: matrix products give the sum of weights over all classes for every context.

Counts of words cover all training documents. Up to ``KNOWN`` frequent words of at most
``WORD_BYTES`` bytes go to every task; all other words are looked up by a join, so vocabulary
is never cut. Missing and empty texts are one end mark. Repeated rows count and are scored
each. Rows without ``doc_id`` are never held out. With no training rows every word is unseen:
the base gives each token probability 1. Long texts are read in slices of a megabyte. An empty
table gives an empty result; further columns are ignored. Building the plan runs jobs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.llm.common import frugal, join_many_to_one
from standtally.sources.staging import stage

CLASSES = 1024
SIZE = 16
ROUNDS = 2
NOISE = 64
MINIBATCH = 1024
RATE = 0.1
KNOWN = 200_000
WORD_BYTES = 64
SLICE = 1 << 20
TOGETHER = 4 << 20
GATHERED = 1 << 16
COUNTED = 500_000
BLOCK = 4096
ROWS = 256
LEAST = 1e-200
SALTS = 32

END, OTHER = 0, 1
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _pieces(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, pa.Array, np.ndarray, bool, bool]]:
    """(first row, words, words a text, whether texts begin, whether texts end in this piece).

    A piece holds texts of ``most`` bytes together, or a slice of a longer text. Arrow splits
    and folds case as ASCII does; texts are not looked at beyond bytes.
    """
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        if ends[to - 1] - before <= max(most, SLICE):
            yield at, *_words(texts.slice(at, to - at)), True, True
        else:
            text = texts[at].as_py()
            first = 0
            while first < len(text):
                cut = first + SLICE
                if cut < len(text):
                    found = _SPACE.search(text, cut)
                    cut = found.start() if found else len(text)
                cut = min(cut, len(text))
                yield at, *_words(pa.array([text[first:cut]], pa.binary())), first == 0, cut == len(text)
                first = cut
        at = to


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, lower-cased in A-Z, and their number a text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.string())))
    words, bounds = lists.values, lists.offsets.to_numpy()
    # White space at either end of a text leaves an empty word there.
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)).view(pa.binary()), np.diff(before[bounds])


def _places(words: pa.Array, counts: np.ndarray, ends: bool, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of words in ``known``, then one for other words and one for end marks, and texts' bounds."""
    found = pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(counts + ends)])
    if not ends:
        return found.astype(np.int64), bounds
    places = np.full(bounds[-1], len(known) + 1, np.int64)
    inner = np.ones(len(places), bool)
    inner[bounds[1:] - 1] = False
    places[inner] = found
    return places, bounds


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all words of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0
        for batch in batches:
            for _, words, *_ in _pieces(batch.column(1)):
                counted = pc.value_counts(words)
                held.append(pa.table({"token": counted.field("values"), "n": counted.field("counts")}))
                n_held += len(counted)
                if n_held > COUNTED:
                    summed = _summed(held)
                    held, n_held = [summed], summed.num_rows
                    if n_held > COUNTED // 2:
                        yield from summed.to_batches()
                        held, n_held = [], 0
        if held:
            yield from _summed(held).to_batches()

    return docs.mapInArrow(frugal(run), "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _summed(counts: list[pa.Table]) -> pa.Table:
    """(token, n) with each token once."""
    summed = pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")])
    return summed.select(["token", "n_sum"]).rename_columns(["token", "n"]).combine_chunks()


class Model:
    """Parameters in one flat vector, with views on its parts."""

    def __init__(self, classes: int, size: int = SIZE, flat: np.ndarray | None = None) -> None:
        self.classes, self.size = classes, size
        shapes = [(classes + 1, size), (2, size), (classes, size), (classes,)]
        bounds = np.cumsum([0] + [int(np.prod(s)) for s in shapes])
        self.flat = np.zeros(bounds[-1], np.float32) if flat is None else flat.astype(np.float32)
        views = [self.flat[a:b].reshape(s) for a, b, s in zip(bounds, bounds[1:], shapes, strict=False)]
        # Context vectors (the last one stands before a text), their scale by place, class
        # vectors and class weights.
        self.context, self.place, self.target, self.bias = views

    @classmethod
    def first(cls, share: np.ndarray, size: int = SIZE) -> Model:
        """Class frequencies alone, as class vectors are zero."""
        model = cls(len(share), size)
        model.context[:] = np.random.default_rng(1).normal(0, 0.3, model.context.shape)
        model.place[:] = 1
        model.bias[:] = np.log(share)
        return model

    def predicted(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        return self.place[0] * self.context[c1] + self.place[1] * self.context[c2]


class Trainer:
    """Steps of noise-contrastive estimation with per-parameter rates.

    Steps write their large intermediate results into the same arrays each time, as fresh
    memory for them costs more than the arithmetic.
    """

    def __init__(self, model: Model, share: np.ndarray, seed: int) -> None:
        self.model, self.rng = model, np.random.default_rng(seed)
        self.cumulated = np.cumsum(share)
        self.offset = np.log(NOISE * share).astype(np.float32)
        self.squares = np.full(len(model.flat), 1.0, np.float32)
        self.slope = Model(model.classes, model.size)
        # Where a row's values are in a flat table.
        self.places = np.arange((model.classes + 1) * model.size).reshape(-1, model.size)
        rows = np.empty((6, MINIBATCH, model.size), np.float32)
        self.rows, self.false = rows, np.empty((MINIBATCH, NOISE), np.float32)
        self.change, self.root = np.empty_like(model.flat), np.empty_like(model.flat)

    def step(self, c1: np.ndarray, c2: np.ndarray, t: np.ndarray) -> None:
        m, g, n = self.model, self.slope, len(t)
        r1, r2, own, predicted, back, spare = self.rows[:, :n]
        noise = np.minimum(np.searchsorted(self.cumulated, self.rng.random(NOISE)), m.classes - 1)
        # Indices are in range; "clip" lets numpy write into ``out`` directly.
        np.take(m.context, c1, 0, r1, "clip")
        np.take(m.context, c2, 0, r2, "clip")
        np.take(m.target, t, 0, own, "clip")
        others = m.target[noise]
        np.multiply(m.place[0], r1, predicted)
        predicted += np.multiply(m.place[1], r2, spare)
        true = np.einsum("ij,ij->i", predicted, own) + m.bias[t] - self.offset[t]
        false = np.matmul(predicted, others.T, out=self.false[:n])
        false += m.bias[noise] - self.offset[noise]
        # Slopes of the log likelihood that true tokens are told from noise.
        up = _sigmoid(-true, true)[:, None]
        down = _sigmoid(false, false)
        np.negative(down, down)
        np.matmul(down, others, out=back)
        back += np.multiply(up, own, spare)
        g.target[:] = self._by_row(t, np.multiply(up, predicted, spare), m.classes)
        drawn = np.unique(noise)
        g.target[drawn] += self._by_row(noise, down.T @ predicted, m.classes)[drawn]
        g.bias[:] = np.bincount(t, up[:, 0], m.classes) + np.bincount(noise, down.sum(0), m.classes)
        g.context[:] = self._by_row(c1, np.multiply(back, m.place[0], spare), m.classes + 1)
        g.context += self._by_row(c2, np.multiply(back, m.place[1], spare), m.classes + 1)
        g.place[0] = np.einsum("ij,ij->j", back, r1)
        g.place[1] = np.einsum("ij,ij->j", back, r2)
        self.squares += np.multiply(g.flat, g.flat, self.root)
        np.multiply(RATE, g.flat, self.change)
        self.change /= np.sqrt(self.squares, self.root)
        m.flat += self.change

    def _by_row(self, rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """The sum of the values of each of ``n`` rows."""
        at = self.places.take(rows, 0)
        return np.bincount(at.ravel(), values.ravel(), n * values.shape[1]).reshape(n, -1)


def _sigmoid(x: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.clip(x, -30, 30, out=out)
    np.negative(out, out)
    np.exp(out, out)
    out += 1
    return np.divide(1, out, out)


def _contexts(ids: np.ndarray, before: tuple[int, int], bounds: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The last and the last but one class before each token of some texts.

    ``before`` precede the first text, and ``start`` any other.
    """
    both = np.concatenate([np.array(before, ids.dtype), ids])
    c1, c2 = both[1:-1].copy(), both[:-2].copy()
    starts, ends = bounds[1:-1], bounds[2:]
    c1[starts] = c2[starts] = start
    c2[(starts + 1)[starts + 1 < ends]] = start
    return c1, c2


def _train_round(docs: DataFrame, words: list[bytes], share: np.ndarray, flat: bytes, size: int, turn: int) -> bytes:
    """Parameters after each task went over its rows, averaged by tokens."""
    shared = docs.sparkSession.sparkContext.broadcast((words, share, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, share, flat = shared.value
        known = pa.array(words, pa.binary())
        class_of = np.append(np.arange(2, len(words) + 2), [OTHER, END])
        model = Model(len(share), size, np.frombuffer(flat, np.float32))
        trainer = Trainer(model, share, 1000 * turn + TaskContext.get().partitionId())
        start, seen, held, n_held = len(share), 0, [], 0

        def learn() -> None:
            c1, c2, t = (np.concatenate(x) for x in zip(*held, strict=True))
            for at in range(0, len(t), MINIBATCH):
                trainer.step(c1[at : at + MINIBATCH], c2[at : at + MINIBATCH], t[at : at + MINIBATCH])

        before = (start, start)
        for batch in batches:
            for _, words, counts, begins, ends in _pieces(batch.column(1)):
                places, bounds = _places(words, counts, ends, known)
                ids = class_of[places]
                both = _contexts(ids, (start, start) if begins else before, bounds, start)
                before = tuple(np.concatenate([before, ids])[-2:])
                at = 0
                while at < len(ids):
                    # Gathered tokens are learnt from where a text ends.
                    enough = bounds[np.searchsorted(bounds, at + GATHERED - n_held) :]
                    to = int(enough[0]) if len(enough) else len(ids)
                    held.append((both[0][at:to], both[1][at:to], ids[at:to]))
                    n_held += to - at
                    at = to
                    if n_held >= GATHERED:
                        learn()
                        seen, held, n_held = seen + n_held, [], 0
        if n_held:
            learn()
            seen += n_held
        if seen:
            blocks = range(0, len(model.flat), BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(blocks), pa.int64()),
                    pa.array([seen] * len(blocks), pa.int64()),
                    pa.array([model.flat[b : b + BLOCK].astype(np.float64).tobytes() for b in blocks], pa.binary()),
                ],
                names=["block", "tokens", "mean"],
            )

    def average(group):
        means = np.stack([np.frombuffer(m) for m in group["mean"]])
        tokens = group["tokens"].to_numpy()
        mean = (means * (tokens / tokens.sum())[:, None]).sum(0).tobytes()
        return group.iloc[:1][["block"]].assign(tokens=tokens.sum(), mean=mean)

    schema = "block bigint, tokens bigint, mean binary"
    # Groups hold a thirty-second of the tasks' blocks of 32 KB, and then 32 blocks.
    salted = docs.mapInArrow(frugal(run), schema).withColumn("salt", F.pmod(F.xxhash64("mean"), F.lit(SALTS)))
    once = salted.groupBy("block", "salt").applyInPandas(average, schema)
    rows = sorted(once.groupBy("block").applyInPandas(average, schema).collect())
    return b"".join(np.frombuffer(r["mean"]).astype(np.float32).tobytes() for r in rows)


class Scorer:
    """Normalised log probabilities of classes.

    A class' weight after two tokens is a product of one factor by the token before and one
    by the token before that. So the sums over classes of all pairs of tokens are one matrix
    product, taken in blocks of rows.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        target = model.target.T.astype(np.float64)
        near = (model.place[0] * model.context) @ target
        far = (model.place[1] * model.context) @ target + model.bias
        top_near, top_far = near.max(1), far.max(1)
        factor = np.exp(far - top_far[:, None]).T
        self.sums = np.empty((model.classes + 1, model.classes + 1), np.float32)
        for at in range(0, len(near), ROWS):
            few = slice(at, at + ROWS)
            summed = np.exp(near[few] - top_near[few, None]) @ factor
            # Where hardly a class is likely by both tokens, the weights are summed themselves.
            apart = np.argwhere(summed < LEAST)
            self.sums[few] = np.log(np.maximum(summed, LEAST)) + top_near[few, None] + top_far
            for c1, c2 in apart:
                self.sums[at + c1, c2] = np.logaddexp.reduce(near[at + c1] + far[c2])

    def log10(self, c1: np.ndarray, c2: np.ndarray, t: np.ndarray) -> np.ndarray:
        m, logs = self.model, np.empty(len(t))
        for at in range(0, len(t), GATHERED):
            few = slice(at, at + GATHERED)
            a, b, own = c1[few], c2[few], t[few]
            weight = np.einsum("ij,ij->i", m.predicted(a, b), m.target[own]) + m.bias[own]
            logs[few] = weight - self.sums[a, b]
        return logs / np.log(10)


def _sums(docs: DataFrame, shared, size: int) -> DataFrame:
    """Each document's sums over the words that every task knows, and its other words."""
    schema = (
        "part int, row bigint, doc_id bigint, n_tokens bigint, n_known bigint, n_other bigint, log_all double,"
        " log_other double, log_class double, rest array<struct<token: binary, times: bigint>>"
    )
    names = ["part", "row", "doc_id", "n_tokens", "n_known", "n_other", "log_all", "log_other", "log_class", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, n_end, classes, flat = shared.value
        known = pa.array(words, pa.binary())
        # Places of words, then one for words looked up later and one for the end mark.
        unknown, end = len(words), len(words) + 1
        logs = np.append(np.log10(counts + 1.0), [0, np.log10(n_end + 1.0)])
        is_known = np.append(np.ones(len(words), bool), [False, n_end > 0])
        class_of = np.full(len(words) + 2, OTHER, np.int64)
        class_of[: min(classes - 2, len(words))] = np.arange(2, 2 + min(classes - 2, len(words)))
        class_of[end] = END
        scorer = Scorer(Model(classes, size, np.frombuffer(flat, np.float32)))

        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                few = batch.slice(at, 1000)
                sums = np.zeros((few.num_rows, 6))
                rest = [Counter() for _ in range(few.num_rows)]
                before = (classes, classes)
                for first, words, counts, begins, ends in _pieces(few.column(1), TOGETHER):
                    place, limits = _places(words, counts, ends, known)
                    if not len(place):
                        continue
                    ids = class_of[place]
                    c1, c2 = _contexts(ids, (classes, classes) if begins else before, limits, classes)
                    before = tuple(np.concatenate([before, ids])[-2:])
                    other, log = ids == OTHER, logs[place]
                    numbers = [np.ones(len(ids)), is_known[place], other, log, log * other, scorer.log10(c1, c2, ids)]
                    # Texts that end have one token at least; others come alone in their piece.
                    sums[first : first + len(counts)] += np.stack(
                        [np.add.reduceat(x, limits[:-1], dtype=np.float64) for x in numbers], 1
                    )
                    apart = np.flatnonzero(place == unknown)
                    owners = np.searchsorted(limits, apart, "right") - 1
                    # Without the end marks of the texts before, places number the words.
                    tokens = words.take(pa.array(apart - owners * ends)).to_pylist()
                    for i, token in zip((first + owners).tolist(), tokens, strict=True):
                        rest[i][token] += 1
                found = [token for c in rest for token in c]
                times = [n for c in rest for n in c.values()]
                bounds = np.cumsum([0] + [len(c) for c in rest])
                rows = np.arange(row, row + len(sums))
                row += len(sums)
                columns = [pa.array(np.full(len(sums), part), pa.int32()), pa.array(rows, pa.int64()), few.column(0)]
                columns += [pa.array(c.astype(np.int64), pa.int64()) for c in sums.T[:3]]
                columns += [pa.array(c, pa.float64()) for c in sums.T[3:]]
                pairs = pa.StructArray.from_arrays(
                    [pa.array(found, pa.binary()), pa.array(times, pa.int64())], names=["token", "times"]
                )
                columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return stage(docs.mapInArrow(frugal(run), schema), "sums")


def score_documents(
    docs: DataFrame, classes: int = CLASSES, size: int = SIZE, rounds: int = ROUNDS, known: int = KNOWN
) -> DataFrame:
    """Base and model log10 probabilities of all texts (doc_id, text), learnt from those not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. The words
    known to each task are the ``known`` most frequent, ties by bytes.
    """
    spark = docs.sparkSession
    read = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    training = read.filter(~held_out(F.col("doc_id")))
    counts = stage(word_counts(training), "words")
    n_end = training.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = n_words + n_end, n_distinct + (n_end > 0)
    # At most KNOWN rows of at most WORD_BYTES bytes and a number.
    short = counts.filter(F.octet_length("token") <= WORD_BYTES).orderBy(F.desc("n"), "token").limit(known).toArrow()
    words, numbers = short.column("token").to_pylist(), short.column("n").to_numpy()
    classes = min(classes, len(words) + 2)
    own = numbers[: classes - 2].astype(np.float64)
    other_tokens, other_distinct = n_words - int(own.sum()), n_distinct - len(own)
    share = np.concatenate([[n_end, other_tokens], own]) + 1.0
    share /= share.sum()
    flat = Model.first(share, size).flat.tobytes()
    for turn in range(rounds if total else 0):
        flat = _train_round(training, words[: classes - 2], share, flat, size, turn)

    shared = spark.sparkContext.broadcast((words, numbers, n_end, classes, flat))
    sums = _sums(read, shared, size)
    rest = sums.select("part", "row", F.inline("rest"))
    found = join_many_to_one(rest, counts, ["token"])
    # Decimals, so that the order of rows does not show in the sum.
    log = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)).cast("decimal(20,17)") * F.col("times").cast("decimal(18,0)")
    looked_up = found.groupBy("part", "row").agg(
        F.sum(log).cast("double").alias("log_rest"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known_rest"),
    )
    zero = F.lit(0.0)
    log_rest = F.coalesce("log_rest", zero)
    return sums.drop("rest").join(looked_up, ["part", "row"], "left").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("log_all") + log_rest - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (
            F.col("log_class") + F.col("log_other") + log_rest
            - F.col("n_other") * float(np.log10(other_tokens + other_distinct + 1))
        ).alias("score"),
    )
