"""Quality classifier: histogram gradient-boosted trees over statistics of the text.

The trees learn from a bounded sample of labelled rows and are flattened into arrays, so
that numpy moves all texts of a batch down a tree level by level. Labels, language, source
and number of a document are no inputs.

Missing texts count as empty; an empty text is scored from its statistics like any other.
Labels that are missing or belong to no document are left out, and several labels of one
document count as their majority. Without labels of both kinds the score is the share of
good labels, or 1 if there are none, so nothing is rejected unseen. Repeated rows get the
same score each; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.llm.common import frugal

THRESHOLD = 0.7
# Labelled rows to learn from, at the most (a sample by hash of the number beyond that).
TRAIN_ROWS = 40_000

FEATURES = (
    "log_bytes log_words mean_word sd_word distinct_words top_word top_pair repeats"
    " log_lines mean_line distinct_lines short_lines upper digit symbol stars bangs bars"
    " commas stops blank high squeeze ended_words shouted_words marked_words long_words mid_caps"
).split()

_UPPER = np.zeros(256)
_UPPER[65:91] = 1
_CLASSES = np.zeros((256, 9))
_CLASSES[65:91, 0] = 1
_CLASSES[48:58, 1] = 1
for _b in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)):
    _CLASSES[_b, 2] = 1
for _b in b"*#%&$@^~_=+<>{}[]\\":
    _CLASSES[_b, 3] = 1
for _b in b"!?":
    _CLASSES[_b, 4] = 1
_CLASSES[ord("|"), 5] = 1
_CLASSES[ord(","), 6] = 1
_CLASSES[ord("."), 7] = 1
for _b in b" \t\n\r\x0b\x0c":
    _CLASSES[_b, 8] = 1


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    histogram = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = (histogram @ _CLASSES) / max(n, 1)
    words = text.split()
    m = len(words)
    lines = text.split("\n")
    if m:
        sizes = np.fromiter(map(len, words), np.int64, m)
        counts = Counter(words)
        top = max(counts.values()) / m
        pairs = Counter(zip(words, words[1:], strict=False))
        top_pair = max(pairs.values()) / (m - 1) if m > 1 else 0.0
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
        mean, sd = float(sizes.mean()), float(sizes.std())
        distinct = len(counts) / m
        ended = sum(c for w, c in counts.items() if w[-1] in ".,;:") / m
        shouted = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / m
        marked = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:'\")") / m
        long_words = float((sizes > 24).mean())
        mid_caps = sum(c for w, c in counts.items() if w[1:] != w[1:].lower()) / m
    else:
        top = top_pair = repeats = mean = sd = distinct = 0.0
        ended = shouted = marked = long_words = mid_caps = 0.0
    return [
        float(np.log1p(n)),
        float(np.log1p(m)),
        mean,
        sd,
        distinct,
        top,
        top_pair,
        repeats,
        float(np.log1p(len(lines))),
        float(np.log1p(n / len(lines))),
        len(set(lines)) / len(lines),
        sum(len(x) < 20 for x in lines) / len(lines),
        *(float(shares[i]) for i in range(9)),
        float(histogram[128:].sum()) / max(n, 1),
        len(zlib.compress(data, 1)) / max(n, 1),
        ended,
        shouted,
        marked,
        long_words,
        mid_caps,
    ]


def matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Trees:
    """All trees end to end: a node's children, feature and threshold, or its value.

    ``left`` of a leaf is the leaf itself and its threshold is infinite, so that a row that
    has arrived stays where it is.
    """

    base: float
    depth: int
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = self.left[node] + (x[rows, self.feature[node]] > self.threshold[node])
            raw += self.value[node]
        return 1.0 / (1.0 + np.exp(-raw))


def constant(share: float) -> Trees:
    odds = np.inf if share >= 1 else -np.inf if share <= 0 else float(np.log(share / (1 - share)))
    none = np.zeros(0, np.int64)
    return Trees(odds, 0, none, none, none.astype(float), none, none.astype(float))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    trees: int = 120,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    least_weight: float = 2.0,
    ridge: float = 1.0,
) -> Trees:
    """Boosted trees on the logistic loss; splits are sought over histograms of binned features."""
    if len(y) == 0:
        return constant(1.0)
    share = float(y.mean())
    if share in (0.0, 1.0):
        return constant(share)
    n, d = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(d)], 1)
    base = float(np.log(share / (1 - share)))
    raw = np.full(n, base)
    roots, feature, threshold, left, value = [], [], [], [], []

    def node() -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        value.append(0.0)
        return len(left) - 1

    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-raw))
        gradient, weight = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(node())
        at = np.full(n, roots[-1])
        level = [roots[-1]]
        for deep in range(depth + 1):
            base_node = level[0]
            local = at - base_node
            live = (local >= 0) & (local < len(level))
            g_node = np.bincount(local[live], gradient[live], len(level))
            h_node = np.bincount(local[live], weight[live], len(level))
            for k, i in enumerate(level):
                value[i] = rate * g_node[k] / (h_node[k] + ridge)
            if deep == depth:
                break
            best = np.full(len(level), 1e-6)
            choice = [None] * len(level)
            for j in range(d):
                if not len(cuts[j]):
                    continue
                key = local[live] * bins + binned[live, j]
                g = np.bincount(key, gradient[live], len(level) * bins).reshape(-1, bins).cumsum(1)
                h = np.bincount(key, weight[live], len(level) * bins).reshape(-1, bins).cumsum(1)
                g, h = g[:, : len(cuts[j])], h[:, : len(cuts[j])]
                gr, hr = g_node[:, None] - g, h_node[:, None] - h
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - (g_node**2 / (h_node + ridge))[:, None]
                gain[(h < least_weight) | (hr < least_weight)] = -1
                where = gain.argmax(1)
                for k in range(len(level)):
                    if gain[k, where[k]] > best[k]:
                        best[k] = gain[k, where[k]]
                        choice[k] = (j, int(where[k]))
            following = []
            for k, i in enumerate(level):
                if choice[k] is None:
                    continue
                j, b = choice[k]
                a, c = node(), node()
                feature[i], threshold[i], left[i] = j, float(cuts[j][b]), a
                mine = at == i
                at[mine] = np.where(binned[mine, j] > b, c, a)
                following += [a, c]
            if not following:
                break
            level = following
        raw += np.array(value)[at]
    return Trees(
        base, depth, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(value)
    )


def held_out(doc_id: Column) -> Column:
    """Rows kept for measuring: the CRC-32 of the number as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Trees:
    """Trees from at most about ``max_rows`` labelled rows that aren't held out.

    The sampled labels are a table of known bound, so it is broadcast, and only their
    documents' statistics reach the driver: ``max_rows`` rows of numbers.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    )
    n = known.count()
    share = min(1.0, max_rows / max(n, 1))
    bucket = F.pmod(F.xxhash64(F.lit("train"), F.col("doc_id")), F.lit(1_000_000))
    sample = known.filter(bucket < int(share * 1_000_000))

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([row.tobytes() for row in x], pa.binary())], names=["label", "x"]
            )

    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(sample), "doc_id")
        .select(F.col("_label").alias("label"), "text")
        .mapInArrow(frugal(numbers), "label double, x binary")
        .toArrow()
    )
    if not len(rows):
        return constant(1.0)
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, len(FEATURES))
    y = rows["label"].to_numpy()
    order = np.lexsort((*x.T[::-1], y))  # the order of arrival varies between runs
    return fit(x[order], y[order])


def score_quality(docs: DataFrame, model: Trees, out: str = "score") -> DataFrame:
    """All rows and columns of ``docs`` and their score; one pass without a shuffle.

    A column of that name is replaced.
    """
    kept = docs.select(*[f"`{c}`" for c in docs.columns if c != out])
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                few = batch.slice(start, 500)
                score = model.score(matrix(few.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*few.columns, pa.array(score, pa.float64())], names=[*few.schema.names, out]
                )

    from pyspark.sql import types as T

    return kept.mapInArrow(frugal(run), T.StructType([*kept.schema.fields, T.StructField(out, T.DoubleType())]))
