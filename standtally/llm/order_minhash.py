"""Document fingerprints by Order MinHash, sensitive to edit distance.

Every k-mer of a text (``k`` words in a row) is numbered by its occurrence, so that repeated
k-mers stay apart, and hashed. One entry of the fingerprint takes the ``ell`` k-mers that are
minimal under its own order of hash values, puts them back in the order of the text and
hashes the tuple. Two texts agree in an entry if they chose the same k-mers in the same
order, so moving passages counts as a change, unlike in a plain MinHash.

The ``m`` orders are the hash order read from ``m`` evenly spaced points of the hash circle.
Each is a uniformly random order, so the share of equal entries has the same mean as with
independent ones, and one sort of the text's k-mers serves them all.

All of it is built-in expressions: no Python runs on the executors. Missing texts count as
empty; an empty text has a fingerprint of its own, equal to that of any other empty text.
Texts with fewer than ``k`` words have one k-mer. Scripts without blanks are cut at every
character. Rows with equal doc_id are ordered by their text; rows without doc_id come last.
An empty table gives an empty result, and a single row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standtally.llm.common import let, shuffle_partitions, text_or_empty
from standtally.sources.staging import stage

K = 3
ELL = 2
ENTRIES = 64

# The low bits of a packed k-mer hold its position, the rest a part of its hash. A text has
# at most 2**26 - 2 words, far more than fit into one row.
POSITION_BITS = 26
LOW = (1 << POSITION_BITS) - 1
# Blanks part words, and every character of scripts written without blanks is a word.
PARTS = r"[\x20\x09-\x0D]+|(?<=[⺀-鿿豈-﫿])"


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW))


def _high(x: Column) -> Column:
    return x.bitwiseAND(F.lit(~LOW))


def _upto(n: Column) -> Column:
    """0 .. n-1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def kmer_hashes(text: Column, k: int) -> Column:
    """Hashes of the k-mers of a text, in order."""
    words = F.filter(F.split(text, PARTS), lambda w: w != "")

    def rows(h: Column) -> Column:
        n = F.size(h)
        count = F.when(n == 0, 0).otherwise(F.greatest(n - (k - 1), F.lit(1)))
        return F.transform(_upto(count), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))

    return let(F.transform(words, lambda w: F.xxhash64(w)), rows)


def numbered(kmers: Column) -> Column:
    """Packed (hash of k-mer and occurrence, position), in no order.

    After sorting by hash and position, equal k-mers stand together in the order of the
    text, and a k-mer's occurrence is its place in its group.
    """
    packed = F.sort_array(F.transform(kmers, lambda h, i: _high(h).bitwiseOR(i.cast("bigint"))))

    def with_starts(p: Column) -> Column:
        n = F.size(p)
        starts = F.filter(
            _upto(n), lambda j: (j == 0) | (_high(F.get(p, j)) != _high(F.get(p, F.greatest(j - 1, F.lit(0)))))
        )

        def number(s: Column) -> Column:
            return F.flatten(
                F.transform(
                    s,
                    lambda start, g: F.transform(
                        _upto(F.coalesce(F.get(s, g + 1), n) - start),
                        lambda o: _high(F.xxhash64(_high(F.get(p, start)), o)).bitwiseOR(_low(F.get(p, start + o))),
                    ),
                )
            )

        return let(starts, number)

    return let(packed, with_starts)


def order_minhash(text: Column, k: int = K, ell: int = ELL, entries: int = ENTRIES) -> Column:
    """The fingerprint as an array of ``entries`` 32-bit numbers."""
    step = (1 << 64) // entries
    marks = F.array(*[F.lit(_high_int(-(1 << 63) + t * step) | LOW) for t in range(entries)])

    def of_kmers(kmers: Column) -> Column:
        def of_sorted(ring: Column) -> Column:
            # Each mark stands before the k-mers that come next on the circle.
            at = F.filter(_upto(F.size(ring)), lambda j: _low(F.get(ring, j)) == LOW)
            packed = F.filter(ring, lambda x: _low(x) != LOW)

            def entry_list(found: Column) -> Column:
                def choose(p: Column) -> Column:
                    n = F.size(p)

                    def tuple_hash(j: Column, t: Column) -> Column:
                        chosen = F.transform(
                            _upto(F.least(F.lit(ell), n)),
                            lambda i: _low(F.get(p, (j - t + i) % n)).cast("int"),
                        )
                        ordered = F.transform(F.array_sort(chosen), lambda q: F.get(kmers, q))
                        return F.shiftright(F.xxhash64(ordered), 32).cast("int")

                    return F.transform(found, tuple_hash)

                return let(packed, choose)

            return let(at, entry_list)

        return let(F.sort_array(F.concat(numbered(kmers), marks)), of_sorted)

    return let(kmer_hashes(text, k), of_kmers)


def _high_int(x: int) -> int:
    return x & ~LOW


def likeness(a: Column, b: Column, entries: int = ENTRIES) -> Column:
    """The share of equal entries."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(entries))


def as_text(fingerprint: Column) -> Column:
    """Eight hexadecimal digits per entry."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def _search(bounds: Column, value: Column) -> Column:
    """How many of the ascending bounds are smaller than the value, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(bounds) + F.lit(1))).cast("int"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        smaller = F.coalesce(F.get(bounds, middle) < value, F.lit(False)) & (state["low"] < state["high"])
        return F.struct(
            F.when(smaller, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(smaller | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    return F.aggregate(steps, start, halve, lambda state: state["low"])


def with_next(docs: DataFrame, columns: list[str], ranges: int | None = None) -> DataFrame:
    """Rows of ``docs`` (doc_id and others) with a struct ``next`` of ``columns``.

    The next row is the one after it in descending order of doc_id; the last row's is the
    first. A window over all rows would put them into one task, so the numbers are cut into
    ranges of about equal count (a pass over the numbers alone), every range is ordered by a
    task of its own, and the first row of a range is sent to the range before it as well.
    What reaches the driver is one pair of numbers per range, and the number of ranges is a
    setting. A window is ordered once, and the rows move once.
    """
    spark = docs.sparkSession
    ranges = ranges or 4 * shuffle_partitions(spark)
    numbers = docs.select("doc_id").filter("doc_id is not null").repartitionByRange(ranges, "doc_id")
    ends = stage(numbers.groupBy(F.spark_partition_id().alias("_part")).agg(F.max("doc_id").alias("_end")), "ranges")
    bounds = ends.agg(F.array_sort(F.collect_set("_end")).alias("_ends"))
    last = F.size("_ends") - 1
    bucket = F.greatest(
        F.lit(0), F.least(_search(F.col("_ends"), F.coalesce("doc_id", F.lit(-(1 << 63)))), last)
    )
    placed = docs.crossJoin(F.broadcast(bounds)).withColumn("_bucket", bucket)
    first = F.col("doc_id").eqNullSafe(F.get("_ends", F.col("_bucket")))
    before = F.when(F.col("_bucket") >= last, 0).otherwise(F.col("_bucket") + 1)
    here = F.struct(F.col("_bucket").alias("at"), F.lit(False).alias("sent"))
    there = F.struct(before.alias("at"), F.lit(True).alias("sent"))
    copied = placed.withColumn("_to", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here)))).select(
        *docs.columns, F.col("_to.at").alias("_at"), F.col("_to.sent").alias("_sent")
    )
    ties = [F.xxhash64(*[F.col(c) for c in columns]), *[F.col(c) for c in columns]]
    order = Window.partitionBy("_at").orderBy("_sent", F.col("doc_id").desc_nulls_last(), *ties)
    following = F.lead(F.struct(*columns)).over(order)
    return copied.withColumn("next", following).filter(~F.col("_sent")).drop("_at", "_sent")


def fingerprint_documents(
    docs: DataFrame, k: int = K, ell: int = ELL, entries: int = ENTRIES, ranges: int | None = None
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, its edited text and that one's.

    The edited text ends in the beginning of the next document, in place of its own last
    third. ``near_edited`` and ``near_next`` hold the likeness to the edited text and to
    the next document.
    """
    own = docs.select(F.col("doc_id"), text_or_empty().alias("text")).withColumn(
        "sketch", order_minhash(F.col("text"), k, ell, entries)
    )
    paired = with_next(own, ["text", "sketch"], ranges)
    n = F.length("text").cast("bigint")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(
        F.substr("text", F.lit(1), (n - third).cast("int")), F.substr(F.col("next.text"), F.lit(1), third)
    )
    edited_sketch = order_minhash(F.col("edited"), k, ell, entries)
    return (
        paired.withColumn("n_chars", n)
        .withColumn("edited", edited)
        .withColumn("edited_sketch", edited_sketch)
        .select(
            "doc_id",
            "n_chars",
            "edited",
            as_text(F.col("sketch")).alias("fingerprint"),
            as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
            likeness(F.col("sketch"), F.col("edited_sketch"), entries).alias("near_edited"),
            likeness(F.col("sketch"), F.col("next.sketch"), entries).alias("near_next"),
        )
    )
