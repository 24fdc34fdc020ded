"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Every source has a weight and may be repeated at most ``max_epochs`` times. The water
level is raised until the targets, clamped at their caps, add up to the asked total; the
excess of a clamped source goes to the others by weight. A source is then repeated whole as
often as its target holds it, and the rest of the target is filled from its documents in a
seeded random order.

Missing texts have size 0. A missing source is a source of its own, last in the order.
Repeated rows are mixed like any others, each counting for itself; an empty table gives an
empty result. A source without a single word has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from standtally.llm.common import WORDS, text_or_empty, unit_interval
from standtally.operators.ranking import dense_rank_keys
from standtally.sources.staging import broadcast_if_small, stage

# Documents of a source that are put in order by one task, at the least.
BUCKET_ROWS = 2048
BLANKS_AND_WORD = r"[\x20\x09-\x0D]*" + WORDS


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORDS)).cast("long")


def source_sizes(sized: DataFrame, cycle: tuple[int, ...]) -> DataFrame:
    """Per source: rows, words and weight; the weights repeat along the sources in order.

    One row per source is staged. Sources are numbered by ranges, so that a corpus with
    millions of them doesn't pass through one task.
    """
    sources = stage(
        sized.groupBy("_source").agg(
            F.sum("_size").alias("_source_size"), F.count("*").alias("_rows")
        ),
        "mix-sources",
    )
    named = sources.filter(F.col("_source").isNotNull())
    ranks = dense_rank_keys(named, [], "_source", "_rank")
    last = named.agg((F.count("*") + 1).alias("_last"))
    weights = F.element_at(
        F.array(*map(F.lit, cycle)),
        ((F.col("_rank") - 1) % len(cycle) + 1).cast("int"),
    )
    return (
        sources.join(ranks, "_source", "left")
        .join(F.broadcast(last))
        .withColumn("_rank", F.coalesce("_rank", "_last"))
        .drop("_last")
        .withColumn("_weight", weights.cast("double"))
    )


def water_fill(sources: DataFrame, max_epochs: int, share: float = 1.0) -> DataFrame:
    """Add ``_target``: at most ``max_epochs`` times the size, else in proportion to weight.

    Only sums over all sources reach the driver. Each round clamps the sources that the
    level has passed and raises the level for the rest; it ends when none is passed anew.
    """
    size = F.col("_source_size").cast("double")
    cap = size * max_epochs
    total, weight = sources.agg(F.sum(size), F.sum("_weight")).first()
    total = (total or 0.0) * share
    level = total / weight if weight else 0.0
    clamped_before = -1
    while True:
        passed = cap <= F.col("_weight") * F.lit(level)
        clamped, used, free = sources.agg(
            F.count_if(passed), F.sum(F.when(passed, cap)), F.sum(F.when(~passed, F.col("_weight")))
        ).first()
        if not free or clamped == clamped_before:
            break
        clamped_before = clamped
        level = max(level, (total - (used or 0.0)) / free)
    return sources.withColumn("_target", F.least(cap, F.col("_weight") * F.lit(level)))


def mix(
    docs: DataFrame,
    seed: int = 17,
    cycle: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = 3,
    share: float = 1.0,
) -> DataFrame:
    """All rows and columns of ``docs`` with a struct ``mix``.

    Its fields: ``size`` (words of the text), ``source_size``, ``target`` (words the mix
    wants of the source), ``whole`` (repetitions of every document of the source) and
    ``extra`` (further words of this document). Documents take their extra words in a
    random order until the target is reached; the one that would pass it gives only the
    words that are missing. So a source misses its target by less than a word, and no
    document exceeds ``max_epochs`` times its size.

    A large source is cut into hash buckets. A bucket learns how many words come before it
    from the sums of all buckets, so no task orders more than a bucket.
    """
    given = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in given])
    sized = docs.select(
        row.alias("_doc"),
        F.col("source").alias("_source"),
        word_count(text_or_empty()).alias("_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("_order"),
    )
    targets = stage(
        water_fill(stage(source_sizes(sized, cycle), "mix-weights"), max_epochs, share), "mix-targets"
    )
    rows_in_bucket = F.greatest(F.lit(float(BUCKET_ROWS)), F.sqrt("_rows"))
    plan = targets.select(
        F.col("_source").alias("_key"),
        "_rank",
        "_source_size",
        "_target",
        F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size")))
        .otherwise(0)
        .cast("long")
        .alias("_whole"),
        F.ceil(F.col("_rows") / rows_in_bucket).alias("_buckets"),
    )
    placed = sized.join(
        broadcast_if_small(plan), F.col("_source").eqNullSafe(F.col("_key"))
    ).withColumn("_bucket", F.floor(unit_interval(F.col("_order")) * F.col("_buckets")))
    before = Window.partitionBy("_rank").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        placed.groupBy("_rank", "_bucket")
        .agg(F.sum("_size").alias("_words"))
        .select(
            "_rank", "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start")
        )
    )
    inside = (
        Window.partitionBy("_rank", "_bucket")
        .orderBy("_order", F.col("_doc.doc_id"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    wanted = F.round("_target").cast("long") - F.col("_whole") * F.col("_source_size")
    left = wanted - F.col("_start") - F.coalesce(F.sum("_size").over(inside), F.lit(0))
    mixed = placed.join(starts, ["_rank", "_bucket"]).withColumn(
        "_extra", F.greatest(F.lit(0), F.least(F.col("_size"), left))
    )
    return mixed.select(
        *[F.col("_doc")[c].alias(c) for c in given if c != "mix"],
        F.struct(
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            F.col("_whole").alias("whole"),
            F.col("_extra").alias("extra"),
        ).alias("mix"),
    )


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with.

    A document taken for part of a repetition ends after the words it gives; there is at
    most one such row per source.
    """
    columns = [c for c in mixed.columns if c != "mix"]
    m = F.col("mix")
    part = (m["extra"] > 0) & (m["extra"] < m["size"])
    whole = m["whole"].cast("int") + ((m["size"] > 0) & (m["extra"] == m["size"])).cast("int")
    parts = F.when(part, F.array(F.lit(True))).otherwise(F.array().cast("array<boolean>"))
    words = F.regexp_extract_all("text", F.lit(BLANKS_AND_WORD), F.lit(0))
    text = F.when(
        F.col("_part"), F.array_join(F.slice(words, F.lit(1), m["extra"].cast("int")), "")
    ).otherwise(F.col("text"))
    repeated = mixed.withColumn("_part", F.explode(F.concat(F.array_repeat(F.lit(False), whole), parts)))
    return repeated.withColumn("text", text).select(*[f"`{c}`" for c in columns])
