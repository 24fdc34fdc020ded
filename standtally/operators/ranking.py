"""Consecutive numbers for ordered keys without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.functions.semantics import text_or_na
from standtally.operators.skew import hot_values, join_spread
from standtally.sources.staging import broadcast_if_small, stage

# monotonically_increasing_id keeps the row position inside a partition in its low bits.
POSITION_BITS = 33

# Fewer keys than this are not worth another range.
KEYS_PER_RANGE = 100_000


def dense_rank_keys(
    keys: DataFrame, within: Sequence[str], order: str, out: str, partitions: int | None = None
) -> DataFrame:
    """Distinct keys with their dense rank under ``order`` inside each ``within`` group.

    A window would sort each group in one task, and a group may hold a third of all
    keys. Here the distinct keys are range-partitioned over all tasks and staged, so
    that the ranges are settled; a key's global position is then its position in its
    range plus the sizes of the ranges before it, and its rank is that position less
    the first position of its group.
    """
    spark = keys.sparkSession
    columns = [*within, order]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = partitions or max(1, min(most, keys.count() // KEYS_PER_RANGE))
    row_id = F.monotonically_increasing_id()
    ranged = stage(
        keys.select(*columns)
        .distinct()
        .repartitionByRange(n, *columns)
        .sortWithinPartitions(*columns)
        .select(
            *columns,
            F.shiftright(row_id, POSITION_BITS).alias("_range"),
            row_id.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).alias("_position"),
        ),
        "ranked-keys",
    )
    # One row per range: its number is bounded by the partition count, not by the data.
    sizes = sorted((r["_range"], r["count"]) for r in ranged.groupBy("_range").count().collect())
    starts, total = [], 0
    for number, size in sizes:
        starts.append((number, total))
        total += size
    start_of = spark.createDataFrame(starts, "_range bigint, _before bigint")
    placed = ranged.join(F.broadcast(start_of), "_range").withColumn(
        "_global", F.col("_before") + F.col("_position")
    )
    if not within:
        return placed.select(order, (F.col("_global") + 1).alias(out))
    firsts = placed.groupBy(*within).agg(F.min("_global").alias("_first"))
    group = firsts.toDF(*[f"_{c}" for c in within], "_first")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within]
    return placed.join(broadcast_if_small(group), same).select(
        *columns, (F.col("_global") - F.col("_first") + 1).alias(out)
    )


def number_plots(
    df: DataFrame, key: str, collection: str, within: str | None, out: str = "plot_code"
) -> DataFrame:
    """Add ``<collection>_PL0001`` codes, ranking plots inside ``within`` or over all.

    The plot-level input is staged, as both the key ranking and the result read it. Ranks
    come back by the key alone, with one row per key that holds its rank in each group, so
    rows that are then joined or grouped by the key do not move again.
    """
    tagged = stage(df.withColumn("_group", text_or_na(within)) if within else df, "numbered")
    groups = ["_group"] if within else []
    ranks = dense_rank_keys(tagged.filter(F.col(key).isNotNull()), groups, key, "_rank")
    code = F.concat_ws("_", text_or_na(collection), F.format_string("PL%04d", F.col("_rank")))
    if within:
        held = F.map_from_entries(F.collect_list(F.struct("_group", "_rank"))).alias("_ranks")
        ranks = ranks.groupBy(key).agg(held)
    found = join_spread(tagged, ranks, key, hot_values(tagged, key))
    if within:
        found = found.withColumn("_rank", F.col("_ranks")[F.col("_group")])
    coded = found.withColumn(out, code)
    return coded.select(*[c for c in df.columns if c != out], out)
