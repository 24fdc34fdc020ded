"""Distinct texts and counts per group, kept or spread back over the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions.semantics import count_distinct_na, text_or_na
from standtally.operators.skew import join_unique
from standtally.sources.staging import stage


def distinct_concat(c: str | Column, sep: str = ";", keep_na: bool = True) -> Column:
    """Aggregate: sorted distinct values joined by ``sep``; missing ones print as ``NA``."""
    source = F.col(c) if isinstance(c, str) else c
    value = text_or_na(source) if keep_na else source.cast("string")
    return F.array_join(F.array_sort(F.collect_set(value)), sep)


def join_back(df: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """Left join of one row per key, matching missing keys, onto every row.

    The key side is unique, so a hot key is only a skewed left partition, which
    adaptive execution can split.
    """
    side = per_key.withColumnRenamed(key, "_back_key")
    return df.join(side, F.col(key).eqNullSafe(F.col("_back_key")), "left").drop("_back_key")


def windowed_distinct_count(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct values of ``value`` per ``key`` on every row, a missing one counting once."""
    counts = df.groupBy(key).agg(count_distinct_na(value).alias(out))
    return join_back(df, counts, key)


def group_concat_broadcast(
    df: DataFrame, key: str, columns: dict[str, str], sep: str = "/"
) -> DataFrame:
    """Per key, the sorted distinct non-missing values of each column on every row.

    The rows are stored once, as they may be the result of a long plan. Values fold to
    distinct ones on the map side, each column apart, so a key's text is bounded by its
    distinct values; rows of hot keys meet their texts by broadcast. Runs jobs.
    """
    whole = stage(df, "grouped")
    places = range(len(columns))
    values = F.array(
        *[
            F.struct(F.lit(i).alias("_place"), F.col(c).cast("string").alias("_value"))
            for i, c in zip(places, columns, strict=True)
        ]
    )
    distinct = whole.select(key, F.inline(values)).distinct()
    texts = distinct.groupBy(key).agg(
        *[
            distinct_concat(F.when(F.col("_place") == i, F.col("_value")), sep, keep_na=False).alias(out)
            for i, out in zip(places, columns.values(), strict=True)
        ]
    )
    return join_unique(whole, texts, [key])


def row_checks(stages: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Rows, missing keys and distinct keys of each named table."""
    reports = [
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col(key).isNull()).alias("null_keys"),
            F.count_distinct(key).alias("distinct_keys"),
        ).select(F.lit(name).alias("stage"), "rows", "null_keys", "distinct_keys")
        for name, df, key in stages
    ]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out
