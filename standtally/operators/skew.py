"""Joins that no hot key can send to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.sources.staging import stage

# A key is hot if it holds more than this share of the rows, so fewer than 1/share are.
HOT_SHARE = 0.001

# Rows that tell which values are hot; a value of the share above has some 200 of them.
HOT_ROWS = 200_000


def hot_values(df: DataFrame, column: str) -> list[str]:
    """Values that hold more than ``HOT_SHARE`` of the rows, as told by ``HOT_ROWS`` of them.

    They only decide how rows travel, never which rows a join finds. Runs jobs.
    """
    rows = df.count()
    # Up to that many rows no task is long.
    if rows <= HOT_ROWS:
        return []
    picked = df.select(column).filter(F.col(column).isNotNull()).sample(HOT_ROWS / rows, seed=1)
    counts = picked.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.filter(F.col("_rows") > int(HOT_ROWS * HOT_SHARE)).select(column)
    return sorted(r[0] for r in found.collect())


def join_spread(
    many: DataFrame, one: DataFrame, key: str, hot: list[str], merge: bool = False
) -> DataFrame:
    """Left join of a table with one row per key on that key alone, so that rows shuffle by it
    once and stay so. Rows of the ``hot`` keys do not: they meet the rows of their keys by
    broadcast. A missing key finds none. ``merge`` keeps ``one`` from being broadcast whole.
    """
    side = one.withColumnRenamed(key, "_one")
    on = F.col(key) == F.col("_one")
    whole = side.hint("merge") if merge else side
    if not hot:
        return many.join(whole, on, "left").drop("_one")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    few = F.broadcast(side.filter(F.col("_one").isin(hot)))
    spread = many.filter(is_hot).join(few, on, "left").drop("_one")
    return many.filter(~is_hot).join(whole, on, "left").drop("_one").unionByName(spread)


def hot_keys(many: DataFrame, keys: list[str]) -> tuple[DataFrame | None, set[str]]:
    """The keys that hold more than ``HOT_SHARE`` of the rows, stored, or None without any, as
    ``_one_<key>``; and which of the key columns have missing values. Runs jobs."""
    missing = [F.count_if(F.col(k).isNull()) for k in keys]
    rows, *absent = many.agg(F.count(F.lit(1)), *missing).first()
    hot = stage(
        many.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > int(rows * HOT_SHARE) + 1)
        .select(*[F.col(k).alias(f"_one_{k}") for k in keys]),
        "hot-keys",
    )
    return None if hot.isEmpty() else hot, {k for k, n in zip(keys, absent, strict=True) if n}


def join_unique(
    many: DataFrame,
    one: DataFrame,
    keys: list[str],
    hot: tuple[DataFrame | None, set[str]] | None = None,
) -> DataFrame:
    """Left join of a table with one row per key onto rows of which many share a key.

    Missing keys match missing keys. Rows of hot keys meet a broadcast of the fewer than a
    thousand rows that those keys have; only the other rows are shuffled by key. The hot keys
    are stored; without any, both sides join once, and by a key column without missing values
    rows stay placed for what groups them by it. ``many`` is read up to four times, so pass a
    stored table. ``hot`` is the result of ``hot_keys`` if it is known; else it runs jobs.
    """
    names = [f"_one_{k}" for k in keys]
    few, absent = hot_keys(many, keys) if hot is None else hot
    side = one.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
                      *[c for c in one.columns if c not in keys])

    def matches(left: DataFrame, right: DataFrame):
        on = F.lit(True)
        for k, n in zip(keys, names, strict=True):
            on = on & (left[k].eqNullSafe(right[n]) if k in absent else left[k] == right[n])
        return on

    if few is None:
        return many.join(side, matches(many, side), "left").drop(*names)
    renamed = few.toDF(*[f"_hot_{k}" for k in keys])
    few = F.broadcast(few)
    hot_rows = many.join(few, matches(many, few), "left_semi")
    other_rows = many.join(few, matches(many, few), "left_anti")
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & side[n].eqNullSafe(renamed[f"_hot_{k}"])
    hot_side = F.broadcast(side.join(F.broadcast(renamed), on, "left_semi"))
    found = hot_rows.join(hot_side, matches(hot_rows, hot_side), "left").drop(*names)
    return found.unionByName(other_rows.join(side, matches(other_rows, side), "left").drop(*names))
