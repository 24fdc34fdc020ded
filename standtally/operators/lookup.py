"""First-match dictionary lookups and first rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions.semantics import first_value_by, nulls_last


def first_entries(
    dictionary: DataFrame, key: str, value: str, order_by: Sequence[str] | None = None
) -> DataFrame:
    """One row per dictionary key: the first under ``order_by`` (default: the value)."""
    first = first_value_by(value, order_by) if order_by else F.min(value)
    return dictionary.groupBy(key).agg(first.alias(value))


def lookup_first(
    df: DataFrame,
    key: str | Column,
    dictionary: DataFrame,
    dkey: str,
    value: str,
    out: str | None = None,
    default: Column | None = None,
    order_by: Sequence[str] | None = None,
    null_safe: bool = True,
) -> DataFrame:
    """Add the value of the first matching dictionary row; rows never multiply.

    A missing key finds a missing dictionary key unless ``null_safe`` is off. The plan
    is a left join against one row per key, broadcast when its known size allows.
    """
    out = out or value
    entries = first_entries(dictionary, dkey, value, order_by).select(
        F.col(dkey).alias("_lookup_key"), F.col(value).alias("_lookup_value")
    )
    probe = df.withColumn("_probe", F.col(key) if isinstance(key, str) else key)
    on = (
        F.col("_probe").eqNullSafe(F.col("_lookup_key"))
        if null_safe
        else F.col("_probe") == F.col("_lookup_key")
    )
    found = F.col("_lookup_value")
    if default is not None:
        found = F.coalesce(found, default)
    return (
        probe.join(entries, on, "left")
        .withColumn(out, found)
        .drop("_probe", "_lookup_key", "_lookup_value")
    )


def lookup_or_self(
    df: DataFrame, key: str, dictionary: DataFrame, dkey: str, value: str, out: str | None = None
) -> DataFrame:
    """As ``lookup_first``, keeping the key itself where the dictionary has no value."""
    return lookup_first(df, key, dictionary, dkey, value, out=out, default=F.col(key))


def first_per_key(df: DataFrame, key: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """One whole row per key: the first under ``order_by`` (default: all other columns).

    An aggregate with map-side combine, so a key with very many copies costs one row
    per map task instead of one huge sort group.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct(*nulls_last(*(order_by or others)), *[F.col(c) for c in others])
    first = F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_row")
    return df.groupBy(key).agg(first).select(key, "_row.*").select(*df.columns)


def relabel(c: str | Column, labels: dict[str, str]) -> Column:
    """Map fixed labels; anything else becomes missing."""
    source = F.col(c) if isinstance(c, str) else c
    out = F
    for old, new in labels.items():
        out = out.when(source == old, F.lit(new))
    return out
