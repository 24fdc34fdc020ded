"""Null, rounding and ordering rules shared by every operator.

Two design points matter on a cluster. Sums and means run over scaled integers, so
they do not depend on the order in which partitions arrive. "First row" always means
the minimum under a declared order, as an aggregate with map-side combine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from standtally.functions.fixed import MISSING_TEXT

ColumnOrName = Column | str


def as_col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ifelse3(condition: Column, yes, no) -> Column:
    """Three-valued conditional: a null condition gives null, not the else branch."""
    return F.when(condition.isNull(), F.lit(None)).when(condition, yes).otherwise(no)


def text_or_na(c: ColumnOrName) -> Column:
    """The value as text, with a missing value printed as ``NA``."""
    return F.coalesce(as_col(c).cast("string"), F.lit(MISSING_TEXT))


def paste(*cols: ColumnOrName, sep: str = " ") -> Column:
    """Join values as text; missing values print as ``NA`` instead of vanishing."""
    return F.concat_ws(sep, *[text_or_na(c) for c in cols])


def sub_first(c: ColumnOrName, literal: str, replacement: str) -> Column:
    """Replace only the first occurrence of a literal text."""
    pattern = "(?s)^(.*?)" + re.escape(literal)
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(as_col(c), pattern, "$1" + safe)


# A whole number of units that a sum can hold 10**10 times over; larger ones count as missing.
UNITS = "decimal(28,0)"


def fixed_point(c: ColumnOrName, digits: int) -> Column:
    """A measurement (0 or more) as a whole number of 10**-digits, half up, as a double.

    An undefined or infinite measurement is missing. The value never leaves the doubles,
    so it is not limited by the range of a whole-number type.
    """
    units = as_col(c) * float(10**digits) + 0.5
    return F.when(F.abs(units) < float("inf"), units - F.pmod(units, F.lit(1.0)))


def units(c: ColumnOrName, digits: int) -> Column:
    """As ``fixed_point``, in the type that is summed: order does not matter to its sums."""
    return fixed_point(c, digits).try_cast(UNITS)


def round_half_up(c: ColumnOrName, digits: int) -> Column:
    """A measurement (0 or more) rounded half up, without leaving primitive doubles."""
    return fixed_point(c, digits) / float(10**digits)


def sum_fixed(c: ColumnOrName, digits: int = 2) -> Column:
    """Sum in whole units of 10**-digits; 0 when every value is missing."""
    return F.coalesce(F.sum(units(c, digits)), F.lit(0))


def mean_from_sums(total: Column, n: Column, digits: int, scale: int) -> Column:
    """Mean from a scaled sum and a count, half up to ``digits``; null when n is 0."""
    ratio = F.try_divide(total.cast("double"), n * float(10 ** (scale - digits)))
    return F.round(ratio) / float(10**digits)


def exact_mean(c: ColumnOrName, scale: int = 9) -> Column:
    """Mean that skips missing and undefined values and does not depend on row order."""
    value = units(c, scale)
    return mean_of_units(F.sum(value), F.count(value), scale)


def mean_of_units(total: Column, n: Column, scale: int) -> Column:
    """Mean from a sum of units and the count of its values; null when there are none."""
    return F.try_divide(total.cast("double"), n * float(10**scale))


def rounded_mean(c: ColumnOrName, digits: int = 2, scale: int = 4) -> Column:
    """Mean over values kept to ``scale`` decimals, rounded half up; null when none is present."""
    value = units(c, scale)
    return mean_from_sums(F.sum(value), F.count(value), digits, scale)


def count_distinct_na(c: ColumnOrName) -> Column:
    """Distinct count in which a missing value counts as one value."""
    has_null = F.coalesce(F.max(as_col(c).isNull().cast("int")), F.lit(0))
    return (F.count_distinct(as_col(c)) + has_null).cast("bigint")


def nulls_last(*cols: ColumnOrName) -> list[Column]:
    """Order key parts under which missing values come last."""
    return [part for c in cols for part in (as_col(c).isNull(), as_col(c))]


def first_value_by(value: ColumnOrName, order: Sequence[ColumnOrName]) -> Column:
    """Aggregate: the value of the first row under ``order`` (missing values last)."""
    return F.min_by(F.struct(as_col(value).alias("v")), F.struct(*nulls_last(*order)))["v"]


def token_to_number(c: ColumnOrName, type_name: str = "double") -> Column:
    """Text to number; a token such as ``NULL`` becomes a missing value."""
    return as_col(c).try_cast(type_name)
