"""Text standardisation, plot keys and species names."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from standtally.functions.fixed import ASCII_FORMS, KEY_PREFIX, RARE_SIGNS, STATE_RENAMES
from standtally.functions.semantics import (
    ColumnOrName,
    as_col,
    paste,
    sub_first,
    text_or_na,
)

NBSP = "\u00a0"

# A run of anything but letters, marks and digits separates words of a name.
WORD_BREAK = r"[^\p{L}\p{M}\p{Nd}]+"


# Blocks that hold Latin letters, spaces, punctuation and full-width ASCII.
FOLDED_BLOCKS = [
    (0x00A0, 0x0300),
    (0x1E00, 0x1F00),
    (0x2000, 0x2070),
    (0x2C60, 0x2C80),
    (0x3000, 0x3001),
    (0xFB00, 0xFB07),
    (0xFF01, 0xFF5F),
]
PLAIN_LETTER = re.compile(r"LATIN SMALL LETTER ([A-Z]) WITH ")


def ascii_form(sign: str) -> str | None:
    """ASCII for a lower-case letter or sign, one or more letters; None if it has none.

    Fixed values first; then dashes, spaces and quotation marks by their Unicode category
    and name, letters by their decomposition or else by the letter in their name.
    """
    if sign in ASCII_FORMS:
        return ASCII_FORMS[sign]
    kind, name = unicodedata.category(sign), unicodedata.name(sign, "")
    if kind in ("Zs", "Pd"):
        return " " if kind == "Zs" else "-"
    if "QUOTATION MARK" in name and kind in ("Pi", "Pf"):
        return '"' if "DOUBLE" in name else "'"
    if kind in ("Ll", "Lo", "Pc", "Pe", "Po", "Ps", "Sm", "Nd", "Sk", "Sc"):
        parts = unicodedata.normalize("NFKD", sign)
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if base.isascii() and parts != sign and not base.startswith(" "):
            return base
    named = PLAIN_LETTER.match(name)
    return named[1].lower() if named else None


@cache
def _ascii_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Signs and their one ASCII letter, and signs that spell out as several letters.

    Combining marks map to nothing, so they stand after all others of the first.
    """
    one, several = [], []
    for first, end in FOLDED_BLOCKS:
        for sign in map(chr, range(first, end)):
            form = ascii_form(sign) if sign == sign.lower() else None
            if form is not None:
                (one if len(form) == 1 else several).append((sign, form))
    marks = "".join(map(chr, range(0x0300, 0x0370)))
    return "".join(a for a, _ in one) + marks, "".join(b for _, b in one), several


def fold_text(c: ColumnOrName, space: str = " ", rare: bool = True) -> Column:
    """Lower case in ASCII as far as Latin letters and punctuation go; ``space`` is
    written for spaces. Without ``rare`` the signs of ``RARE_SIGNS`` stay as they are, which
    keeps the generated code of a large stage below the size that the JVM compiles.

    Plain ASCII text, told by its byte length, skips the tables, and text without a sign
    of several letters skips their replacement.
    """
    source = F.lower(as_col(c))
    signs, plain, several = _ascii_tables()
    several = [pair for pair in several if rare or pair[0] not in RARE_SIGNS]
    longer = source.rlike("[" + "".join(sign for sign, _ in several) + "]")
    # Never missing, so that the generated code has no null checks between replacements.
    spelled = F.coalesce(source, F.lit(""))
    for sign, form in several:
        spelled = F.replace(spelled, F.lit(sign), F.lit(form))
    folded = F.translate(F.when(longer, spelled).otherwise(source), signs, plain)
    out = F.when(F.octet_length(source) == F.char_length(source), source).otherwise(folded)
    return out if space == " " else F.replace(out, F.lit(" "), F.lit(space))


def standardize_name(c: ColumnOrName, rare: bool = True) -> Column:
    """Lower case in ASCII, spaces as underscores; ``rare`` as in ``fold_text``."""
    return fold_text(c, "_", rare)


def state_alias(c: ColumnOrName) -> Column:
    """Rename states inside a standard name."""
    out = as_col(c)
    for old, new in STATE_RENAMES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def clean_nbsp(c: ColumnOrName) -> Column:
    """No-break spaces as spaces, lower case."""
    return F.lower(F.replace(as_col(c), F.lit(NBSP), F.lit(" ")))


def plot_key(plot: ColumnOrName, state_code: ColumnOrName, prefix: str | None = None) -> Column:
    """``<plot>_<state>``, with ``NA`` for an unknown part; optionally prefixed."""
    parts = [text_or_na(plot), text_or_na(state_code)]
    return F.concat_ws("_", *([F.lit(prefix)] if prefix else []), *parts)


def public_key(source_code: ColumnOrName) -> Column:
    """The plot key with its public prefix."""
    return F.concat_ws("_", F.lit(KEY_PREFIX), text_or_na(source_code))


def parse_species(
    df: DataFrame,
    name_col: str,
    unknown_marks: tuple[str, ...] = ("Aa",),
    hybrid: str | None = None,
    literal: bool = False,
) -> DataFrame:
    """Split a binomial into ``genus`` and ``species`` and rebuild ``full_species``.

    Words past the second are dropped; a missing epithet becomes ``sp.``. ``hybrid`` is
    the epithet that marks a hybrid and also becomes ``sp.``: by default only when it is
    the whole epithet, with ``literal=True`` at its first occurrence in any epithet.
    Each unknown mark is replaced once in the rebuilt name.
    """
    words = F.split(F.col(name_col), WORD_BREAK, -1)
    species = F.coalesce(F.get(words, F.lit(1)), F.lit("sp."))
    if hybrid is not None:
        species = (
            sub_first(species, hybrid, "sp.")
            if literal
            else F.when(species == hybrid, F.lit("sp.")).otherwise(species)
        )
    out = df.withColumns({"genus": F.get(words, F.lit(0)), "species": species}).withColumn(
        "full_species", paste("genus", "species")
    )
    name = F.col("full_species")
    for mark in unknown_marks:
        # Names without the mark, nearly all of them, skip the regex.
        marked = F.when(name.contains(mark), sub_first(name, mark, "Indet sp.")).otherwise(name)
        out = out.withColumn("full_species", marked)
    return out


def vegetation_status(disturbance: ColumnOrName, secondary: ColumnOrName) -> Column:
    """Disturbance and secondary-vegetation texts joined by ``;``, blank when neither."""
    return F.concat_ws(";", as_col(disturbance), as_col(secondary))


__all__ = [
    "clean_nbsp",
    "fold_text",
    "parse_species",
    "plot_key",
    "public_key",
    "standardize_name",
    "state_alias",
    "vegetation_status",
]
