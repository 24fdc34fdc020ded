"""Biomass equations, plot areas, collections and carbon as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from standtally.functions import fixed
from standtally.functions.semantics import ColumnOrName, as_col, ifelse3, token_to_number


def agb_chave_016(d: ColumnOrName, wd: ColumnOrName, h: ColumnOrName) -> Column:
    """Above-ground biomass in kg from diameter (cm), wood density and height (m)."""
    volume = as_col(wd) * (as_col(d) * as_col(d)) * as_col(h)
    return F.lit(0.0673) * F.pow(volume, F.lit(0.976))


def agb_chave_005(d: ColumnOrName, wd: ColumnOrName, h: ColumnOrName) -> Column:
    """Above-ground biomass in kg, linear form."""
    return F.lit(0.0559) * (as_col(wd) * (as_col(d) * as_col(d)) * as_col(h))


def measured_within(
    d: ColumnOrName, h: ColumnOrName, value: Column, max_height: float = fixed.MAX_HEIGHT_M
) -> Column:
    """The value unless diameter or height is a sentinel; missing when that is unknown."""
    beyond = (as_col(d) > fixed.MAX_DIAMETER) | (as_col(h) > max_height)
    return ifelse3(beyond, F.lit(None).cast("double"), value)


def agb_reported(value: ColumnOrName, d: ColumnOrName, h: ColumnOrName) -> Column:
    """The inventory's own biomass in kg, read from text."""
    return measured_within(d, h, token_to_number(value))


def plot_area_ha(subplots: ColumnOrName) -> Column:
    """Sampled area by number of subplots."""
    n = as_col(subplots)
    area = F
    for count, hectares in fixed.AREA_BY_SUBPLOTS.items():
        area = area.when(n == count, F.lit(hectares))
    return area.otherwise(F.lit(fixed.FULL_AREA))


def per_hectare(units: ColumnOrName, unit_t: float, area: ColumnOrName, digits: int) -> Column:
    """Tonnes per hectare, half up to ``digits``, from a whole number of mass units.

    ``unit_t`` is how many units make a tonne and areas are whole hundredths of a
    hectare, so the ratio that gets rounded is exact and ties always go up.
    """
    hundredths = F.round(as_col(area) * 100.0)
    scaled = F.try_divide(
        as_col(units).cast("double"), hundredths * (unit_t / 10.0 ** (digits + 2))
    )
    return F.round(scaled) / float(10**digits)


def agb_per_hectare(agb_t: ColumnOrName, area: ColumnOrName, digits: int = 2) -> Column:
    """Tonnes per hectare from tonnes known to 10 g, half up to ``digits``."""
    return per_hectare(F.round(as_col(agb_t) * 1e5), 1e5, area, digits)


def collection_code(state_code: ColumnOrName) -> Column:
    """Collection label of a state: 1 is COL212, 2..32 run from COL214; else missing."""
    s = as_col(state_code).cast("int")
    number = F.when(s == 1, F.lit(212)).when((s >= 2) & (s < 33), s + 212)
    return F.concat(F.lit("COL"), number.cast("string"))


def carbon(agb: ColumnOrName) -> Column:
    """Carbon share of biomass."""
    return as_col(agb) * F.lit(fixed.CARBON_FRACTION)


def bgb(carbon_mg: ColumnOrName, climate: ColumnOrName) -> Column:
    """Below-ground biomass from carbon; missing outside tropical and temperate climate."""
    c, zone = as_col(carbon_mg), as_col(climate)
    log_mass = F.lit(fixed.BGB_INTERCEPT) + F.lit(fixed.BGB_SLOPE) * F.ln(c)

    def grown(offset: float) -> Column:
        return F.when(c == 0, F.lit(0.0)).otherwise(F.exp(log_mass + F.lit(offset)))

    return F.when(zone == "Tropical", grown(0.0)).when(
        zone == "Temperate", grown(fixed.BGB_TEMPERATE_OFFSET)
    )


def fire_status_year(fire_year: ColumnOrName, survey_year: ColumnOrName) -> Column:
    """Year of a fire: this year, none for earlier years, else the year given."""
    text = as_col(fire_year)
    return ifelse3(
        text == fixed.FIRE_THIS_YEAR,
        as_col(survey_year).cast("int"),
        F.when(text != fixed.FIRE_EARLIER_YEARS, text.try_cast("int")),
    )
