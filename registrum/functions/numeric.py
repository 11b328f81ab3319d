"""Prominence in single precision, stored tenths, and dates as year fractions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from registrum.functions.constants import DEAD_REGISTRATION, GOVERNMENT, PROMINENCE


def _single(x: Column) -> Column:
    return x.cast("float")


def _term(weight: float, feature: Column) -> Column:
    return _single(F.lit(weight).cast("float") * _single(feature))


def flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def prominence(now_year: float, weights: dict[str, float] = PROMINENCE) -> Column:
    """Over entity_status, registration, category, n_direct, n_ultimate, n_branch, isin, bic, has_parent, registered_year and
    name_length; rounded to single precision after every step, in a fixed order."""
    c, w = F.col, weights
    dead = (c("entity_status") != "ACTIVE") | c("registration").isin(*DEAD_REGISTRATION)
    kids = F.greatest("n_direct", "n_ultimate")
    age = _single(F.lit(now_year).cast("float") - _single(c("registered_year")))
    years = F.when(age.isNull() | F.isnan(age), F.lit(0.0)).otherwise(F.least(F.greatest(age, F.lit(0.0)), F.lit(15.0)))
    terms = [
        (w["lapsed"], flag(~dead & (c("registration") == "LAPSED"))),
        (w["fund"], flag(c("category") == "FUND")),
        (w["gov"], flag(c("category").isin(*GOVERNMENT))),
        (w["children"], F.log1p(kids)),
        (w["top"], flag((kids > 0) & ~c("has_parent"))),
        (w["has_parent"], flag(c("has_parent"))),
        (w["branches"], F.log1p("n_branch")),
        (w["isin"], F.least(_single(F.log1p("isin")), F.lit(w["isin_cap"]).cast("float"))),
        (w["bic"], flag(c("bic"))),
        (w["age"], _single(years / 10)),
        (w["len"], F.log(F.greatest("name_length", F.lit(1)))),
    ]
    total = _term(w["dead"], flag(dead))
    for weight, feature in terms:
        total = _single(total + _term(weight, feature))
    return total


def stored_tenths(p: Column) -> Column:
    """Tenths, halves upwards."""
    return F.floor(p.cast("double") * 10 + 0.5)


def registration_year(date: Column) -> Column:
    """Year and whole months of an ISO date; NaN where it is none."""
    good = (F.length(date) >= 10) & date.rlike("^[0-9]{4}")
    return F.when(good, F.left(date, F.lit(4)).cast("int") + (F.substring(date, 6, 2).cast("int") - 1) / 12).otherwise(F.lit(float("nan")))


def year_fraction(date: Column) -> Column:
    return F.year(date) + (F.month(date) - 1 + (F.dayofmonth(date) - 1) / F.dayofmonth(F.last_day(date))) / 12


def stand_in_prominence(key: Column) -> Column:
    """A prominence from -3 to 2.99 that a hash of the key gives, for tests without signals."""
    return F.conv(F.left(F.sha2(key.cast("string").cast("binary"), 256), F.lit(8)), 16, 10).cast("long") % 600 / 100 - 3
