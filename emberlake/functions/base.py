"""Small column helpers shared by the function modules."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float, high: float) -> Column:
    """Bound ``value``; null stays null (``least``/``greatest`` would skip it)."""
    bounded = F.least(F.greatest(value, F.lit(low)), F.lit(high))
    return F.when(value.isNotNull(), bounded)


def lookup(table: Mapping[str, object], key: Column, default=None) -> Column:
    """Value of a fixed table by string key, ``default`` where it is absent."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def steps(value: Column, cuts: list[float], names: list) -> Column:
    """First name whose cut is above ``value``; the last name beyond all cuts."""
    chain = F.when(value < cuts[0], F.lit(names[0]))
    for cut, name in zip(cuts[1:], names[1:]):
        chain = chain.when(value < cut, F.lit(name))
    return F.when(value.isNotNull(), chain.otherwise(F.lit(names[len(cuts)])))


def inline_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """Plain substitution: codegen's subexpression elimination shares the value."""
    return body(value)


def bound_value(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside a higher-order function there is no subexpression elimination, so a
    value used n times would be computed n times.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def finite_or_null(value: Column) -> Column:
    """NaN and infinities become null, as missing data is null everywhere here."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def safe_number(value: Column, default: float = 0.0) -> Column:
    """Null, NaN, infinite or non-numeric becomes ``default``."""
    return F.coalesce(finite_or_null(value.try_cast("double")), F.lit(default))


def near_tie(value: Column, places: int) -> Column:
    """Whether ``value`` is so near to the middle of two numbers of ``places`` that only its decimal text tells which is nearer, or is large."""
    scaled = F.abs(value) * 10.0**places
    return (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-3) | ~(scaled < 1e12)


def quick_bround(value: Column, places: int) -> Column:
    """``bround`` without going through decimals but for values near a tie; for columns with a value for each of many pairs."""
    return F.when(near_tie(value, places), F.bround(value, places)).otherwise(F.rint(value * 10.0**places) / 10.0**places)
