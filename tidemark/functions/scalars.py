"""Scalar derivations as column expressions: null where an input is missing, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in a raw cell. Engines differ on forms like 1.0d or 1_000; this pattern decides for all.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strict_sum(*columns) -> Column:
    """Null unless all are present."""
    total = _c(columns[0])
    for c in columns[1:]:
        total = total + _c(c)
    return total


def positive_ratio(n, d) -> Column:
    """n / d where d is above zero, else null."""
    return F.when(_c(d) > 0, F.try_divide(_c(n), _c(d)))


def ratio(n, d) -> Column:
    """n / d; null where d is zero."""
    return F.try_divide(_c(n), _c(d))


def product_sum(*pairs) -> Column:
    """Sum of amount * percent / 100 over the pairs, null unless all are present."""
    return strict_sum(*(_c(a) * _c(p) / 100 for a, p in pairs))


def mean_present(*columns) -> Column:
    """Mean of the columns that aren't null; null if none is."""
    held = F.array_compact(F.array(*map(_c, columns)))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))


def floor_zero(c) -> Column:
    return F.when(_c(c).isNotNull(), F.greatest(F.lit(0.0), _c(c)))


def finite(c) -> Column:
    """The number, or null where it is NaN or infinite."""
    x = _c(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def parse_number(text) -> Column:
    """Number in a raw cell, or null."""
    return F.when(_c(text).rlike(NUMBER), F.trim(_c(text)).try_cast("double"))


def next_day_purity(gas, volume) -> tuple[Column, Column]:
    """100 * gas / volume and null, or null and why it can't be: gas has to lie between zero and volume."""
    ok = F.coalesce((_c(volume) > 0) & (_c(gas) >= 0) & (_c(gas) <= _c(volume)), F.lit(False))
    return F.when(ok, F.try_divide(100 * _c(gas), _c(volume))), F.when(~ok, F.lit("PHYSICAL_CONSISTENCY_FAILED"))


def half_up(c, digits: int) -> Column:
    return F.round(_c(c), digits)


def reading_text(a, b, digits: int = 2) -> Column:
    """Both sides in fixed digits; N/A where one is missing."""
    show = lambda x: F.when(_c(x).isNotNull(), F.format_string(f"%.{digits}f", _c(x))).otherwise("N/A")
    return F.concat(F.lit("A "), show(a), F.lit(" / B "), show(b))


def percent_text(change_pct) -> Column:
    """Like +3.2% up; null without a change."""
    x = _c(change_pct)
    return F.when(x.isNotNull(), F.concat(F.format_string("%+.1f%%", x), F.when(x >= 0, F.lit(" up")).otherwise(F.lit(" down"))))


def ratio_band(c) -> Column:
    """Stable below .30, Caution below .40, Unstable below .80, else Danger; null stays null."""
    x = _c(c)
    return F.when(x < 0.30, "Stable").when(x < 0.40, "Caution").when(x < 0.80, "Unstable").when(x >= 0.80, "Danger")


BANDS = ("Stable", "Caution", "Unstable", "Danger")


def error_code(message) -> Column:
    """A class of error by the start of its message."""
    m = _c(message)
    return F.when(m.startswith("INVALID_WORKBOOK"), "WORKBOOK_PARSE_FAILED").when(m.startswith("MISSING_SHEET"), "INPUT_TABLE_MISSING").otherwise("SCHEMA_INVALID")


def array_median(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    middle = F.floor(n / 2).cast("int")
    return F.when(n % 2 == 1, F.get(s, middle)).when(n > 0, (F.get(s, middle - 1) + F.get(s, middle)) / 2)


def array_mad(values: Column, center: Column) -> Column:
    """Median distance from center."""
    return array_median(F.transform(values, lambda x: F.abs(x - center)))
