"""Exact ratios, guarded divisions, exchange rates and money text."""

from collections.abc import Mapping
from decimal import Decimal
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.constants import FX_DEFAULT, FX_TO_USD

WIDE = "decimal(28,0)"


def rounded_ratio(numerator: Column, denominator: Column | int, digits: int = 2) -> Column:
    """numerator / denominator of two whole numbers, rounded half away from zero without binary error.

    Null when the denominator is zero. The division is done on whole numbers, so the result does not
    depend on the order in which partial sums were merged.
    """
    den = denominator if isinstance(denominator, Column) else F.lit(denominator)
    num = numerator.cast(WIDE) * F.lit(2 * 10**digits)
    den = den.cast(WIDE)
    magnitude = F.try_divide(F.abs(num) + den, den * F.lit(2))
    return F.signum(numerator.cast("double")) * F.floor(magnitude).cast("double") / F.lit(float(10**digits))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole of two counts; null when the whole is zero."""
    return rounded_ratio(part.cast(WIDE) * F.lit(100), whole, digits)


def relative_change(current: Column, previous: Column) -> Column:
    """(current - previous) / previous as a double; null when previous is zero."""
    return F.try_divide((current - previous).cast("double"), previous.cast("double"))


def change_percent(current: Column, previous: Column) -> Column:
    """Change against a previous count: from zero it is 100 when anything appeared, else 0."""
    fresh = F.when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(previous == 0, fresh).otherwise(percent(current - previous, previous))


def usd_rate(currency: Column, rates: Mapping[str, Decimal] = FX_TO_USD) -> Column:
    """Multiplier to USD of a currency code, from a literal map; unknown codes count as 1.00."""
    pairs = chain.from_iterable((F.lit(code), F.lit(rate).cast("decimal(12,6)")) for code, rate in rates.items())
    return F.coalesce(F.try_element_at(F.create_map(*pairs), currency), F.lit(FX_DEFAULT).cast("decimal(12,6)"))


def usd(amount: Column, currency: Column, rates: Mapping[str, Decimal] = FX_TO_USD) -> Column:
    return usd_rate(currency, rates) * amount


def money(column: Column, digits: int = 2) -> Column:
    """An amount for output: rounded as a decimal, then handed over as a double."""
    return F.round(column, digits).cast("double")


def money_text(amount: Column, currency: Column | None = None) -> Column:
    """Amount with its currency sign and thousands separators; empty for null."""
    # Currency signs.
    signs = {"USD": "$", "EUR": "€", "GBP": "£", "CAD": "C$", "AUD": "A$", "SEK": "kr"}
    code = currency if currency is not None else F.lit("USD")
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in signs.items()))
    sign = F.coalesce(F.try_element_at(lookup, code), F.lit(""))
    return F.when(amount.isNull(), "").otherwise(F.concat(sign, F.format_number(amount, 2)))
