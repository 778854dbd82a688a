"""Decimals that travel as base64 text of big-endian two's-complement bytes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_64 = "18446744073709551616"
_LONG_DIGITS = 16     # hex digits of 8 bytes
_WIDE_DIGITS = 32     # hex digits of 16 bytes
_LONG_PRECISION = 18  # every decimal up to here fits 8 bytes

# More than 8 bytes whose leading bytes only repeat the sign.
_PADDED_LONG = "^(0+[0-7]|F+[89A-F])[0-9A-F]{15}$"


def byte_digits(encoded: Column) -> Column:
    """Hex digits of the encoded bytes; null when the text is not base64."""
    return F.hex(F.try_to_binary(encoded, F.lit("base64")))


def _sign_extended(digits: Column, width: int) -> Column:
    sign = F.when(F.substring(digits, 1, 1) >= "8", "F").otherwise("0")
    return F.lpad(digits, width, sign)


def _long(digits: Column) -> Column:
    """Up to 8 bytes, or more if the surplus only repeats the sign, as a bigint."""
    size = F.length(digits)
    sixteen = (
        F.when((size > 0) & (size <= _LONG_DIGITS), _sign_extended(digits, _LONG_DIGITS))
        .when(digits.rlike(_PADDED_LONG), F.right(digits, F.lit(_LONG_DIGITS)))
    )
    return F.conv(sixteen, 16, -10).cast("bigint")


def _wide(digits: Column) -> Column:
    """Up to 16 bytes, joined from two 64-bit halves.

    The negative case moves one unit between the halves so that no partial result
    needs more than 38 digits.
    """
    size = F.length(digits)
    full = F.when((size > 0) & (size <= _WIDE_DIGITS), _sign_extended(digits, _WIDE_DIGITS))
    high = F.conv(F.left(full, F.lit(_LONG_DIGITS)), 16, -10).cast("decimal(20,0)")
    low = F.conv(F.right(full, F.lit(_LONG_DIGITS)), 16, 10).cast("decimal(20,0)")
    unit = F.lit(_TWO_64).cast("decimal(20,0)")
    positive = F.try_add(F.try_multiply(high, unit), low)
    negative = F.try_add(F.try_multiply(high + 1, unit), low - unit)
    return F.when(high < 0, negative).otherwise(positive).try_cast("decimal(38,0)")


def decimal_from_digits(digits: Column, precision: int, scale: int) -> Column:
    """``decimal(precision, scale)`` from hex digits; null when out of range.

    The scale is applied without a decimal division, which would round beyond six
    digits: by an exact product where that fits 38 digits, else through the exponent of
    the number's text.
    """
    target = f"decimal({precision},{scale})"
    if precision <= _LONG_PRECISION and scale <= _LONG_PRECISION:
        step = F.lit(Decimal(1).scaleb(-scale))
        return (_long(digits).cast("decimal(19,0)") * step).try_cast(target)
    return F.concat(_wide(digits).cast("string"), F.lit(f"E-{scale}")).try_cast(target)


def connect_decimal(encoded: Column, precision: int, scale: int) -> Column:
    """``decimal(precision, scale)`` from its encoded form.

    Unreadable or out-of-range input gives null, which callers report as a rejected
    record.
    """
    return decimal_from_digits(byte_digits(encoded), precision, scale)
