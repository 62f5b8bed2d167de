"""Number expressions. Casts never fail: what is no number becomes null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# white space that may surround a number
_PADDING = " \t\n\r\f\v"
# a plain decimal number; leaves out forms only some parsers take, such as 1d or 0x1
_NUMBER = (
    r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\z"
)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def is_fraction(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def to_number(value: Column, dtype: T.DataType) -> Column:
    """Double, or null where the text is no number. NaN is no number either."""
    if is_text(dtype):
        # most text holds a plain integer; only the rest is matched
        return F.coalesce(_plain_whole(value).cast("double"), _decimal(value))
    if is_fraction(dtype):
        return F.when(~F.isnan(value), value.cast("double"))
    if isinstance(dtype, T.NumericType):
        return value.cast("double")
    return value.try_cast("double")


def _plain_whole(text: Column) -> Column:
    """The whole number a text of digits holds; the cast alone would also take others,
    as it strips control characters."""
    return F.when(F.translate(text, "0123456789", "") == "", text.try_cast("bigint"))


def _decimal(text: Column) -> Column:
    # no match gives an empty text, which is no number
    matched = F.regexp_extract(F.trim(text, F.lit(_PADDING)), _NUMBER, 0)
    return matched.try_cast("double")


def to_whole(value: Column, dtype: T.DataType, strict: bool = False) -> Column:
    """Bigint, or null where there is no whole number.

    A fraction such as ``3.7`` becomes null, or fails the job when ``strict``.
    Whole-number input stays a plain cast, so filters on it reach the scan.
    """
    if isinstance(dtype, T.IntegralType):
        return value.cast("bigint")
    number = _decimal(value) if is_text(dtype) else to_number(value, dtype)
    whole = number.try_cast("bigint")
    otherwise = F.lit(None).cast("bigint")
    if strict:
        otherwise = F.when(
            number.isNotNull(),
            F.raise_error(F.concat(F.lit("not a whole number: "), value.cast("string"))),
        ).cast("bigint")
    exact = F.when(whole.cast("double") == number, whole).otherwise(otherwise)
    return F.coalesce(_plain_whole(value), exact) if is_text(dtype) else exact


def has_fraction(value: Column, dtype: T.DataType) -> Column:
    """True where a number is present but not whole."""
    if isinstance(dtype, T.IntegralType):
        return F.lit(False)
    number = to_number(value, dtype)
    return number.isNotNull() & ~F.coalesce(
        number.try_cast("bigint").cast("double") == number, F.lit(False)
    )


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``100 * part / whole`` rounded; null where the whole is zero."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def half_even(value: Column, digits: int) -> Column:
    """Round with ties to the even digit; ``round`` sends ties away from zero."""
    return F.bround(value, digits)


def at_least_zero(value: Column) -> Column:
    """Negative and NaN values become zero."""
    return F.greatest(F.lit(0.0), F.nanvl(value, F.lit(0.0)))


def grouped(value: Column) -> Column:
    """Whole number with a comma between thousands."""
    return F.format_number(value, 0)


def plain(value: Column) -> Column:
    """Number as text without a needless ``.0`` or exponent, at any size.

    The digits are those of the shortest text for the number; an exponent only moves
    the point.
    """
    whole = value.try_cast("bigint")
    shown = value.cast("string")
    sign = F.when(shown.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(shown, "^-", "")
    power = F.regexp_extract(body, r"E(-?[0-9]+)$", 1).try_cast("int")
    left = F.regexp_extract(body, r"^([0-9]+)", 1)
    right = F.regexp_replace(F.regexp_extract(body, r"\.([0-9]+)", 1), "^0$", "")
    digits, point = F.concat(left, right), F.length(left) + power
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, "0"))
        .otherwise(
            F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
        )
    )
    return (
        F.when(whole.cast("double") == value, whole.cast("string"))
        .when(power.isNotNull(), F.concat(sign, moved))
        .otherwise(shown)
    )
