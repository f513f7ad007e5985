"""Text forms of values: standardised strings, identifiers, and one string per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TEXT_SEPARATOR = " | "
ID_REPEAT = 3

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
_OTHER_SCALAR = (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGRAL)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FRACTIONAL)


def is_decimal(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.DecimalType)


def is_numeric(dtype: T.DataType) -> bool:
    return is_integral(dtype) or is_fractional(dtype) or is_decimal(dtype)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_scalar(dtype: T.DataType) -> bool:
    """Types that take part in matching and imputation; others are only carried along."""
    return is_numeric(dtype) or is_text(dtype) or isinstance(dtype, _OTHER_SCALAR)


def is_id_name(name: str) -> bool:
    """Identifier-like column name: 'id' anywhere in it, whatever the case."""
    return "id" in name.lower()


def standardize(text: Column) -> Column:
    """Trim all Unicode whitespace and lower-case."""
    return F.lower(F.btrim(text, F.lit(WHITESPACE)))


def value_text(value: Column, dtype: T.DataType) -> Column:
    """A value as standardised text."""
    return standardize(value if is_text(dtype) else value.cast("string"))


def id_text(value: Column, dtype: T.DataType) -> Column:
    """Canonical identifier text: whole numbers print alike whatever their numeric type."""
    if is_fractional(dtype):
        whole = (value == F.floor(value)) & (F.abs(value) < F.lit(1e15))
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(
            F.lower(value.cast("string"))
        )
    if is_decimal(dtype) and dtype.scale > 0:
        return F.rtrim(F.rtrim(value.cast("string"), F.lit("0")), F.lit("."))
    return value_text(value, dtype)


def row_text(columns: list[tuple[str, Column, T.DataType]]) -> Column:
    """One string per row: ``name: value`` parts in order, nulls skipped.

    Numbers and booleans show two decimals; other identifier-like columns are repeated
    so that they weigh more.
    """
    parts: list[Column] = []
    for name, value, dtype in columns:
        label = F.lit(f"{name}: ")
        if is_numeric(dtype) or isinstance(dtype, T.BooleanType):
            number = value.cast("int") if isinstance(dtype, T.BooleanType) else value
            parts.append(F.concat(label, two_decimals(number.cast("double"))))
        else:
            part = F.concat(label, value_text(value, dtype))
            parts.extend([part] * (ID_REPEAT if is_id_name(name) else 1))
    return F.concat_ws(TEXT_SEPARATOR, *parts) if parts else F.lit("")


def two_decimals(number: Column) -> Column:
    """Two decimals, rounding the exact binary value half-even as Python's format does."""
    return F.call_function("format_number", number, F.lit("0.00"))
