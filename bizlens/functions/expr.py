"""Column expressions shared by all operators.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text accepted as a number: optional sign, digits with an optional point or a
# leading point, optional exponent, surrounding blanks allowed. Anything else
# (thousand separators, decimal commas, trailing letters, booleans) is missing.
NUMBER_TEXT = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric_type(dtype: T.DataType, include_bool: bool = True) -> bool:
    if isinstance(dtype, T.BooleanType):
        return include_bool
    return isinstance(dtype, NUMERIC_TYPES)


def is_date_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, DATE_TYPES)


def col_ref(name: str) -> Column:
    """Reference a column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def to_number(df: DataFrame, name: str) -> Column:
    """Coerce a column to double; unparsable text becomes NULL.

    Numbers pass through, booleans become 0/1, dates become epoch seconds
    (correlation and scaling are unchanged by the unit), text must match
    ``NUMBER_TEXT`` before it is cast.
    """
    c = col_ref(name)
    dtype = field_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    if is_numeric_type(dtype):
        return c.cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double") * F.lit(86400.0)
    if isinstance(dtype, T.TimestampNTZType):
        # wall-clock seconds since 1970-01-01 00:00, independent of the session time zone
        seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), c).cast("double")
        return F.unix_date(F.to_date(c)).cast("double") * F.lit(86400.0) + seconds
    if is_date_type(dtype):
        return F.unix_micros(c).cast("double") / F.lit(1_000_000.0)
    if isinstance(dtype, T.StringType):
        text = F.trim(c)
        return F.when(text.rlike(NUMBER_TEXT), F.expr("try_cast(trim(%s) AS DOUBLE)" % _sql_ident(name)))
    return F.lit(None).cast("double")


def _sql_ident(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def zero_sum(c: Column) -> Column:
    """Sum where an empty or all-NULL group gives 0, as pandas does."""
    return F.coalesce(F.sum(c), F.lit(0))


def pct_change(current: Column, previous: Column) -> Column:
    """Percent change; NULL when the previous value is 0."""
    return F.when(previous != 0, (current - previous) / previous * F.lit(100.0))


def money_text(c: Column) -> Column:
    """``1 234.50`` style text with two decimals; ``-`` for NULL."""
    return F.coalesce(F.translate(F.format_number(c.cast("double"), 2), ",", " "), F.lit("-"))


def percent_text(c: Column) -> Column:
    """``12.3%`` style text with one decimal; ``-`` for NULL."""
    return F.when(c.isNotNull(), F.format_string("%.1f%%", c.cast("double"))).otherwise(F.lit("-"))


def unbiased_skew(g1: Column, n: Column) -> Column:
    """Bias-corrected sample skewness from the population value ``g1``."""
    n_d = n.cast("double")
    return F.when(n >= 3, g1 * F.sqrt(n_d * (n_d - 1)) / (n_d - 2))


def round_half(c: Column, digits: int) -> Column:
    return F.round(c.cast("double"), digits)
