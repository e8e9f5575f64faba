"""Column expressions built only from ``pyspark.sql.functions``.

They stay inside whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def strict_cast(col: Column, dtype: T.DataType | str, what: str) -> Column:
    """Cast that fails the job on a value that does not convert.

    Same outcome whatever ``spark.sql.ansi.enabled`` says: a non-null input whose
    cast is null raises, naming the field.  Nulls stay null.
    """
    casted = col.try_cast(dtype)
    return F.coalesce(casted, F.when(col.isNotNull(), _fail(f"cannot convert {what}: ", col, dtype)))


def required(col: Column, what: str) -> Column:
    """Fail the job on a null in a field every record must have."""
    return F.coalesce(col, F.raise_error(F.lit(f"missing value for {what}")))


def required_cast(col: Column, dtype: T.DataType | str, what: str) -> Column:
    """``required(strict_cast(..))`` with the source evaluated once per row:
    the error branch runs only when the cast gives null."""
    return F.coalesce(col.try_cast(dtype), _fail(f"missing or invalid value for {what}: ", col, dtype))


def _fail(message: str, col: Column, dtype) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.coalesce(col.cast("string"), F.lit("null")))).cast(dtype)


def epoch_millis(col: Column, dtype: T.DataType) -> Column:
    """Epoch milliseconds (floored) of a timestamp, date or number column.

    ``timestamp`` is an instant; ``timestamp_ntz`` is read as UTC wall-clock
    time, so the result does not depend on the session time zone; a date is its
    UTC midnight; numbers are taken as milliseconds already.
    """
    if isinstance(dtype, T.TimestampType):
        return F.unix_millis(col)
    if isinstance(dtype, T.TimestampNTZType):
        micros = F.timestamp_diff("MICROSECOND", F.expr(_NTZ_EPOCH), col)
        # floor division, exact: the numerator is a multiple of 1000
        return ((micros - F.pmod(micros, F.lit(1000))) / F.lit(1000)).cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(col).cast("long") * F.lit(86_400_000)
    return col.cast("long")


def half_up(x: Column) -> Column:
    """Round half up to a whole number, as ``floor(x + 0.5)``."""
    return F.floor(x + F.lit(0.5))
