"""Half-open look-back windows and the periods tables are partitioned by.

Times without a zone, in Python and in ``timestamp_ntz`` columns, are UTC.
"""

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def as_utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=UTC) if moment.tzinfo is None else moment.astimezone(UTC)


def _literal(moment: datetime, dtype: T.DataType) -> Column:
    # Typed like the column, so that the comparison reaches the Parquet scan.
    moment = as_utc(moment)
    if isinstance(dtype, T.TimestampNTZType):
        return F.lit(moment.replace(tzinfo=None).isoformat(sep=" ")).cast(dtype)
    return F.lit(moment.isoformat()).cast(dtype)


def in_window(
    df: DataFrame, ts_col: str, as_of: datetime | None, lookback: timedelta | None
) -> Column:
    """``as_of - lookback <= ts < as_of``; without ``lookback`` every row."""
    if lookback is None:
        return F.lit(True)
    dtype = df.schema[ts_col].dataType
    ts, as_of = F.col(ts_col), as_utc(as_of)
    return (ts >= _literal(as_of - lookback, dtype)) & (ts < _literal(as_of, dtype))


def period_of(df: DataFrame, ts_col: str, hours: int = 1) -> Column:
    """Whole periods of ``hours`` since 1970-01-01 00:00 UTC, in any session time zone."""
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        passed = F.expr(f"(`{ts_col}` - timestamp_ntz'1970-01-01') div interval '1' hour")
    else:
        passed = F.floor(F.unix_seconds(F.col(ts_col)) / 3600)
    return F.floor(passed / hours).cast("int")


def periods_between(as_of: datetime, lookback: timedelta, hours: int = 1) -> range:
    """The periods that ``in_window`` can touch."""
    length = timedelta(hours=hours)
    last = (as_utc(as_of) - timedelta(microseconds=1) - _EPOCH) // length
    return range((as_utc(as_of) - lookback - _EPOCH) // length, last + 1)
