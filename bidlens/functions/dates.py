"""Date / time column expressions.

Free-form parsing is replaced by an explicit, ordered format list; the
first format that parses wins (``coalesce`` of ``try_to_timestamp``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted timestamp layouts for award / tender dates, tried in
# this order after Spark's own ISO-8601 cast.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
    "yyyy/MM/dd",
    "d-MMM-yyyy",
    "MMMM d, yyyy",
    "M/d/yyyy",
]

# Sanctions period layouts.  Month-first before day-first, as the
# source sheet is read month-first with a day-first fallback.
SANCTION_DATE_FORMATS = [
    "yyyy-MM-dd",
    "d-MMM-yyyy",
    "MMMM d, yyyy",
    "MMM d, yyyy",
    "M/d/yyyy",
    "d/M/yyyy",
    "MMM yyyy",
]

# Texts that mean "no end date".
OPEN_ENDED = ["ongoing", "indefinite", "n/a", "na", ""]

MICROS_PER_DAY = 86_400_000_000


def parse_timestamp(df: DataFrame, name: str) -> Column:
    """UTC timestamp of column ``name`` whatever its stored type; bad → null."""
    if name not in df.columns:
        return F.lit(None).cast("timestamp")
    dt = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return c.cast("timestamp")
    s = F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    tries = [F.expr(f"try_cast(`{name}` AS timestamp)")] if isinstance(dt, T.StringType) else []
    tries += [F.try_to_timestamp(s, F.lit(f)) for f in TIMESTAMP_FORMATS]
    return F.coalesce(*tries)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed time in whole 24 h days (not calendar days)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(MICROS_PER_DAY))


def sanction_date(x: Column) -> Column:
    """Sanctions date text → ISO ``yyyy-MM-dd`` string, null when open-ended
    or unparseable."""
    s = F.regexp_replace(x.cast("string"), r"(?U)^\s+|\s+$", "")
    parsed = F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in SANCTION_DATE_FORMATS])
    return (F.when(s.isNull() | F.lower(s).isin(OPEN_ENDED), F.lit(None).cast("string"))
            .otherwise(F.date_format(parsed, "yyyy-MM-dd")))
