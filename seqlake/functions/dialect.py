"""Functions of another SQL dialect under its names, as Spark columns.

Only those that Spark lacks or gives another meaning; the rest are used under Spark's own names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat(*parts: Column) -> Column:
    """NULLs count as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def string_split(s: Column, separator: str) -> Column:
    """By a plain separator, not a pattern."""
    return F.split(s, "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def regexp_matches(s: Column, pattern: str) -> Column:
    return F.regexp_like(s, F.lit(pattern))


def regexp_extract(s: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract(s, pattern, group)


def strlen(s: Column) -> Column:
    return F.octet_length(s)


def divide(a: Column, b: Column) -> Column:
    """True division; by zero: NULL."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_divide(a: Column, b: Column) -> Column:
    """Towards negative infinity, as `//` on integers does not in Spark."""
    return F.floor(F.try_divide(a.cast("double"), b.cast("double")))


def log(x: Column) -> Column:
    return F.log10(x)


def to_int(x: Column) -> Column:
    """Casts round half away from zero."""
    return F.round(x).cast("int")


def time_bucket(ts: Column, seconds: int) -> Column:
    """The begin of the bucket from the epoch on, in the session's zone."""
    at = F.unix_timestamp(ts.cast("timestamp"))
    return F.timestamp_seconds(F.floor(at / seconds) * seconds)


def strftime(ts: Column, pattern: str) -> Column:
    # Pattern letters.
    letters = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD", "%y": "yy"}
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "%":
            out += letters[pattern[i : i + 2]]
            i += 2
        else:
            out += f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]
            i += 1
    return F.date_format(ts.cast("timestamp"), out)


def date_diff_days(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def epoch_ms(ts: Column) -> Column:
    """Rounded, not cut."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) + 500) / 1000)


def dayofweek(ts: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(ts) - 1


def list_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)


def json_extract_string(j: Column, path: str) -> Column:
    return F.get_json_object(j, path)


def quantile_cont(x: Column, p: float) -> Column:
    return F.percentile(x, p)


def string_agg(x: Column, separator: str, order: Column) -> Column:
    """Joined in an order; an aggregate."""
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
    return F.array_join(F.transform(pairs, lambda p: p["x"]), separator)
