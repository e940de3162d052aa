"""Small column helpers: typed column lists, safe parsing, money, text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


def col(name: str) -> Column:
    """Reference a column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def _types(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in _types(df).items() if isinstance(t, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [n for n, t in _types(df).items() if isinstance(t, T.StringType)]


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null, so that both count as missing."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


#: Formats tried for dates stored as text, in this order; "" is ISO, with or without a time.
DATE_FORMATS = ("", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "dd.MM.yyyy", "dd-MM-yyyy", "yyyyMMdd", "MMM d, yyyy", "d MMM yyyy")


#: What text must look like to be read by these formats. Whatever a format reads passes; the rest need not be parsed, which costs an exception a value.
_YEAR, _MONTH, _DAY, _NAME = r"[+-]?[0-9]{4,}", r"(0[1-9]|1[0-2])", r"(0[1-9]|[12][0-9]|3[01])", r"\p{L}+\.?"
_SHAPES = {
    "MM/dd/yyyy": f"^{_MONTH}/{_DAY}/{_YEAR}$", "dd/MM/yyyy": f"^{_DAY}/{_MONTH}/{_YEAR}$", "yyyy/MM/dd": f"^{_YEAR}/{_MONTH}/{_DAY}$",
    "dd.MM.yyyy": rf"^{_DAY}\.{_MONTH}\.{_YEAR}$", "dd-MM-yyyy": f"^{_DAY}-{_MONTH}-{_YEAR}$", "yyyyMMdd": r"^[+-]?[0-9]{8,}$",
    "MMM d, yyyy": f"^{_NAME} [0-9]+, {_YEAR}$", "d MMM yyyy": f"^[0-9]+ {_NAME} {_YEAR}$",
}


def parsed_date(text: Column, date_format: str = "") -> Column:
    shaped = F.when(text.rlike(_SHAPES[date_format]), text) if date_format in _SHAPES else text
    return F.try_to_timestamp(shaped, F.lit(date_format)) if date_format else F.try_to_timestamp(text)


def settle_formats(df: DataFrame, names: list[str], formats: tuple[str, ...] = DATE_FORMATS) -> dict[str, tuple[str, int]]:
    """Per column the one format that reads most of its values, the first of equals, and how many it leaves unread.

    One aggregate for all text columns. A column of another type, or without values, has the ISO format.
    """
    found = {n: ("", 0) for n in names}
    texts = [n for n in names if isinstance(df.schema[n].dataType, T.StringType)]
    if texts:
        counted = df.agg(*[
            c for i, n in enumerate(texts) for c in (
                F.count(col(n)).alias(f"n{i}"), *[F.count(parsed_date(col(n), f)).alias(f"n{i}_{k}") for k, f in enumerate(formats)])
        ]).head()
        for i, n in enumerate(texts):
            best = max(range(len(formats)), key=lambda k: (counted[f"n{i}_{k}"], -k))
            found[n] = formats[best], counted[f"n{i}"] - counted[f"n{i}_{best}"]
    return found


def settle_format(df: DataFrame, name: str, formats: tuple[str, ...] = DATE_FORMATS) -> tuple[str, int]:
    return settle_formats(df, [name], formats)[name]


def as_timestamp(df: DataFrame, name: str, date_format: str = "") -> Column:
    """Parse leniently: text that is no date becomes null instead of an error.

    Without a time zone, so that day spans do not depend on the session's. Text in other than ISO form
    needs its ``date_format``, for instance from ``settle_format``.
    """
    if isinstance(df.schema[name].dataType, T.StringType):
        return parsed_date(col(name), date_format).cast("timestamp_ntz")
    return col(name).cast("timestamp_ntz")


def as_day(df: DataFrame, name: str, date_format: str = "") -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return parsed_date(col(name), date_format).cast("date")
    return col(name).cast("date")


def money_sum(value: Column) -> Column:
    """The sum of all values; nothing to sum gives 0.

    Values that a decimal with 12 places holds exactly are summed as such, so that their total is the
    same in whatever order the tasks finish. The others, and totals beyond the decimal, are summed as doubles.
    """
    number = value.cast("double")
    exact = number.try_cast("decimal(28,12)")
    fits = F.coalesce(exact.cast("double") == number, F.lit(False))
    held = F.coalesce(F.try_sum(F.when(fits, exact)).cast("double"), F.sum(F.when(fits, number)), F.lit(0.0))
    return held + F.coalesce(F.sum(F.when(~fits, number)), F.lit(0.0))


def settled(value: Column | str, digits: int) -> Column:
    """Round half up, after dropping the last bits that depend on the order of summation.

    Without the inner rounding a mean of exactly x.xx5 would fall to either side from one
    run to the next.
    """
    return F.round(F.round(value, digits + 7), digits)


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(r"\S+"))


def to_rows(structs: list[Column]) -> Column:
    """Turn a list of equally typed structs into rows (used after a one-row aggregate)."""
    return F.inline(F.array(*structs))
