"""Column expressions shared by the plans. All JVM-side built-ins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


# The shapes of ISO-8601 text: a calendar or week date, extended or basic, then
# optionally any one separator, a time in the same two forms, and a zone.
_DATE = r"(\d{4})(?:-(\d{2})-(\d{2})|(\d{2})(\d{2})|-W(\d{2})(?:-(\d))?|W(\d{2})(\d)?)"
_CLOCK = r"(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?|(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?[0-5]\d(?::?[0-5]\d)?)?)"
ISO_PATTERN = rf"(?s)^{_DATE}(?:.{_CLOCK}{_ZONE}?)?\z"
_PARTS = "$1|$2$4|$3$5|$6$8|$7$9|$10|$11$14|$12$15|$13$16|$17"  # year .. fraction, zone

# The shape that most text has; it is cast as it stands.
COMMON_PATTERN = r"^(?!0000)\d{4}-\d\d-\d\d[T ]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:Z|[+-]\d\d:[0-5]\d)?\z"


def _bound(value: Column, fn) -> Column:
    """``fn`` of a value that is evaluated once however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _number(digits: Column) -> Column:
    """Digits as a number; NULL for none. A cast of empty text fails by an exception in the task, which ``try_cast``
    catches row by row at tens of microseconds each: it is kept from it."""
    return F.nullif(digits, F.lit("")).try_cast("int")


def _date_text(year: Column, month: Column, day: Column, week: Column, weekday: Column) -> Column:
    nth, on = _number(week), F.coalesce(_number(weekday), F.lit(1))
    jan4 = F.make_date(_number(year), F.lit(1), F.lit(4))  # always in ISO week 1
    d = F.date_add(jan4, (nth - 1) * 7 + on - 1 - F.weekday(jan4))
    return (F.when(week == "", F.concat_ws("-", year, month, day))
            .when((F.weekofyear(d) == nth) & on.between(1, 7), d.cast("string")))


def _offset_seconds(zone: Column) -> Column:
    z = F.replace(zone, F.lit(":"), F.lit(""))

    def at(n: int) -> Column:
        return F.coalesce(_number(F.substring(z, n, 2)), F.lit(0))

    size = at(2) * 3600 + at(4) * 60 + at(6)
    return F.when(zone != "", F.when(F.startswith(z, F.lit("-")), -size).otherwise(size))


def _iso_parts(c: Column) -> Column:
    return F.split(F.when(c.rlike(ISO_PATTERN), F.regexp_replace(c, ISO_PATTERN, _PARTS)), r"\|")


def _read(part: Column) -> tuple[Column, Column]:
    """(time as written, seconds ahead of UTC) of the parts of a text."""
    year, month, day, week, weekday, hour, minute, second, fraction, zone = (F.get(part, F.lit(n)) for n in range(10))

    def two(x: Column) -> Column:
        return F.lpad(x, 2, "0")  # absent: 00

    text = F.concat(F.when(year != "0000", _date_text(year, month, day, week, weekday)), F.lit(" "),
                    two(hour), F.lit(":"), two(minute), F.lit(":"), two(second),
                    F.lit("."), F.rpad(F.substring(fraction, 1, 6), 6, "0"))
    return text.try_cast("timestamp_ntz"), _offset_seconds(zone)


def _taken_apart(c: Column) -> Column:
    """A struct (wall, offset) of a text of any shape."""
    def struct(part: Column) -> Column:
        wall, offset = _read(part)
        return F.struct(wall.alias("wall"), offset.alias("offset"))

    return _bound(_iso_parts(c), struct)


def _checked(wall: Column, offset: Column) -> Column:
    known = wall.isNotNull() & F.coalesce(F.abs(offset) < 86400, F.lit(True))
    return F.struct(F.when(known, wall).alias("wall"), F.when(known, offset).alias("offset"),
                    F.when(known, F.timestamp_add("SECOND", -offset, wall)).alias("utc"))


def iso_time(col: Column | str) -> Column:
    """A struct ``(wall, offset, utc)`` of ISO-8601 text: the time as written,
    the seconds its zone is ahead of UTC, and the instant in UTC.

    All are NULL for text of no such shape or with values out of range;
    offset and utc are NULL for text without a zone. No surrounding
    whitespace is taken; a fraction is cut to microseconds. An expression for
    single uses; ``with_iso`` evaluates the same in a plan, once a row.
    """
    c = F.col(col) if isinstance(col, str) else col
    return _bound(_taken_apart(c), lambda t: _checked(t["wall"], t["offset"]))


def settled(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``cols``, each evaluated once a row.

    The optimizer puts the expression of a projected column into every filter
    and projection above that names it; it does not do so with what a
    generator gives, so the columns come from a generator of one row.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in cols.items()])))
    return df.select("*", made.alias("_settled")).select(*[F.col(c) for c in df.columns], "_settled.*")


def with_iso(df: DataFrame, texts: dict[str, Column]) -> DataFrame:
    """``df`` with a struct as of ``iso_time`` for each named text, parsed once a row.

    Text of the common shape (``COMMON_PATTERN``) is cast at once; the other
    shapes are taken apart only where a text has none of it.
    """
    def name(k: int, what: str) -> str:
        return f"_iso{k}_{what}"

    n = range(len(texts))
    at = [F.col(name(k, "text")) for k in n]
    out = df.select("*", *[c.alias(name(k, "text")) for k, c in enumerate(texts.values())])
    out = out.select("*", *[at[k].rlike(COMMON_PATTERN).alias(name(k, "common")) for k in n])
    out = out.select("*", *[F.when(F.col(name(k, "common")), F.when(F.endswith(at[k], F.lit("Z")), F.lit("Z"))
                                   .when(F.substring(at[k], -6, 1).isin("+", "-"), F.substring(at[k], -6, 6))
                                   .otherwise(F.lit(""))).alias(name(k, "zone")) for k in n],
                     # In a lambda, for its size: beside the cast of the common shape, all shapes of some texts are
                     # more than the JVM compiles of one method.
                     *[F.when(~F.col(name(k, "common")), _bound(at[k], _taken_apart)).alias(name(k, "other")) for k in n])
    read = []
    for k in n:
        common, zone, other = (F.col(name(k, c)) for c in ("common", "zone", "other"))
        read += [F.when(common, F.substring(at[k], F.lit(1), F.length(at[k]) - F.length(zone)).try_cast("timestamp_ntz"))
                 .otherwise(other["wall"]).alias(name(k, "wall")),
                 F.when(common, _offset_seconds(zone)).otherwise(other["offset"]).alias(name(k, "offset"))]
    out = out.select(*df.columns, *read)
    made = settled(out, {c: _checked(F.col(name(k, "wall")), F.col(name(k, "offset"))) for k, c in enumerate(texts)})
    return made.select(*df.columns, *texts)


def micros(col: Column | str) -> Column:
    """Wall-clock microseconds since 1970 of a TIMESTAMP_NTZ (zone-free)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MICROSECOND", _epoch(), c.cast("timestamp_ntz"))


def day_of_week_sun0(col: Column | str) -> Column:
    """Day of week with Sunday = 0 .. Saturday = 6 (Spark's dayofweek is 1-based)."""
    return (F.dayofweek(col) - 1).cast("int")


# The characters Python's str.strip() removes, derived from str.isspace().
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def py_strip(col: Column | str) -> Column:
    """Strip leading/trailing whitespace like Python's str.strip (not only
    spaces; no regex)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.btrim(c, F.lit(PY_WHITESPACE))


def non_blank(col: Column | str) -> Column:
    """True when the string is present and not only whitespace; NULL counts as blank."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.length(py_strip(c)) > 0, F.lit(False))


def parse_zoned_utc(col: Column | str, strip: bool = True) -> Column:
    """ISO-8601 text with a zone -> naive UTC wall time (TIMESTAMP_NTZ).

    Text without a zone gives NULL (naive times are rejected, not guessed).
    """
    c = F.col(col) if isinstance(col, str) else col
    return iso_time(py_strip(c) if strip else c)["utc"]


def iso_text(col: Column | str, zone_suffix: str = "", sep: str = "T") -> Column:
    """ISO-8601 text of a naive timestamp, like datetime.isoformat(sep)
    (``sep=" "`` gives str(timestamp))."""
    c = F.col(col) if isinstance(col, str) else col
    full = F.date_format(c, f"yyyy-MM-dd'{sep}'HH:mm:ss.SSSSSS")
    out = F.when(F.endswith(full, F.lit(".000000")), F.substring(full, 1, 19)).otherwise(full)
    return F.concat(out, F.lit(zone_suffix)) if zone_suffix else out


def truthy(col: Column, dtype: T.DataType) -> Column:
    """Python truthiness of a value: non-empty text, non-zero (NaN counts as true)."""
    if isinstance(dtype, T.StringType):
        return F.length(col) > 0
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return (col != 0) | F.isnan(col)
    return col != 0
