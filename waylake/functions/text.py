"""Text, encoding and calendar helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession, functions as F


def snake_case(name: Column) -> Column:
    """'featureTypeCode' as 'feature_type_code'."""
    return F.lower(F.regexp_replace(name, r"(?<=[a-z0-9])([A-Z])", r"_$1"))


def camel_case(name: Column) -> Column:
    """'feature_type_code' as 'featureTypeCode'."""
    joined = F.replace(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    return F.concat(F.lower(F.substring(joined, 1, 1)), F.substring(joined, F.lit(2), F.length(joined)))


def number_or_text(value: Column) -> Column:
    """struct<i,d,s>: the value as a whole number, else as a number, else as text."""
    i, d = value.try_cast("bigint"), value.try_cast("double")
    whole = F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), i)
    return F.struct(whole.alias("i"), F.when(whole.isNull(), d).alias("d"), F.when(whole.isNull() & d.isNull(), value).alias("s"))


def options_list(text: Column) -> Column:
    """'{a, b}' as an array of trimmed options; null stays null."""
    return F.transform(F.split(F.regexp_replace(text, r"[{}\[\]\"]", ""), ","), lambda x: F.trim(x))


def text_array(text: Column) -> Column:
    """'["a","b"]' or '[1,2]' as an array of text."""
    return F.from_json(text, "array<string>")


def version_part(version: Column, n: int) -> Column:
    return F.split_part(version, F.lit("."), F.lit(n)).cast("int")


def bucket_floor(value: Column, size: float) -> Column:
    """The value rounded down to a multiple of the bucket size."""
    return F.floor(value / size) * size


def second_of_day(epoch: Column) -> Column:
    return F.pmod(epoch, F.lit(86400))


def day_schedule(every_s: int) -> Column:
    """All slots of a day, as seconds since midnight."""
    return F.sequence(F.lit(0), F.lit(86400 - every_s), F.lit(every_s))


def epoch_now() -> Column:
    """Seconds since 1970 at the start of the query."""
    return F.unix_timestamp(F.current_timestamp())


def clock_time(epoch: Column, zone: str = "UTC") -> Column:
    """What the clocks of a zone show at an epoch, whatever the session's zone; a double is taken to its whole microsecond."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros, day = (epoch * F.lit(1_000_000).cast("long")).cast("long"), F.lit(86_400_000_000)
    # days apart: an interval holds less than 10^12 seconds
    rest = F.pmod(micros, day)
    days, secs = ((micros - rest) / day).cast("int"), (rest.cast("decimal(18, 0)") / F.lit(1_000_000)).cast("decimal(18, 6)")
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), start + F.make_dt_interval(days=days, secs=secs))


def clock_text(epoch: Column, zone: str = "UTC") -> Column:
    """clock_time() as '2024-03-07 09:05:00'; years beyond 9999 have more digits, without a sign."""
    return F.ltrim(F.date_format(clock_time(epoch, zone), "yyyy-MM-dd HH:mm:ss"), F.lit("+"))


@contextmanager
def session_zone(spark: SparkSession, zone: str) -> Iterator[None]:
    """The session's time zone for a block of code, put back afterwards."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def dated_path(day: Column) -> Column:
    """'2024/03/07' for the folder of a day's export."""
    return F.date_format(day, "yyyy/MM/dd")


def packed_numbers(values: Column) -> Column:
    """An array of whole numbers as base64 text of its big-endian 64-bit words."""
    return F.base64(F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("bigint")), 16, "0")), "")))


def unpacked_numbers(text: Column) -> Column:
    """The numbers of packed_numbers(); both read two's complement."""
    digits = F.hex(F.unbase64(text))
    n = (F.length(digits) / 16).cast("int")

    def word(i: Column) -> Column:
        half = lambda at: F.conv(F.substring(digits, i * 16 + at, F.lit(8)), 16, 10).cast("bigint")
        return F.shiftleft(half(1), 32).bitwiseOR(half(9))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), word)).otherwise(F.array().cast("array<bigint>"))


def without_keys(tags: Column, *keys: str) -> Column:
    """A map without some keys."""
    return F.map_filter(tags, lambda k, _: ~k.isin(*keys))


def merged_when_equal(a: Column, b: Column, key: str) -> Column:
    """Two maps as one where they agree on a key, else the first."""
    return F.when(a[key] == b[key], F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)).otherwise(a)
