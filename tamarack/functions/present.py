"""What results show: highlight ranges, short paths, dates, sizes and counts as text."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPANS = "array<struct<start:int,stop:int>>"


def _is_at(folded: Column, needle: str, place: Column) -> Column:
    return F.substring(folded, place, F.lit(len(needle))) == needle


def _span(size: int, place: Column) -> Column:
    return F.struct((place - 1).cast("int").alias("start"), (place - 1 + size).cast("int").alias("stop"))


def highlights(folded: Column, needles: list[str]) -> Column:
    """Ranges of all hits of the needles; overlapping ranges are merged, touching ones are not."""
    places = F.sequence(F.lit(1), F.greatest(F.length(folded), F.lit(1)))
    hits = [F.transform(F.filter(places, partial(_is_at, folded, n)), partial(_span, len(n))) for n in needles if n]
    if not hits:
        return F.array().cast(_SPANS)

    def merge(out: Column, x: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["stop"], x["stop"]).alias("stop"))
        overlap = F.coalesce(x["start"] < last["stop"], F.lit(False))
        return F.when(overlap, F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(F.array_sort(F.concat(*hits)), F.array().cast(_SPANS), merge)


def in_utf16(text: Column, spans: Column) -> Column:
    """Ranges of characters as ranges of UTF-16 units, of which characters above U+FFFF take two."""
    units = lambda n: n + F.length(F.regexp_replace(F.substring(text, F.lit(1), n), r"[^\x{10000}-\x{10FFFF}]", ""))
    return F.transform(spans, lambda x: F.struct(units(x["start"]).alias("start"), units(x["stop"]).alias("stop")))


def abbreviated(path: Column, home: str) -> Column:
    """The home folder as ~."""
    base = home if home == "/" else home.rstrip("/")
    under = F.lit("/" if base == "/" else base + "/")
    rest = F.substring(path, 1 if base == "/" else len(base) + 1, 2**31 - 1)
    return F.when(path == base, F.lit("~")).when(path.startswith(under), F.concat(F.lit("~"), rest)).otherwise(path)


def date_text(mtime: Column, now: int) -> Column:
    """Today and yesterday with the time, this year as month and day, else the whole date; session time zone."""
    at, today = F.timestamp_seconds(mtime), F.timestamp_seconds(F.lit(now))
    days = F.datediff(today, at)
    clock = F.date_format(at, "HH:mm")
    return (
        F.when(days == 0, F.concat(F.lit("Today "), clock))
        .when(days == 1, F.concat(F.lit("Yesterday "), clock))
        .when(F.year(at) == F.year(today), F.date_format(at, "MMM d"))
        .otherwise(F.date_format(at, "yyyy/M/d"))
    )


def size_text(size: Column) -> Column:
    """Units of 1000 as file lists show them: whole KB, MB to one and GB to two decimals, no trailing zeros."""

    def unit(of: int, digits: int, name: str) -> Column:
        number = F.round(size / of, digits).cast(f"decimal(20,{digits})").cast("string")
        return F.concat(F.regexp_replace(number, r"\.?0+$", "") if digits else number, F.lit(f" {name}"))

    return (
        F.when(size == 0, F.lit("Zero KB"))
        .when(size == 1, F.lit("1 byte"))
        .when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(size < 999_500, unit(1000, 0, "KB"))
        .when(size < 999_950_000, unit(1_000_000, 1, "MB"))
        .otherwise(unit(1_000_000_000, 2, "GB"))
    )


def count_text(n: Column) -> Column:
    return F.format_number(n, 0)
