"""Dates: parsing with English and local month names, relative texts, epochs, durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strptime directives and their Java patterns.
DIRECTIVES = {"%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%I": "h", "%M": "m", "%S": "s", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE"}

#: Seconds of the units of relative dates.
UNITS = {"second": 1, "sec": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "day": 86400, "week": 604800, "month": 31 * 86400, "mth": 31 * 86400, "yr": 365 * 86400, "year": 365 * 86400, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 365 * 86400}


def java_pattern(strptime: str) -> str:
    """A strptime format as a Java pattern; letters outside directives are quoted."""
    out, i = "", 0
    while i < len(strptime):
        if strptime[i] == "%":
            out += DIRECTIVES[strptime[i : i + 2]]
            i += 2
        else:
            out += f"'{strptime[i]}'" if strptime[i].isalpha() else strptime[i]
            i += 1
    return out


def parsed(text: Column, *formats: str, months: dict[str, str] | None = None) -> Column:
    """The first format that fits; local month names are replaced first."""
    for local, english in (months or {}).items():
        text = F.replace(text, F.lit(local), F.lit(english))
    text = F.trim(text)
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(java_pattern(f))) for f in formats))


def relative(text: Column, now: Column) -> Column:
    """``now`` less "3 days ago"; yesterday, just now; the second day of 1970 for anything else, null for null."""
    text = F.lower(F.trim(text))
    n = F.regexp_extract(text, r"^(\d+) *([a-z]+)", 1)
    unit = F.regexp_replace(F.regexp_extract(text, r"^(\d+) *([a-z]+)", 2), r"(?<=..)s$", "")
    size = reduce(lambda acc, u: F.when(unit == u, UNITS[u]).otherwise(acc), UNITS, F.lit(None).cast("int"))
    ago = F.when(n != "", n.cast("bigint") * size)
    seconds = F.when(text.startswith("yesterday"), 86400).when(text.startswith("just now"), 0).otherwise(ago)
    return F.when(text.isNotNull(), F.coalesce(F.timestamp_seconds(F.unix_timestamp(now) - seconds), F.timestamp_seconds(F.lit(86400))))


def from_milliseconds(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint"))


def from_webkit(us: Column) -> Column:
    """Seconds since 1970 of microseconds since 1601."""
    return us / 1000000 - 11644473600


def defaulted(updated: Column, published: Column, created: Column) -> Column:
    return F.coalesce(updated, published, created)


def two_units(seconds: Column) -> Column:
    """A duration in its two largest units, like ``2 days, 3 hours``."""
    parts, rest = [], seconds
    for name, size in (("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)):
        n = F.floor(rest / size).cast("bigint")
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s").otherwise(""))))
        rest = rest % size
    return F.array_join(F.slice(F.array_compact(F.array(*parts)), 1, 2), ", ")


def iso_loaded(text: Column) -> Column:
    """A dumped date: with fractions, with seconds, or the day alone."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(p)) for p in ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def newer_file(file_time: Column, source_time: Column) -> Column:
    """Whether a file is newer; a source without time of day compares by day."""
    by_day = F.to_date(file_time) > F.to_date(source_time)
    return F.when(F.date_trunc("DAY", source_time) == source_time, by_day).otherwise(file_time > source_time)


def last_update_tags(date: Column) -> Column:
    return F.array(F.concat(F.lit("Last Update Year/Month: "), F.date_format(date, "yyyy/MM")), F.concat(F.lit("Last Update: "), F.date_format(date, "yyyy/MM/dd")))


def clock_parsed(text: Column, form: str) -> Column:
    """A date of a format with ``%p``, whatever the locale calls the halves of a day.

    am and pm are cut out of the text. Twelve-hour clocks (``%I``) count 12 as 0 and
    take 13 to 24-hour values as they are; with ``%H``, pm adds twelve hours to any.
    """
    plain = F.trim(F.regexp_replace(text, "AM|PM|am|pm", ""))
    base = F.try_to_timestamp(plain, F.lit(java_pattern(form.replace("%p", "").replace("%I", "%H").strip())))
    later = F.when(text.rlike("pm|PM"), F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    if "%I" not in form:
        return base + later
    hour = F.hour(base)
    early = F.when(hour == 12, base - F.expr("interval 12 hours")).otherwise(base)
    return F.when(hour.between(1, 12), early + later).otherwise(base)


def script_time(script: Column, shown: Column, *formats: str) -> Column:
    """The seconds of a script's ``Date(milliseconds)``, else the date that is shown without scripts."""
    told = F.regexp_extract(script, r"Date\(([0-9]+)[0-9]{3}\)", 1)
    return F.coalesce(F.timestamp_seconds(F.nullif(told, F.lit("")).cast("bigint")), parsed(shown, *formats))


def mixed(text: Column, now: Column, *formats: str) -> Column:
    """struct<at, form> of "3 days ago" or a date by the first format that fits; ``form`` says which it was, null for none."""
    ago = text.contains("ago")
    forms = [F.when(ago, F.struct(relative(text, now).alias("at"), F.lit("relative").alias("form")))]
    for form in formats:
        at = F.when(~ago, parsed(text, form))
        forms.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(form).alias("form"))))
    return F.coalesce(*forms, F.struct(F.lit(None).cast("timestamp").alias("at"), F.lit(None).cast("string").alias("form")))
