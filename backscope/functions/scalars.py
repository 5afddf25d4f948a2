"""Scalar helpers as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024


def seconds(a: Column, b: Column) -> Column:
    """Whole seconds from a to b."""
    return F.unix_timestamp(b.cast("timestamp")) - F.unix_timestamp(a.cast("timestamp"))


def half_even(x: Column, digits: int) -> Column:
    return F.bround(x, digits)


def human_bytes(size: Column) -> Column:
    """1024-based units with one digit; bytes below 1 KiB as they are. The digit rounds ties to even."""
    units = ("KB", "MB", "GB", "TB", "PB", "EB")
    out = None
    for k, unit in enumerate(units):
        text = F.format_string(f"%.1f {unit}", F.bround(size.cast("double") / KIB ** (k + 1), 1))
        out = F.when(size < KIB ** (k + 2), text) if out is None else out.when(size < KIB ** (k + 2), text) if k < len(units) - 1 else out.otherwise(text)
    return F.when(size < KIB, F.concat(size.cast("string"), F.lit(" B"))).otherwise(out)


def human_duration(s: Column) -> Column:
    """45s, 3m 20s or 5h 7m, of whole seconds."""
    s = F.floor(s).cast("long")
    text = lambda x: x.cast("string")
    return F.when(s < 60, F.concat(text(s), F.lit("s"))).when(s < 3600, F.concat(text(F.floor(s / 60)), F.lit("m "), text(s % 60), F.lit("s"))).otherwise(F.concat(text(F.floor(s / 3600)), F.lit("h "), text(F.floor(s % 3600 / 60)), F.lit("m")))


def age_label(s: Column) -> Column:
    """Minutes, hours, days, 30-day months or 365-day years."""
    def unit(size: int, mark: str) -> Column:
        return F.concat(F.floor(s / size).cast("string"), F.lit(mark))

    return F.when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).when(s < 30 * 86400, unit(86400, "d")).when(s < 365 * 86400, unit(30 * 86400, "mo")).otherwise(unit(365 * 86400, "y"))


def parsed_size(text: Column) -> Column:
    """Bytes of '100GB', '1.5 TB', '7'; null if it isn't a size."""
    number = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)(?:I?B)?$", 1)
    unit = F.regexp_extract(F.upper(F.trim(text)), r"^([0-9]+(?:\.[0-9]+)?)\s*([KMGTP]?)(?:I?B)?$", 2)
    factor = reduce(lambda w, k: w.when(unit == "KMGTP"[k], float(KIB ** (k + 1))), range(1, 5), F.when(unit == "K", float(KIB))).otherwise(1.0)
    return F.when(number != "", F.floor(number.try_cast("double") * factor)).cast("long")


def parsed_rate(text: Column) -> Column:
    """Bytes a second of '100MB/s'; the number must be whole. Null if it isn't a rate."""
    return F.when(F.trim(text).rlike(r"^[0-9]+\s*[A-Za-z]*(/s|ps)?$"), parsed_size(F.regexp_replace(F.trim(text), r"(/s|ps)$", "")))


def parsed_duration(text: Column) -> Column:
    """Seconds of '30d', '2w', '6m' (30-day months), '1y' (365 days), '12h', '45s'. A text that ends in m is months."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^([0-9]+)", 1).try_cast("long")
    unit = F.regexp_extract(t, r"([a-z])$", 1)
    whole = t.rlike(r"^[0-9]+[smhdwy]$") | t.endswith("m")
    size = F.when(unit == "m", 30 * 86400).when(unit == "s", 1).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 7 * 86400).when(unit == "y", 365 * 86400)
    return F.when(whole, n * size)


#: The accepted layouts of a timestamp.
LAYOUTS = ("yyyy-MM-dd HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")


def parsed_time(text: Column) -> Column:
    """The first layout that fits; null if none does. A doubled offset counts once."""
    t = F.regexp_replace(F.trim(text), r"([+-][0-9]{2}:?[0-9]{2})\s+[+-][0-9]{4}$", "$1")
    t = F.regexp_replace(t, r"(?<=[0-9])\s+([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(layout)) for layout in LAYOUTS])


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


WEEKDAYS = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")


def weekday_number(name: Column) -> Column:
    """0 for Sunday to 6; names and their first three letters; Sunday for anything else."""
    n = F.lower(F.trim(name))
    return reduce(lambda w, k: w.when(n.isin(WEEKDAYS[k], WEEKDAYS[k][:3]), k), range(2, 7), F.when(n.isin("monday", "mon"), 1)).otherwise(0)


def weekday(ts: Column) -> Column:
    return F.dayofweek(ts) - 1


def is_last_day(ts: Column) -> Column:
    return F.to_date(ts) == F.last_day(ts)


def wildcard(text: Column, pattern: str) -> Column:
    """A pattern whose * stand at its ends: prefix, suffix, substring or equality; letters in either case."""
    p, t = pattern.lower(), F.lower(text)
    if p == "*":
        return F.lit(True)
    if len(p) > 1 and p[0] == p[-1] == "*":
        return t.contains(p[1:-1])
    return t.startswith(p[:-1]) if p.endswith("*") else t.endswith(p[1:]) if p.startswith("*") else t == p


def rules(*pairs: tuple[Column, str]) -> Column:
    """The names of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def backoff(base: float, failures: Column, cap: float) -> Column:
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(failures - 1, F.lit(0))), F.lit(float(cap)))


SEVERITIES = ("info", "success", "warning", "error", "critical")


def severity_rank(severity: Column) -> Column:
    return reduce(lambda w, k: w.when(severity == SEVERITIES[k], k), range(1, 5), F.when(severity == "info", 0)).otherwise(0)
