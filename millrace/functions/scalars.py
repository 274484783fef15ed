"""Columns of texts, times and digests, all of built-in functions. The session's time zone is taken to be UTC."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.model import CLOSED_STAGES, CLOSED_STATUSES

# The white space of Unicode, and the four separators of ASCII.
_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: The spelling that a cast reads as it is; others are taken apart first.
_PLAIN_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$"
#: The spelling of calendars, which one replacement turns into that.
_BASIC_TIME = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?\z"
_ISO_DATE = r"(\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
_ISO_TIME = r"(\d{2}(?::\d{2}(?::\d{2}(?:[.,]\d+)?)?)?|\d{2}(?:\d{2}(?:\d{2}(?:[.,]\d+)?)?)?)"
_ISO_ZONE = r"(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)"
_ISO = f"^{_ISO_DATE}(?:.{_ISO_TIME}{_ISO_ZONE}?)?$"
#: Upper bounds in hours of the age bands; what is older is in the last.
AGE_BANDS = (("under 1h", 1.0), ("1h to 24h", 24.0), ("1d to 7d", 168.0))
OLDEST_BAND, UNKNOWN_BAND = "over 7d", "unknown"
BUCKETS = ("hour", "day")


def strip(c: Column) -> Column:
    """Without the white space (of Unicode) at both ends."""
    return F.trim(c, F.lit(_SPACE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def text_or(c: Column, default: Column) -> Column:
    """c, or the default where it is null or empty."""
    return F.coalesce(F.nullif(c, F.lit("")), default)


def utc_timestamp(c: Column) -> Column:
    """The instant of an ISO 8601 text, taken as UTC where it names no offset; null for any other text.

    Dates may be basic, extended or of a week; a date alone is its midnight.
    """
    basic = F.regexp_replace(c, _BASIC_TIME, "$1-$2-$3 $4:$5:$6Z")
    return F.when(c.rlike(_PLAIN_TIME), c.try_cast("timestamp")).when(c.rlike(_BASIC_TIME), basic.try_cast("timestamp")).otherwise(F.when(c.rlike(_ISO), let(F.regexp_replace(c, _ISO, "$1|$2|$3"), _assembled)))


def _assembled(parts: Column) -> Column:
    """The instant of date, time and offset, parted by bars; the latter two may be empty."""
    part = lambda i: F.split_part(parts, F.lit("|"), F.lit(i))
    date = part(1)
    year, week = F.substring(date, 1, 4), F.regexp_extract(date, r"W(\d{2})", 1)
    day = text_or(F.regexp_extract(date, r"W\d{2}-?(\d)", 1), F.lit("1"))
    monday = F.date_trunc("week", F.concat(year, F.lit("-01-04")).try_cast("timestamp")).cast("date")
    of_week = F.date_add(monday, (week.try_cast("int") - 1) * 7 + day.try_cast("int") - 1)
    sound = (F.weekofyear(of_week) == week.try_cast("int")) & day.between("1", "7")
    plain = F.when(date.contains("W"), F.when(sound, F.date_format(of_week, "yyyy-MM-dd"))).otherwise(
        F.regexp_replace(date, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    )
    digits = F.regexp_replace(F.regexp_replace(part(2), r"[.,].*$", ""), ":", "")
    time = F.regexp_replace(F.rpad(digits, 6, "0"), r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    fraction = F.regexp_replace(F.regexp_extract(part(2), r"[.,]\d+$", 0), ",", ".")
    zone = F.regexp_replace(F.regexp_replace(text_or(part(3), F.lit("Z")), ":", ""), r"([+-]\d{2})(\d{2})(\d{2})?", "$1:$2")
    return F.concat(plain, F.lit(" "), time, F.substring(fraction, 1, 7), zone).try_cast("timestamp")


def iso_text(ts: Column) -> Column:
    """A timestamp as ISO 8601 text of UTC, with microseconds only where there are any."""
    plain = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(F.lit(""))
    return F.concat(plain, micros, F.lit("+00:00"))


def ascii_json(json: Column) -> Column:
    """The bytes of a JSON text in which everything that ASCII does not print is escaped in lower-case hex.

    Escapes of control characters come from Spark in upper case; what is outside ASCII, and DEL, is rewritten by UTF-16 units.
    """
    lowered = json
    for digit in "ABCDEF":  # a backslash that is itself escaped begins no escape
        lowered = F.regexp_replace(lowered, rf"(?<!\\)((?:\\\\)*)\\u00([01]){digit}", rf"$1\\u00$2{digit.lower()}")
    return let(F.when(json.rlike(r"\\u00[01][A-F]"), lowered).otherwise(json), _ascii_bytes)


def _ascii_bytes(json: Column) -> Column:
    units = F.regexp_replace(F.hex(F.encode(json, "UTF-16BE")), "(.{4})", "$1 ")
    marked = F.regexp_replace(units, "(?<![0-9A-F])(?!00[0-6]|007[0-9A-E])(.)(.)(.)(.) ", "5C75<$1><$2><$3><$4>")
    done = F.regexp_replace(F.regexp_replace(marked, "00([0-7].) ", "$1"), "<([0-9])>", "3$1")
    for i, digit in enumerate("ABCDEF"):
        done = F.replace(done, F.lit(f"<{digit}>"), F.lit(f"6{i + 1}"))
    return F.when(json.rlike(r"[^\x00-\x7E]"), F.unhex(done)).otherwise(F.encode(json, "UTF-8"))


def content_hash(entries: Column) -> Column:
    """SHA-256 of the compact JSON object of an array of (k, v), sorted by name; texts are stripped, null is empty."""
    cleaned = F.transform(entries, lambda e: F.struct(e["k"].alias("k"), strip(F.coalesce(e["v"], F.lit(""))).alias("v")))
    return F.sha2(ascii_json(F.to_json(F.map_from_entries(F.array_sort(cleaned)))), 256)


def plain_json(**fields: Column) -> Column:
    """The JSON that content_hash() takes the digest of, for fields that are stripped already and nothing else."""
    return F.to_json(F.struct(*[F.coalesce(fields[k], F.lit("")).alias(k) for k in sorted(fields)]))


def plain_hash(json: Column) -> Column:
    """content_hash() of a plain_json() that is a column of its own. Most texts are ASCII without escapes of control characters, and spared the functions that Spark interprets."""
    ascii_only = (F.octet_length(json) == F.length(json)) & ~json.contains("\x7f") & ~json.contains("\\u00")
    return F.when(ascii_only, F.sha2(json.cast("binary"), 256)).otherwise(F.sha2(ascii_json(json), 256))


def entries_of(extra: Column, prefix: str = "extra.", **fields: Column) -> Column:
    """The (name, text) entries of the named fields and of a map, the names of the latter behind a prefix."""
    own = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in fields.items()])
    more = F.transform(F.map_entries(extra), lambda e: F.struct(F.concat(F.lit(prefix), e["key"]).alias("k"), e["value"].alias("v")))
    return F.concat(own, F.coalesce(more, F.array().cast("array<struct<k:string,v:string>>")))


def after_at(email: Column) -> Column:
    """What stands after the first ``@``; empty if there is none."""
    return F.regexp_extract(email, r"(?s)^[^@]*@(.*)$", 1)


def domain_of(email: Column) -> Column:
    return F.lower(strip(after_at(email)))


def title_case(c: Column) -> Column:
    """Each run of letters with a capital at its head, the rest in lower case."""
    pieces = F.split(c, r"(?<=[^\p{L}])")
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 1 << 30)))), "")


def name_of_email(email: Column) -> Column:
    """A display name made of the local part."""
    return title_case(F.replace(F.substring_index(email, "@", 1), F.lit("."), F.lit(" ")))


def closed_status(status: Column) -> Column:
    return F.lower(strip(status)).isin(*CLOSED_STATUSES)


def closed_stage(stage: Column) -> Column:
    return F.lower(strip(stage)).isin(*CLOSED_STAGES)


def age_hours(then: Column, as_of: Column) -> Column:
    """Hours between two instants, none below zero; null stays null."""
    hours = (F.unix_micros(as_of) - F.unix_micros(then)) / F.lit(3_600_000_000.0)
    return F.when(hours.isNotNull(), F.greatest(F.lit(0.0), hours))


def age_band(hours: Column) -> Column:
    band = F.when(hours.isNull(), UNKNOWN_BAND)
    for label, bound in AGE_BANDS:
        band = band.when(hours < bound, label)
    return band.otherwise(OLDEST_BAND)


def bucket_start(ts: Column, bucket: str = "hour") -> Column:
    """The start of a timestamp's hour or day."""
    if bucket not in BUCKETS:
        raise ValueError(f"unknown bucket {bucket!r}, expected one of {BUCKETS}")
    return F.date_trunc(bucket, ts)


def parse_date(c: Column) -> Column:
    """The date that a text begins with; null for a blank or malformed one."""
    return F.left(strip(c), F.lit(10)).try_cast("date")


def exact_amount(c: Column) -> Column:
    """A decimal of a text; zero where it is no number."""
    return F.coalesce(strip(c).try_cast("decimal(38,10)"), F.lit(0).cast("decimal(38,10)"))


def money_text(amount: Column) -> Column:
    """Two decimals, halves to even."""
    return F.bround(amount, 2).cast("decimal(38,2)").cast("string")


def one_decimal(x: Column) -> Column:
    """A number that is not negative, as text with one decimal. Ties are told from near ties by the exact value of the double; true ones go to even."""
    n = F.round(x * 20)
    off = (n - x * 16) - x * 4  # exact: how far the tie n / 20 lies above x
    half = F.floor(n / 2)
    up = (off < 0) | ((off == 0) & (half % 2 == 1))
    tie = (n % 2 == 1) & (x == n / 20)
    return F.when(x.isNotNull(), F.format_string("%.1f", F.when(tie, (half + up.cast("int")) / 10).otherwise(x)))


def hours_text(hours: Column) -> Column:
    """Hours for people: minutes below one hour, hours below two days, else days."""
    return (
        F.when(hours.isNull(), "unknown")
        .when(hours < 1, F.concat(F.format_string("%.0f", F.rint(hours * 60)), F.lit(" min")))
        .when(hours < 48, F.concat(one_decimal(hours), F.lit(" h")))
        .otherwise(F.concat(one_decimal(hours / 24), F.lit(" d")))
    )


def drift_line(note: Column) -> Column:
    return F.concat(note["kind"], F.lit(": "), note["field"], F.lit(" ("), note["detail"], F.lit(")"))


def backoff_delays(attempts: Column, base: float, factor: float = 2.0, cap: float | None = None) -> Column:
    """The waits between so many attempts, as an array."""
    delay = lambda i: F.lit(base) * F.pow(F.lit(factor), i)
    one = delay if cap is None else lambda i: F.least(F.lit(cap), delay(i))
    none = F.array().cast("array<double>")
    return F.when(attempts > 1, F.transform(F.sequence(F.lit(0), attempts - 2), one)).when(attempts == 1, none)
