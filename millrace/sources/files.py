"""Calendars, mailboxes and JSON exports as raw records, by Spark's text reader and built-in functions.

Calendar and mailbox files are read with the line that begins an entry as the record separator, so that a file of any
size is split among tasks and each row is one entry. Nothing is validated here.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalars import domain_of, iso_text, let, strip, text_or, utc_timestamp
from millrace.model import CALENDAR, CRM_IMPORT, DRIFT, EMAIL, PAYLOAD
from millrace.sources.json_arrays import read_json_arrays

_EVENT, _MESSAGE = "BEGIN:VEVENT", "\nFrom "


def with_arrival(rows: DataFrame) -> DataFrame:
    """rows with a number that is unique within the read, if they have none yet. It follows the order of files and entries; it is only stable once written."""
    return rows if "arrival" in rows.columns else rows.withColumn("arrival", F.monotonically_increasing_id())


def raw_row(source: str, natural_key: Column, extra: Column | None = None, drift: Column | None = None, **payload: Column) -> list[Column]:
    """The columns of a raw record but for arrival."""
    none = F.lit(None).cast("map<string,string>") if extra is None else extra
    notes = F.array().cast(DRIFT) if drift is None else drift
    return [F.lit(source).alias("source"), natural_key.alias("natural_key"), *[payload[c].alias(c) for c in PAYLOAD], none.alias("extra"), notes.alias("drift")]


def after_cursor(raw: DataFrame, since: datetime | None) -> DataFrame:
    """Records that happened after the cursor; those without a time that can be read always pass."""
    if since is None:
        return raw
    at = utc_timestamp(F.col("occurred_at"))
    return raw.filter(at.isNull() | (at > F.lit(since).cast("timestamp")))


_PARAMETERS = r'(?:;(?:[^:"]|"[^"]*")*)?'


def _line(text: Column, name: str) -> Column:
    """The first line of a text (of lines that end in a line feed) that begins with the name of a property and ``:`` or ``;``; null if there is none."""
    return F.nullif(F.regexp_extract(text, rf"(?dim)^{name}[;:].*$", 0), F.lit(""))


def _value(line: Column) -> Column:
    value = F.regexp_extract(line, rf"^[^:;]*{_PARAMETERS}:(.*)$", 1)
    return F.when(F.contains(value, F.lit("\\")), F.regexp_replace(F.regexp_replace(value, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")).otherwise(value)


def parse_calendar(entries: DataFrame) -> DataFrame:
    """Raw records of calendar events. entries: value, the text after the line that begins an event.

    Each step is a projection of its own, so that what several columns need is worked out once.
    """
    folded = F.regexp_replace(F.regexp_extract("value", r"(?is)^(.*?)\r?\n?END:VEVENT", 1), r"\r?\n[ \t]", "")
    e = with_arrival(entries.filter(F.col("value").rlike("(?i)END:VEVENT"))).select("arrival", F.replace(folded, F.lit("\r\n"), F.lit("\n")).alias("t"))
    e = e.select("arrival", *[_line(F.col("t"), name).alias(name) for name in ("UID", "SUMMARY", "DESCRIPTION", "DTSTART", "ORGANIZER", "X-ACCOUNT-NAME")])
    line = F.col
    text = lambda name: F.coalesce(_value(line(name)), F.lit(""))
    e = e.select(
        "arrival", line("DTSTART").alias("start"), strip(_value(line("DTSTART"))).alias("at"), line("ORGANIZER").alias("organizer"),
        _value(line("UID")).alias("uid"), text("SUMMARY").alias("summary"), text("DESCRIPTION").alias("description"), text("X-ACCOUNT-NAME").alias("account"),
    )
    at, start = F.col("at"), F.col("start")
    zoned = F.regexp_extract(start, r"(?i);TZID=\"?([^\":;]+)", 1)
    local = F.regexp_replace(at, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})$", "$1-$2-$3 $4:$5:$6")
    instant = F.when(~at.endswith("Z") & start.rlike("(?i);TZID="), F.to_utc_timestamp(local.try_cast("timestamp"), zoned)).otherwise(utc_timestamp(at))
    email = strip(F.regexp_replace(_value(F.col("organizer")), r"(?i)^mailto:", ""))
    name = strip(F.replace(F.regexp_extract("organizer", r'(?i);CN=("[^"]*"|[^;:]*)', 1), F.lit('"'), F.lit("")))
    e = e.select("arrival", "uid", "summary", "description", "account", instant.alias("instant"), F.coalesce(email, F.lit("")).alias("mail"), F.coalesce(name, F.lit("")).alias("name"))
    e = e.withColumn("domain", domain_of(F.col("mail")))
    return e.select(
        "arrival",
        *raw_row(
            CALENDAR, F.col("uid"), kind=F.lit("meeting"), occurred_at=iso_text(F.col("instant")), subject=F.col("summary"), body=F.col("description"),
            contact_email=F.col("mail"), contact_name=F.col("name"), account_name=text_or(F.col("account"), F.col("domain")), account_domain=F.col("domain"),
        ),
    )


def read_calendar(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    return after_cursor(parse_calendar(spark.read.text(path, lineSep=_EVENT)), since)


def mail_time(date: Column) -> Column:
    """The instant of a mail's Date header; null for what is none."""
    plain = F.regexp_replace(strip(date), r"^[A-Za-z]{3,9},?\s*|\s*\(.*\)\s*$", "")
    zone = F.regexp_replace(F.regexp_replace(plain, r"\s(?:GMT|UTC?|Z|-0000)$", " +0000"), r"\s+", " ")
    zone = F.when(zone.rlike(r"[+-]\d{4}$"), zone).otherwise(F.concat(zone, F.lit(" +0000")))
    seconds = F.regexp_replace(zone, r" (\d{1,2}:\d{2}) ", " $1:00 ")
    years = F.regexp_replace(F.regexp_replace(seconds, r"^(\S+ \S+) ([0-6]\d) ", "$1 20$2 "), r"^(\S+ \S+) ([7-9]\d) ", "$1 19$2 ")
    return F.try_to_timestamp(years, F.lit("d MMM yyyy H:mm:ss Z"))


def parse_mailbox(messages: DataFrame) -> DataFrame:
    """Raw records of mails. messages: value, the text of a mail after ``From `` at the start of a line.

    Each step is a projection of its own, so that what several columns need is worked out once.
    """
    m = with_arrival(messages.filter(strip(F.col("value")) != "")).select("arrival", F.regexp_replace("value", r"\r\n", "\n").alias("t"))
    m = m.select("arrival", F.regexp_replace(F.regexp_replace("t", r"^(?:From )?[^\n]*\n", ""), r"\n$", "").alias("t"))
    ends = F.instr("t", "\n\n")
    m = m.select(
        "arrival", F.when(ends > 0, F.substring("t", ends + 2, F.length("t"))).otherwise("").alias("rest"),
        F.regexp_replace(F.when(ends > 0, F.left("t", ends - 1)).otherwise(F.col("t")), r"\n[ \t]+", " ").alias("head"),
    )
    names = ("Message-ID", "From", "Subject", "Date", "X-Account-Name", "Content-Type")
    m = m.select("arrival", "rest", *[_line(F.col("head"), name).alias(name) for name in names])
    header = F.col
    value = lambda name: strip(F.regexp_replace(header(name), r"^[^:]*:", ""))
    m = m.select(
        "arrival", "rest", F.coalesce(value("From"), F.lit("")).alias("given"), value("Message-ID").alias("id"), F.coalesce(value("Subject"), F.lit("")).alias("subject"),
        mail_time(value("Date")).alias("at"), F.coalesce(value("X-Account-Name"), F.lit("")).alias("account"),
        F.regexp_extract(F.coalesce(header("Content-Type"), F.lit("")), r'(?i)multipart/.*boundary="?([^";]+)', 1).alias("edge"),
    )
    given, edge = F.col("given"), F.col("edge")
    named = given.contains("<") & given.contains(">")
    email = F.when(named, strip(F.regexp_extract(given, r"<([^>]*)>", 1))).otherwise(given)
    name = F.when(named, F.regexp_replace(strip(F.substring_index(given, "<", 1)), '^"+|"+$', "")).otherwise(F.lit(""))
    pieces = F.split(F.concat(F.lit("\n"), "rest"), F.concat(F.lit(r"\n--\Q"), edge, F.lit(r"\E(?:--)?[ \t]*(?=\n|$)")))
    joined = let(pieces, lambda p: F.array_join(F.transform(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), lambda x: F.regexp_extract(x, r"(?s)\n\n(.*)$", 1)), "\n"))
    m = m.select("arrival", "id", "subject", "at", "account", email.alias("mail"), name.alias("name"), strip(F.when(edge != "", joined).otherwise(F.col("rest"))).alias("body"))
    m = m.withColumn("domain", domain_of(F.col("mail")))
    return m.select(
        "arrival",
        *raw_row(
            EMAIL, F.col("id"), kind=F.lit("email"), occurred_at=iso_text(F.col("at")), subject=F.col("subject"), body=F.col("body"),
            contact_email=F.col("mail"), contact_name=F.col("name"), account_name=text_or(F.col("account"), F.col("domain")), account_domain=F.col("domain"),
        ),
    )


def read_mailbox(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    return after_cursor(parse_mailbox(spark.read.text(path, lineSep=_MESSAGE)), since)


def json_rows(files: DataFrame) -> DataFrame:
    """The objects of small JSON arrays as text, one row each; arrays hold anything else for nothing, and other texts hold no row. files: value."""
    return files.select(F.explode(F.from_json("value", "array<string>")).alias("value")).filter(F.col("value").rlike(r"^\s*\{"))


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """The JSON objects of files as text, one row each. Files named .jsonl hold one on each line; any other holds an array. Both are split among tasks."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).filter(F.col("value").rlike(r"^\s*\{"))
    return read_json_arrays(spark, path)


def write_json_rows(rows: DataFrame, path: str) -> None:
    """Write JSON texts, one on each line, for read_json_rows(). rows: value; the path should end in .jsonl. Line feeds between tokens become spaces."""
    rows.select(F.regexp_replace("value", r"[\r\n]+", " ").alias("value")).filter("value is not null").write.text(path)


def parse_crm_export(rows: DataFrame) -> DataFrame:
    """Raw records of exported activities. rows: value, the JSON text of an object. A null field reads ``None``, an absent one has its default."""
    keys, bag = F.json_object_keys("value"), F.from_json("value", "map<string,string>")
    own = lambda name, default="": F.when(F.array_contains(keys, name), F.coalesce(bag[name], F.lit("None"))).otherwise(F.lit(default))
    time, email = bag["occurred_at"], own("contact_email")
    at = F.coalesce(iso_text(utc_timestamp(time)), time)
    return with_arrival(rows).select(
        "arrival",
        *raw_row(
            CRM_IMPORT, bag["record_id"], kind=own("kind", "note"), occurred_at=at, subject=own("subject"), body=own("body"), contact_email=email,
            contact_name=own("contact_name"), account_name=text_or(own("account_name"), domain_of(email)), account_domain=text_or(own("account_domain"), domain_of(email)),
        ),
    )


def read_crm_export(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    """An incremental read compares texts, so what cannot be read as a time passes only if it sorts after the cursor."""
    raw = parse_crm_export(read_json_rows(spark, path))
    if since is None:
        return raw
    return raw.filter(F.col("occurred_at").isNull() | (F.col("occurred_at") > iso_text(F.lit(since).cast("timestamp"))))


def read_milestones(spark: SparkSession, path: str) -> DataFrame:
    """Milestones of JSON files, each an array."""
    return parse_milestones(read_json_rows(spark, path))


def parse_milestones(rows: DataFrame) -> DataFrame:
    """Milestones with their depends_on; blank dates are null. rows: value, the JSON text of one."""
    names = ("milestone_key", "name", "account_name", "owner_email", "planned_start", "planned_end", "actual_end", "status")
    found = rows.select(F.from_json("value", ", ".join(f"{n} string" for n in names) + ", depends_on array<string>").alias("m")).select("m.*")
    day = lambda c: F.left(strip(F.col(c)), F.lit(10)).try_cast("date").alias(c)
    empty = lambda c, default="": F.coalesce(c, F.lit(default)).alias(c)
    return found.select(
        "milestone_key", empty("name"), empty("account_name"), empty("owner_email"), day("planned_start"), day("planned_end"), day("actual_end"),
        empty("status", "planned"), F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"),
    )


def calendar_text(events: DataFrame) -> DataFrame:
    """value: each event as the text that read_calendar reads; write it as text. Null fields are left out.

    events: uid, summary, description, location, start, end, organizer_email, organizer_name, account_name.
    """
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.col(c), r"([\\,;])", r"\\$1"), "\n", r"\\n")
    line = lambda head, c: F.concat(F.lit(head), c)
    time = lambda c: F.date_format(c, "yyyyMMdd'T'HHmmss'Z'")
    organizer = F.when(F.col("organizer_email") != "", F.concat(F.lit('ORGANIZER;CN="'), F.coalesce("organizer_name", F.lit("")), F.lit('":mailto:'), "organizer_email"))
    lines = [
        F.lit(_EVENT), line("UID:", escaped("uid")), line("SUMMARY:", escaped("summary")), line("DESCRIPTION:", escaped("description")), line("LOCATION:", escaped("location")),
        line("DTSTART:", time("start")), line("DTEND:", time("end")), organizer, line("X-ACCOUNT-NAME:", escaped("account_name")), F.lit("END:VEVENT"),
    ]
    return events.select(F.concat_ws("\r\n", *lines).alias("value"))


def mailbox_text(mails: DataFrame) -> DataFrame:
    """value: each mail as the text that read_mailbox reads; write it as text. Null fields are left out.

    mails: message_id, from_email, from_name, to, subject, date, body, account_name.
    """
    line = lambda head, c: F.concat(F.lit(head), c)
    sender = F.when(F.coalesce("from_name", F.lit("")) != "", F.concat("from_name", F.lit(" <"), "from_email", F.lit(">"))).otherwise(F.col("from_email"))
    time = F.concat(F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    head = F.concat_ws(
        "\n", F.lit("From MAILER-DAEMON"), line("Message-ID: ", F.col("message_id")), line("From: ", sender), line("To: ", F.col("to")), line("Subject: ", F.col("subject")),
        line("Date: ", time), line("X-Account-Name: ", F.col("account_name")),
    )
    body = F.regexp_replace(F.coalesce("body", F.lit("")), "(?m)^From ", ">From ")
    return mails.select(F.concat(head, F.lit("\n\n"), body, F.lit("\n")).alias("value"))
