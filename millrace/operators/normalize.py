"""The validation boundary: each raw row gets its canonical columns or the text of its first error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import after_at, content_hash, entries_of, iso_text, plain_hash, plain_json, strip, text_or, utc_timestamp
from millrace.model import NO_KEY, PAYLOAD, POISON, SOURCES


def _quoted(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), c, F.lit("'")), F.lit("None"))


def normalize(raw: DataFrame, sources: tuple[str, ...] | None = SOURCES) -> DataFrame:
    """raw with canonical columns in place of the payload's, occurred (timestamp), content_hash, payload_json and error.

    error is null for a usable row. The checks go in order: the source is known (if ``sources`` is given), the key is
    not blank, occurred_at is there and can be read, the email has an ``@``, and extra, where it comes as the JSON text
    ``extra_json``, is an object. The hash covers the canonical fields and extra, never drift. Columns that
    normalisation does not know are carried along.
    """
    # worked out once in a projection of its own, as the checks and the row both need them
    own = {c: f"_clean_{c}" for c in (*PAYLOAD, "natural_key")}
    raw = raw.withColumns({own[c]: strip(F.coalesce(F.col(c), F.lit(""))) for c in own} | {"_occurred": utc_timestamp(F.col("occurred_at"))})
    columns = [c for c in raw.columns if c not in (*own.values(), "_occurred")]
    clean = {c: F.col(own[c]) for c in PAYLOAD}
    key, email, occurred = F.when(F.col("natural_key").isNotNull(), F.col(own["natural_key"])), clean["contact_email"], F.col("_occurred")
    checks = [
        F.when(F.col(own["natural_key"]) == "", "missing natural key"),
        F.when(F.coalesce("occurred_at", F.lit("")) == "", "missing occurred_at timestamp"),
        F.when(occurred.isNull(), F.concat(F.lit("unparseable occurred_at "), _quoted(F.col("occurred_at")))),
        F.when(~email.contains("@"), F.concat(F.lit("missing or invalid contact_email "), _quoted(email))),
    ]
    if sources is not None:
        known = F.coalesce(F.col("source").isin(*sources), F.lit(False))
        checks.insert(0, F.when(~known, F.concat(F.lit("unknown source "), _quoted(F.col("source")))))
    extra = F.col("extra")
    if "extra_json" in columns:
        kind = F.split(F.expr("schema_of_variant(try_parse_json(extra_json))"), "[<(]")[0]
        given = F.col("extra_json").isNotNull() & ~F.col("extra_json").isin("", "null", "false", "0", "[]", '""')
        checks.append(F.when(given & (F.coalesce(kind, F.lit("")) != "OBJECT"), F.concat(F.lit("extra must be an object, got "), F.lower(kind))))
        extra = F.coalesce(F.from_json("extra_json", "map<string,string>"), extra)
    extra = F.transform_values(F.coalesce(extra, F.create_map().cast("map<string,string>")), lambda _, v: F.coalesce(v, F.lit("")))
    payload = F.to_json(F.struct(*PAYLOAD, *[c for c in ("extra", "extra_json", "drift") if c in columns]))
    more = {
        "kind": text_or(clean["kind"], F.lit("activity")),
        "account_name": text_or(clean["account_name"], after_at(email)),
    }
    canonical = clean | more
    fields = {c: canonical[c] for c in PAYLOAD if c != "occurred_at"}
    staged = raw.select(
        *[c for c in columns if c not in (*PAYLOAD, "natural_key", "extra", "extra_json")],
        F.col("natural_key").alias("raw_key"),
        key.alias("natural_key"),
        payload.alias("payload_json"),
        F.coalesce(*checks).alias("error"),
        occurred.alias("occurred"),
        *[v.alias(c) for c, v in fields.items()],
        extra.alias("extra"),
    )
    named = {c: F.col(c) for c in fields} | {"occurred_at": iso_text(F.col("occurred"))}
    # an account that comes from the email alone is not stripped yet; the texts are a projection of their own, as plain_hash() looks at them more than once
    stripped = named | {"account_name": strip(F.col("account_name"))}
    usable, more = F.col("error").isNull(), F.size("extra") > 0
    staged = staged.withColumn("_json", F.when(usable & ~more, plain_json(**stripped)))
    hashed = F.when(usable, F.when(more, content_hash(entries_of(F.col("extra"), **named))).otherwise(plain_hash(F.col("_json"))))
    return staged.withColumn("content_hash", hashed).drop("_json")


def dead_letters(poison: DataFrame) -> DataFrame:
    """arrival, source, natural_key, payload_json, error and category of rows that have an error.

    A row without a key gets one made of its payload's digest, so that seeing it again finds the same entry.
    """
    keyless = F.coalesce("natural_key", F.lit("")) == ""
    digest = F.left(F.sha2("payload_json", 256), F.lit(16))
    return poison.select(
        "arrival",
        "source",
        F.when(keyless, F.concat(F.coalesce("source", F.lit("")), F.lit(":no-key:"), digest)).otherwise(F.col("natural_key")).alias("natural_key"),
        "payload_json",
        "error",
        F.when(keyless, NO_KEY).otherwise(POISON).alias("category"),
    )
