"""Resolving drifting JSON objects against a declared contract, as columns made from its fields."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.scalars import ascii_json, let, strip
from millrace.model import ALIAS_USED, DRIFT, MISSING_REQUIRED, TYPE_COERCED, UNKNOWN_FIELD

class Contract(NamedTuple):
    """What is known of an object's fields, each under the name of the column that it becomes."""

    spellings: Mapping[str, tuple[str, ...]]  # by column: the keys that it may have, of which the first that is there counts; the first of all is the declared one
    inside: Mapping[str, tuple[str, ...]]  # by column: where the text is if an object is found; elsewhere an object is taken as it is
    objects: tuple[str, ...]  # the columns whose value is declared to be an object
    needed: tuple[str, ...]  # the columns without which a row is of no use


# The fields of a ticket.
TICKET = Contract(
    spellings={
        "summary": ("summary", "title"),
        "status": ("status", "state"),
        "assignee_email": ("assignee", "assignee_email", "assigneeAccount"),
        "due_date": ("duedate", "due_date", "dueDate"),
        "updated": ("updated", "updated_at", "updatedAt"),
        "milestone_key": ("customfield_milestone", "milestone", "milestone_key"),
        "account_name": ("account", "account_name", "organization"),
    },
    inside={
        "status": ("name", "value", "displayName", "id"),
        "assignee_email": ("emailAddress", "email", "email_address", "name"),
    },
    objects=("assignee_email",),
    needed=("summary", "status", "updated"),
)
KEY_ALIASES = ("key", "issueKey", "issue_key", "id")


def note(kind: str, field: Column | str, detail: Column | str) -> Column:
    lit = lambda c: F.lit(c) if isinstance(c, str) else c
    return F.struct(F.lit(kind).alias("kind"), lit(field).alias("field"), lit(detail).alias("detail"))


def _at(variant: Column, *path: str) -> Column:
    return F.try_variant_get(variant, "$" + "".join(f"['{p}']" for p in path), "string")


def _resolved(held: Column, keys: Column, name: str, contract: Contract) -> Column:
    """A struct of the spelling that is there, the text, and whether the value is an object."""
    inside = contract.inside.get(name, ())

    def read(at: Column) -> Column:
        value = at["value"]
        scalar = strip(F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")))
        texts = [F.nullif(strip(_at(value, p)), F.lit("")) for p in inside]
        text = F.when(at["is_object"], F.coalesce(*texts, F.lit(""))).otherwise(scalar) if texts else scalar
        return F.struct(at["spelt"].alias("spelt"), F.when(at["spelt"].isNull(), "").otherwise(text).alias("text"), at["is_object"].alias("is_object"))

    def found(spelt: Column) -> Column:
        value = F.try_element_at(held, spelt)
        is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
        return let(F.struct(spelt.alias("spelt"), value.alias("value"), is_object.alias("is_object")), read)

    return let(F.try_element_at(F.array_intersect(F.array(*map(F.lit, contract.spellings[name])), keys), F.lit(1)), found).alias(name)


def _notes(name: str, contract: Contract, own: Column) -> list[Column]:
    declared, is_object = contract.spellings[name][0], name in contract.objects
    kind, other = ("object", "scalar") if is_object else ("scalar", "object")
    renamed = F.concat(F.lit("arrived as '"), own["spelt"], F.lit(f"', expected '{declared}'"))
    return [
        F.when(own["spelt"] != declared, note(ALIAS_USED, name, renamed)),
        F.when(own["spelt"].isNotNull() & (own["is_object"] != F.lit(is_object)), note(TYPE_COERCED, name, f"arrived as {other}, contract declares {kind}")),
    ]


def resolve(fields: Column, contract: Contract = TICKET) -> Column:
    """A struct of the fields' texts, unmapped_json, drift and missing, from the JSON text of an object.

    missing is the first needed field that no spelling has; null and empty values are not missing. Fields outside
    the contract stay as sorted JSON. A null, or a text that is no object, has no fields. Scalars that are no text are
    given as JSON writes them. The text is parsed once, and each field looked up once.
    """

    def read(held: Column) -> Column:
        keys = F.coalesce(F.map_keys(held), F.array().cast("array<string>"))
        found = F.struct(keys.alias("_keys"), held.alias("_held"), *[_resolved(held, keys, name, contract) for name in contract.spellings])
        return let(found, made)

    def made(found: Column) -> Column:
        notes = F.filter(F.array(*[n for name in contract.spellings for n in _notes(name, contract, found[name])]), lambda n: n.isNotNull())
        unknown = F.array_sort(F.array_except(found["_keys"], F.array(*[found[name]["spelt"] for name in contract.spellings])))
        lost = [F.when(found[name]["spelt"].isNull(), F.lit(name)) for name in contract.needed]
        values = [found[name]["text"].alias(name) for name in contract.spellings]
        return F.struct(
            *values, _unmapped(found["_held"], unknown).alias("unmapped_json"),
            F.concat(notes.cast(DRIFT), F.transform(unknown, lambda k: note(UNKNOWN_FIELD, k, "field not in the declared contract, kept unmapped")).cast(DRIFT)).alias("drift"),
            F.coalesce(*lost, F.lit(None).cast("string")).alias("missing"),
        )

    return let(F.from_json(fields, "map<string,variant>"), read)


def _unmapped(held: Column, names: Column) -> Column:
    """The named entries as ASCII JSON in their order."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(k)), r"(?s)^\[(.*)\]$", 1)
    pairs = F.transform(names, lambda k: F.concat(quoted(k), F.lit(": "), F.coalesce(F.to_json(F.try_element_at(held, k)), F.lit("null"))))
    text = let(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), lambda t: F.decode(ascii_json(t), "UTF-8"))
    return F.when(F.size(names) == 0, "{}").otherwise(text)


def resolve_key(record: Column, aliases: tuple[str, ...] = KEY_ALIASES) -> Column:
    """A struct of key and drift: the first spelling with a value that is not empty, zero or false."""

    def read(variant: Column) -> Column:
        return let(F.coalesce(*[let(F.coalesce(_at(variant, a), F.lit("")), filled(a)) for a in aliases]), made)

    def filled(spelt: str) -> Callable[[Column], Column]:
        return lambda text: F.when(~text.isin("", "0", "false", "{}", "[]"), F.struct(F.lit(spelt).alias("spelt"), strip(text).alias("key")))

    def made(found: Column) -> Column:
        other = F.concat(F.lit("arrived as '"), found["spelt"], F.lit(f"', expected '{aliases[0]}'"))
        drift = (
            F.when(found.isNull(), F.array(note(MISSING_REQUIRED, "key", "no issue key under any known alias")).cast(DRIFT))
            .when(found["spelt"] == aliases[0], F.array().cast(DRIFT)).otherwise(F.array(note(ALIAS_USED, "key", other)).cast(DRIFT))
        )
        return F.struct(F.coalesce(found["key"], F.lit("")).alias("key"), drift.alias("drift"))

    return let(F.try_parse_json(record), read)
