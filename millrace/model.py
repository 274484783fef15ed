"""Names and schemas that the engine's parts share."""

from __future__ import annotations

# The names of sources, decisions, categories and drift notes.
CALENDAR, EMAIL, CRM_IMPORT, TICKETS = "calendar", "email", "crm_import", "tickets"
CRM_CONTACTS, CRM_DEALS = "hubspot_contacts", "hubspot_deals"
SOURCES = (CALENDAR, EMAIL, CRM_IMPORT, TICKETS, CRM_CONTACTS, CRM_DEALS)
CREATED, UNCHANGED, UPDATED, CONFLICT, DEAD = "created", "unchanged", "updated", "conflict_ignored", "dead_letter"
SCHEMA_DRIFT = "schema_drift"
POISON, NO_KEY, EXHAUSTED = "poison", "poison_no_key", "transient_exhausted"
ALIAS_USED, TYPE_COERCED, UNKNOWN_FIELD, MISSING_REQUIRED = "alias_used", "type_coerced", "unknown_field", "missing_required"
CLOSED_STATUSES = ("done", "closed", "resolved", "cancelled")
CLOSED_STAGES = ("closedwon", "closedlost")

KEY = ["source", "natural_key"]
DRIFT = "array<struct<kind:string,field:string,detail:string>>"
#: The texts of a payload, in the order in which they are written.
PAYLOAD = ("kind", "occurred_at", "subject", "body", "contact_email", "contact_name", "account_name", "account_domain")
PAYLOAD_SCHEMA = ", ".join(f"{c} string" for c in PAYLOAD) + f", extra map<string,string>, drift {DRIFT}"
#: What a reader gives. arrival is unique within a run and orders it.
RAW_SCHEMA = f"arrival long, source string, natural_key string, {PAYLOAD_SCHEMA}"

#: The tables of the store.
TABLES = {
    "contacts": "email string, full_name string, created_at timestamp, updated_at timestamp",
    "accounts": "name string, domain string, created_at timestamp, updated_at timestamp",
    "activities": (
        "source string, natural_key string, contact_email string, account_name string, kind string, subject string, body string, "
        "occurred_at timestamp, updated_at timestamp, content_hash string, extra map<string,string>"
    ),
    "ledger": (
        "source string, natural_key string, content_hash string, occurred_at timestamp, version long, "
        "first_synced_at timestamp, last_synced_at timestamp"
    ),
    "cursors": "source string, cursor timestamp, updated_at timestamp",
    "audit": "at timestamp, source string, natural_key string, action string, old_hash string, new_hash string, detail string",
    "dead_letter": (
        "source string, natural_key string, payload_json string, error string, category string, failure_count long, "
        "first_seen_at timestamp, last_seen_at timestamp, resolved boolean"
    ),
    "milestones": (
        "milestone_key string, name string, account_name string, owner_email string, planned_start date, planned_end date, "
        "actual_end date, status string"
    ),
    "milestone_deps": "milestone_key string, depends_on_key string",
    "escalations": (
        "as_of date, milestone_key string, rule_id string, severity string, subject_key string, detail string, created_at timestamp"
    ),
}
