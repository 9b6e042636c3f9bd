"""Row classification: statuses, audiences, owners, payload fields."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from billweave.constants import WAITING_STATUSES


def arrears_status(status: Column) -> Column:
    """Waiting states count as new."""
    return F.when(status.isin(WAITING_STATUSES), "new").otherwise(status)


def clean_status(status: Column) -> Column:
    return F.trim(F.lower(status))


def audience(partner_id: Column, company_id: Column) -> Column:
    """Who an invoice is for."""
    return (
        F.when(partner_id.isNull() & company_id.isNotNull(), "Company Invoice")
        .when(partner_id.isNotNull(), "Partner Invoice")
        .otherwise("Unknown")
    )


def invoice_kind(partner_id: Column, company_id: Column) -> Column:
    """The two-way form of `audience`: neither gives null."""
    return F.when(partner_id.isNull() & company_id.isNotNull(), "company").when(partner_id.isNotNull(), "partner")


def release_status(is_email_sent: Column, approved: Column) -> Column:
    """Release state from the two flags; a null flag that decides leaves it unknown."""
    return (
        F.when(is_email_sent & approved, "Released")
        .when(~is_email_sent & approved, "Held - Approved")
        .when(~is_email_sent & ~approved, "Held - Needs Review")
        .otherwise("Unknown Status")
    )


def release_status_with_void(status: Column, release: Column) -> Column:
    return F.when(status == "Void", "Void").otherwise(release)


def json_text(payload: Column, *path: str) -> Column:
    """A payload field as text. Bad JSON, a missing field and an empty text all give null."""
    return F.nullif(F.get_json_object(payload, ".".join(["$", *path])), F.lit(""))


def json_date(payload: Column, *path: str) -> Column:
    return F.try_to_date(json_text(payload, *path))


def parsed(payload: Column) -> Column:
    """A payload parsed once; what is not valid JSON gives null."""
    return F.try_parse_json(payload)


def field_text(document: Column, *path: str) -> Column:
    """A field of a parsed payload as text; a missing field and an empty text give null."""
    return F.nullif(F.try_variant_get(document, ".".join(["$", *path]), "string"), F.lit(""))


def field_date(document: Column, *path: str) -> Column:
    return F.try_to_date(field_text(document, *path))


def first_match(message: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """The category of the first rule whose pattern occurs in the message; null message gives null."""
    category = F.lit(default)
    for pattern, label in reversed(rules):
        category = F.when(message.rlike(pattern), label).otherwise(category)
    return F.when(message.isNotNull(), category)


def entity_url(base: str, key: Column) -> Column:
    """A link to a record; null key gives null."""
    return F.concat(F.lit(base), key.cast("string"))
