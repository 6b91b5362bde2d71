"""Fields of a record's JSON head as Column expressions: lists from anything, and values in their usual spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import lexicons as L


def text_of(value: Column) -> Column:
    """A field as text, empty if it is missing."""
    return F.coalesce(value, F.lit(""))


def listed(value: Column) -> Column:
    """A field (text, or the JSON of a list) as a list without empty entries."""
    entries = F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))
    single = F.array(value)
    return F.when(F.startswith(value, F.lit("[")), F.filter(entries, lambda x: F.coalesce(x, F.lit("")) != "")).when(text_of(value) == "", F.array().cast("array<string>")).otherwise(single)


def key_of(value: Column) -> Column:
    """Lower case, with hyphens, underscores and white space as one underscore."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text_of(value)), r"[\s_-]+", " ")), " ", "_")


def _renamed(key: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), key)


def usual(value: Column, field: str) -> Column:
    """The value of a field ("claim_class", "claim_owner", "claim_status", "claim_privacy", "source_type" or
    "sensitivity") in its usual spelling: allowed values stay, other names of them are replaced, the rest (null and
    empty too) becomes the field's default. A class's other names come before its allowed values."""
    allowed, names, default = L.USUAL_VALUES[field]
    key = key_of(value)
    kept = F.when(key.isin(*allowed), key)
    other = _renamed(key, names)
    return F.coalesce(other, kept, F.lit(default)) if field == "claim_class" else F.coalesce(kept, other, F.lit(default))


def state_category(value: Column, summary: Column) -> Column:
    """The category of a state: a known one, another name of one, what the summary's words point to, or null."""
    key, low = key_of(value), F.lower(text_of(summary))
    found = F.coalesce(F.when(key.isin(*L.STATE_TTLS), key), _renamed(key, L.STATE_CATEGORY_NAMES))
    hint = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), category) for category, words in L.STATE_CATEGORY_WORDS))
    return F.coalesce(found, hint)
