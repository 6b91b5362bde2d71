"""What becomes of files that are taken in: why one is skipped, what a note is about, and chunks that replace others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunks as C
from tessera.sources.notes import EXCLUDED_ENDINGS, EXCLUDED_FOLDERS, EXCLUDED_NAMES, SECRET_FOLDERS

MOST_BYTES = 5 * 1024 * 1024
# What folders say their notes are about, words of names that are no names, and endings that are read.
FOLDER_KINDS = {"people": "person", "person": "person", "friends": "person", "family": "person", "contacts": "person", "places": "place", "place": "place", "organizations": "organization", "orgs": "organization", "companies": "organization", "projects": "project", "project": "project", "pets": "pet", "animals": "pet"}
META_WORDS = ["index", "indexes", "template", "templates", "list", "lists", "notes", "note", "misc", "overview", "moc", "map", "archive", "todo", "tmp", "scratch", "scratchpad", "inbox", "birthdays", "contacts", "people", "person", "family", "friends", "readme"]
PROSE_WORDS = ["with", "and", "about", "dealing", "helping", "meeting", "letter", "to", "from", "for", "my", "the", "a", "an", "of", "on", "vs", "re"]
READ_ENDINGS = ["md", "markdown", "txt", "text", "pdf"]


def skip_reason(path: Column, length: Column, hidden: bool = False, most_bytes: int = MOST_BYTES) -> Column:
    """Why a file (its path relative to the folder, its bytes) is not read, or null."""
    parts = F.split(path, "/")
    name, folders = F.element_at(parts, -1), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    among = lambda values, words: F.arrays_overlap(values, F.array(*map(F.lit, words)))
    secret = name.isin(*EXCLUDED_NAMES) | F.lower(name).rlike(r"^\.env|(" + "|".join("\\" + x for x in EXCLUDED_ENDINGS) + ")$")
    concealed = F.exists(parts, lambda p: F.startswith(p, F.lit("."))) if not hidden else F.lit(False)
    return (
        F.when(among(folders, EXCLUDED_FOLDERS), "excluded folder")
        .when(secret, "secret file")
        .when(among(F.transform(parts, lambda p: F.lower(p)), SECRET_FOLDERS), "secret store")
        .when(concealed, "hidden")
        .when(length > most_bytes, "too large")
        .when(~F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).isin(*READ_ENDINGS), "unsupported")
    )


def name_of(stem: Column) -> Column:
    """A file's stem as a name: hyphens and underscores are spaces; words in small letters get a capital."""
    words = F.filter(F.split(F.regexp_replace(stem, r"[-_\s]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) > 1) & (w != F.lower(w)), w).otherwise(F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.lower(F.substr(w, F.lit(2)))))), " ")


def note_routes(notes: DataFrame, own_names: list[str] = ()) -> DataFrame:
    """notes (path, raw) with route, kind and name: an "episode" if the title is a date, an "entity" if a folder says
    what it is about and the title is a name of one, "empty" without words, else "knowledge" (the owner's own notes,
    indexes, and notes about several people or in prose too)."""
    parts = F.split("path", "/")
    stem = F.trim(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))
    folders = F.reverse(F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.lower(p)))
    kinds = F.create_map(*(F.lit(x) for kv in FOLDER_KINDS.items() for x in kv))
    kind = F.get(F.filter(F.transform(folders, lambda p: F.try_element_at(kinds, p)), lambda k: k.isNotNull()), F.lit(0))
    held = notes.select("*", F.inline(F.array(F.struct(kind.alias("_kind"), name_of(stem).alias("_name"), stem.alias("_stem")))))
    words = F.split(F.lower("_name"), " ")
    overlap = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed)))
    own = F.lower("_name").isin(*map(str.lower, own_names)) if own_names else F.lit(False)
    is_one = (F.col("_kind") != "person") | ((F.size(words) <= 2) & ~overlap(PROSE_WORDS))
    entity = F.col("_kind").isNotNull() & (F.col("_name") != "") & ~own & ~overlap(META_WORDS) & is_one
    marked = F.lower("path").rlike(r"\.(md|markdown)$")
    route = F.when(~marked, "knowledge").when(F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\s+", " ")) == "", "empty").when(F.col("_stem").rlike(r"^\d{4}-\d{2}-\d{2}$"), "episode").when(entity, "entity").otherwise("knowledge")
    kept = [c for c in notes.columns if c not in ("route", "kind", "name")]
    return held.withColumn("route", route).select(*kept, "route", F.when(F.col("route") == "entity", F.col("_kind")).alias("kind"), F.when(F.col("route") == "entity", F.col("_name")).alias("name"))


def documents_taken_in(held: DataFrame, documents: DataFrame, on_exists: str = "abort") -> DataFrame:
    """Chunks (document, chunk_index, title, body, breadcrumb, source_ref) after new documents (document, text).

    "replace" drops all former chunks of a document that comes again, and "abort" refuses if any does. Documents
    without words have no chunks; of rows that repeat a document the one with the last text counts."""
    new = documents.groupBy("document").agg(F.max("text").alias("text"))
    if on_exists == "abort" and not held.join(new, "document", "left_semi").isEmpty():
        raise ValueError("some documents are there already")
    rows = C.chunked(new, F.col("text"), F.col("document")).select(*held.columns)
    return held.join(new.select("document"), "document", "left_anti").select(*held.columns).unionByName(rows)
