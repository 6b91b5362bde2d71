"""Records: text files with a fenced JSON head and a body, folders of them, transcripts, and JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of the head that the index keeps as columns; the head itself stays as JSON beside them.
HEAD = "id string, type string, title string, status string, summary string, created string, updated string, significance string, links array<string>, aliases array<string>"
FENCE = r"(?s)^---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n(.*))?$"


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """(path, raw) of all files below a folder; hidden folders are Spark's to leave out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def parse_records(files: DataFrame) -> DataFrame:
    """Add fm (fields of the head), body and error: "no fence", "bad json" or "no object" in place of raising.
    A file without a fence is all body. Null raw text is an empty body."""
    raw = F.coalesce("raw", F.lit(""))
    head = F.regexp_extract(raw, FENCE, 1)
    fenced = raw.rlike(FENCE)
    parsed = files.withColumns({"_head": head, "_fenced": fenced, "fm": F.from_json(head, HEAD)})
    bad = F.try_parse_json("_head").isNull()
    error = F.when(~F.col("_fenced") & F.startswith(raw, F.lit("---")), "no fence").when(F.col("_fenced") & bad, "bad json").when(F.col("_fenced") & ~F.ltrim("_head").startswith("{"), "no object")
    body = F.when(F.col("_fenced"), F.regexp_extract(raw, FENCE, 2)).otherwise(raw)
    return parsed.select("path", "fm", body.alias("body"), error.alias("error"))


def render(head: Column, body: Column) -> Column:
    """The text of a record with this head (a struct)."""
    return F.concat(F.lit("---\n"), F.to_json(head), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def side_tables(records: DataFrame) -> dict[str, DataFrame]:
    """links (source_id, target_id, relationship_type) and entity_aliases (alias, id) of parsed records."""
    good = records.where("error IS NULL AND fm.id IS NOT NULL")
    links = good.select(F.col("fm.id").alias("source_id"), F.explode("fm.links").alias("target_id"), F.lit("related").alias("relationship_type"))
    aliases = good.where("fm.type = 'entity'").select(F.explode("fm.aliases").alias("alias"), F.col("fm.id").alias("id"), "path")
    first = aliases.withColumn("_r", F.row_number().over(Window.partitionBy("alias").orderBy("path", "id"))).where("_r = 1")
    return {"links": links.where("target_id <> ''"), "entity_aliases": first.select("alias", "id")}


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows, and the old ones that no new one replaces."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def refuse_shrinking(old_rows: int, new_rows: int) -> None:
    """A table must not be overwritten by an empty one, nor a large one by less than half of it."""
    if old_rows and (not new_rows or old_rows > 10 and new_rows * 2 < old_rows):
        raise ValueError(f"{new_rows} rows would replace {old_rows}")


def claims_table(records: DataFrame, heading: str = "## Claims") -> DataFrame:
    """Rows of the pipe table under a heading of the body: (path, row, cells), cells by column name. Ragged rows are
    dropped; fewer than three lines are no table."""
    after = F.regexp_extract("body", rf"(?s){heading}\s*\n((?:\|[^\n]*\n?)+)", 1)
    lines = records.select("path", F.filter(F.split(after, "\n"), lambda x: F.startswith(F.trim(x), F.lit("|"))).alias("lines")).where(F.size("lines") >= 3)
    cells = lambda line: F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select("path", cells(F.get("lines", F.lit(0))).alias("names"), F.posexplode(F.slice("lines", 3, F.size("lines"))).alias("row", "line")).withColumn("values", cells(F.col("line")))
    return rows.where(F.size("names") == F.size("values")).select("path", "row", F.map_from_arrays("names", "values").alias("cells"))


def parse_transcripts(files: DataFrame) -> DataFrame:
    """(path, line, conv_id, time, speaker, text) of transcripts: blocks under "## Conversation — HH:MM [id]" with
    lines "SPEAKER: text"; other lines continue the turn before them."""
    lines = files.select("path", F.posexplode(F.split("raw", "\n")).alias("line", "value"))
    header = r"^## Conversation — (\d\d:\d\d)(?: \[([^\]]*)\])?"
    spoken = r"^([A-Z][A-Z0-9_ ]*): ?(.*)$"
    over = Window.partitionBy("path").orderBy("line")
    marked = lines.withColumns({"time": F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 1)), "conv_id": F.when(F.col("value").rlike(header), F.regexp_extract("value", header, 2)), "is_turn": F.col("value").rlike(spoken)})
    marked = marked.withColumns({"block": F.sum(F.col("time").isNotNull().cast("int")).over(over), "turn": F.sum(F.col("is_turn").cast("int")).over(over)})
    marked = marked.withColumns({"t": F.last("time", True).over(over), "c": F.last("conv_id", True).over(over)}).where("turn > 0 AND block > 0 AND time IS NULL")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.when(F.col("is_turn"), F.regexp_extract("value", spoken, 2)).otherwise(F.col("value")).alias("v")))), lambda x: x["v"]), "\n")
    turns = marked.groupBy("path", "block", "turn", "t", "c").agg(F.min("line").alias("line"), F.max(F.when(F.col("is_turn"), F.regexp_extract("value", spoken, 1))).alias("speaker"), F.rtrim(text).alias("text"))
    return turns.where("speaker IS NOT NULL").select("path", "line", F.col("c").alias("conv_id"), F.col("t").alias("time"), "speaker", "text")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; malformed ones are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def plan_ingest(spark: SparkSession, folder: str, excluded: str = r"(?i)\.(exe|dll|so|zip|key|pem)$") -> DataFrame:
    """(path, bytes, sha256, action) of all files below a folder: skipped by name, else to be read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("path").rlike(excluded), "skip").otherwise("read").alias("action"))


def merge_manifest(old: DataFrame, seen: DataFrame) -> DataFrame:
    """The manifest (path, sha256, first_seen, last_seen, status) after a scan (path, sha256, at)."""
    both = old.alias("o").join(seen.alias("s"), "path", "full_outer")
    status = F.when(F.col("s.sha256").isNull(), "missing").when(F.col("o.sha256").isNull(), "new").when(F.col("o.sha256") == F.col("s.sha256"), "unchanged").otherwise("changed")
    return both.select("path", F.coalesce("s.sha256", "o.sha256").alias("sha256"), F.coalesce("o.first_seen", "s.at").alias("first_seen"), F.coalesce("s.at", "o.last_seen").alias("last_seen"), status.alias("status"))
