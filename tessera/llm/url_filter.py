"""URL filtering by a broadcast trie over reversed host labels and path segments, longest match first."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (host, path, verdict). A rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: More rules than this are joined, not broadcast: a trie of so many takes some tens of MB.
MAX_BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "host string, path string, rule string, verdict string"


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes are dicts: a label leads on among the reversed host labels; "/" holds the root of the paths of
    the host that ends here. There a segment leads on after its slash, and "" lists (start of the next
    segment, rule, verdict). Of rules with one host and path the first holds."""
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault((label,), {})
        node = node.setdefault("/", {})
        *whole, start = path.split("/")
        for segment in whole:
            node = node.setdefault((segment,), {})
        held = node.setdefault("", [])
        if all(x[0] != start for x in held):
            held.append((start, host + path, verdict))
            held.sort(key=lambda x: -len(x[0]))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or a url without "://"."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].translate(str.maketrans(UPPER, LOWER)), rest[end:]
    return host, rest[: min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))]


def _path_match(node: dict, path: str) -> tuple[str, str] | None:
    found, segments = None, path.split("/")
    for segment in segments:
        for start, rule, verdict in node.get("", ()):
            if segment.startswith(start):
                found = rule, verdict
                break
        node = node.get((segment,))
        if node is None:
            break
    return found


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule with the most host labels that fits, among those the one with the longest path."""
    node, found = trie, None
    for label in reversed(host.split(".")):
        node = node.get((label,))
        if node is None:
            break
        if "/" in node:
            found = _path_match(node["/"], path) or found
    return found


def _by_trie(pages: DataFrame, rules: list[tuple[str, str, str]], default: str, url: str) -> DataFrame:
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(SCHEMA)
    def judged(urls: pd.Series) -> pd.DataFrame:
        rows = []
        for x in urls:
            host, path = split_url(x)
            found = longest_match(trie.value, host, path)
            rows.append((host, path, *(found or (None, default))))
        return pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    both = pages.select(F.struct(*(F.col(c) for c in pages.columns)).alias("row"), judged(url).alias("judged"))
    return both.select(*(F.col("row")[c].alias(c) for c in keep), "judged.*")


def _by_join(pages: DataFrame, rules: DataFrame, default: str, url: str) -> DataFrame:
    """For rule lists without a size bound: every host suffix of a distinct url meets the rules of that host, of
    which there is one for a path; what is found goes back to all pages of the url."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*(F.col(c) for c in pages.columns)).alias("row"), F.col(url).alias("url"))
    rest = F.when(F.locate("://", F.col("url")) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    own = rows.select("url").distinct().withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.toDF("rule_host", "rule_path", "rule_verdict")
    met = own.select("url", "host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    best = met.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct(F.length("rule_host"), F.length("rule_path"))).alias("best"))
    found = own.join(best, "url", "left").select(F.col("url").alias("of"), "host", "path", "best")
    met = rows.join(found, F.col("url").eqNullSafe(F.col("of")), "left")
    return met.select(*(F.col("row")[c].alias(c) for c in keep), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule and verdict to pages; columns of these names are replaced.

    A null url, or one without "://", has an empty host and path; an empty path starts with no rule's path.
    Repeated rows are judged alike; an empty table gives an empty result. Of rules with one host and path the first
    of a list holds, and of a DataFrame the last verdict in the order of letters (block before allow). A rule list
    of at most MAX_BROADCAST_RULES becomes a broadcast trie; a longer one, or a longer DataFrame (host, path,
    verdict), is joined by host suffix with the same result."""
    if isinstance(rules, DataFrame):
        rules = rules.toDF("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        head = rules.limit(MAX_BROADCAST_RULES + 1).collect()
        return _by_join(pages, rules, default, url) if len(head) > MAX_BROADCAST_RULES else _by_trie(pages, [tuple(x) for x in head], default, url)
    first: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        first.setdefault((host, path), verdict)
    listed = [(host, path, verdict) for (host, path), verdict in first.items()]
    if len(listed) > MAX_BROADCAST_RULES:
        return _by_join(pages, pages.sparkSession.createDataFrame(listed, "host string, path string, verdict string"), default, url)
    return _by_trie(pages, listed, default, url)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of pages under RULES."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT u.page_id, arg_max(rhost || rpath, length(rhost) * 1000 + length(rpath)) AS rule, arg_max(rverdict, length(rhost) * 1000 + length(rpath)) AS verdict
      FROM u JOIN rules ON (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath) GROUP BY u.page_id)
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
"""
