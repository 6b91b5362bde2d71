"""Audits and temporal rules. Every rule takes its day as a parameter; a bad or missing date never raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_days(date: Column, as_of: str) -> Column:
    """Whole days from a date to as_of; null where there is no date."""
    return F.datediff(F.lit(as_of).cast("date"), date.cast("date")).cast("long")


def drive_score(significance: Column, high_priority: Column, stake: Column, age: Column, idle: Column, horizon: int = 45) -> Column:
    """(salience + stake + min(2, age / 7)) * max(0, 1 - idle / horizon), to three digits."""
    salience = F.when(significance == "high", 3.0).when(significance == "medium", 2.0).otherwise(1.0) + F.when(high_priority, 1.0).otherwise(0.0)
    tension = F.least(F.lit(2.0), F.greatest(age, F.lit(0)) / 7.0)
    decay = F.greatest(F.lit(0.0), 1.0 - F.greatest(idle, F.lit(0)) / float(horizon))
    return F.round((salience + F.when(stake, 2.0).otherwise(0.0) + tension) * decay, 3)


def standing(hits: Column, total: Column) -> Column:
    """unproven without any, early below three, then reliable, unreliable or mixed by the rate of hits."""
    rate = hits / total
    return F.when(total == 0, "unproven").when(total < 3, "early").when(rate >= 0.7, "reliable").when(rate <= 0.3, "unreliable").otherwise("mixed")


def rate(part: Column, total: Column, digits: int = 3) -> Column:
    """part / total, rounded; 0 without any."""
    return F.coalesce(F.round(F.try_divide(part.cast("double"), total), digits), F.lit(0.0))


def gate(blockers: dict[str, Column]) -> Column:
    """Codes of the blockers that hold, in their order; nulls do not block."""
    return F.array_compact(F.array(*(F.when(condition, code) for code, condition in blockers.items())))


def fingerprints_gone(emitted: DataFrame, found: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Emitted rows whose fingerprint the latest scan no longer finds."""
    return emitted.join(found.select(key), key, "left_anti")


def index_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each key the values at index min(n - 1, int(share * n)) of its sorted values: no interpolation. Equal
    values are counted first, so that a window holds distinct values only."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(*keys)
    placed = counts.withColumns({"_upto": F.sum("_c").over(own.orderBy(value)), "_n": F.sum("_c").over(own)})
    at = lambda share: F.least(F.col("_n") - 1, F.floor(F.lit(share) * F.col("_n")))
    return placed.groupBy(*keys).agg(*(F.min(F.when(F.col("_upto") > at(share), F.col(value))).alias(name) for name, share in shares.items()))


def placed_in(df: DataFrame, key: str, value: str, tie: str) -> DataFrame:
    """df with place, from 0 by value descending and tie within a key, and of, the key's rows. Rows are counted by
    whole numbers of the value first; only rows of one such number are sorted together."""
    rows = df.withColumn("_bucket", F.floor(-F.col(value)))
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    own = Window.partitionBy(key)
    before = counts.withColumns({"_before": F.sum("_c").over(own.orderBy("_bucket")) - F.col("_c"), "of": F.sum("_c").over(own)}).drop("_c")
    inner = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(F.desc(value), F.asc(tie))) - 1
    return rows.withColumn("_inner", inner).join(before, [key, "_bucket"]).withColumn("place", F.col("_before") + F.col("_inner")).drop("_bucket", "_before", "_inner")


def iso_week(date: Column) -> Column:
    """2025-W01 for 2024-12-30."""
    year = F.extract(F.lit("YEAROFWEEK"), date)
    return F.concat(year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(date).cast("string"), 2, "0"))


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").drop("_r")


def grouped_duplicates(df: DataFrame, key: Column, item: str) -> DataFrame:
    """Keys that more than one item has: n, and the least item."""
    return df.groupBy(key.alias("key")).agg(F.count_distinct(item).alias("n"), F.min(item).alias("first")).where("n > 1")


def lineage(levels: list[Column], own: Column) -> Column:
    """The first level that is not blank, in lower case; else the row's own id."""
    usable = [F.when(F.trim(x) != "", F.lower(F.trim(x))) for x in levels]
    return F.coalesce(*usable, own.cast("string"))
