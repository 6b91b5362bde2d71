"""Streams: folders that grow, duplicates within a watermark, windows of events, the last-turn rule."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch_folder(spark: SparkSession, folder: str, schema: str, kind: str = "json", per_trigger: int = 20) -> DataFrame:
    """New files of a folder, at most per_trigger in a batch; later batches take what is left over."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", str(per_trigger)).format(kind).load(folder)


def drop_repeats(stream: DataFrame, keys: list[str], time: str = "ts", within: str = "60 minutes") -> DataFrame:
    """Rows whose keys have not been seen within the time: state is kept no longer than that."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(stream: DataFrame, time: str = "ts", size: str = "10 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Events and their sum by window and kind; a row later than the watermark is left out."""
    held = stream.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return held.select(F.col("window.start").alias("start"), by, "n", "total")


def drop_repeated_turns(stream: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """Turns (conv_id, speaker, ts, text) that differ from the last one of their speaker, or come later than the
    gap. State: the last turn of each conversation and speaker, dropped once the watermark is past the gap."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_text, last_ts = state.get if state.exists else (None, 0)
        for part in parts:
            part = part.sort_values("ts")
            kept = []
            for text, ts in zip(part["text"], part["ts"]):
                seconds = int(pd.Timestamp(ts).timestamp())
                kept.append(not (text == last_text and seconds - last_ts <= gap_seconds))
                last_text, last_ts = text, seconds
            yield part[kept]
        state.update((last_text, last_ts))
        state.setTimeoutTimestamp(max((last_ts + gap_seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    columns = "conv_id long, speaker string, ts timestamp, text string"
    rows = stream.select("conv_id", "speaker", "ts", "text").withWatermark("ts", f"{gap_seconds} seconds")
    return rows.groupBy("conv_id", "speaker").applyInPandasWithState(step, columns, "text string, seconds long", "append", "EventTimeTimeout")
