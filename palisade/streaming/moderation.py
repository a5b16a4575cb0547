"""Streams: decisions over request streams, the limiter as keyed state, rates in event time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palisade.config import Config
from palisade.operators.signals import assess
from palisade.session import ship


class LimiterState(StatefulProcessor):
    """Times of a client's accepted requests, oldest first; idle clients are forgotten after two windows."""

    def __init__(self, most: int, window_s: float):
        self.most, self.window_s = most, window_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "t double", ttlDurationMs=int(2000 * self.window_s))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [r[0] for r in self.kept.get()] if self.kept.exists() else []
        every = pd.concat(list(rows)).sort_values(["t", "event_id"], kind="stable")
        allowed = []
        for t in every["t"]:
            kept = [x for x in kept if t - x < self.window_s]
            free = len(kept) < self.most
            if free:
                kept.append(t)
            allowed.append(free)
        if kept:
            self.kept.put([(x,) for x in kept])
        else:
            self.kept.clear()
        yield pd.DataFrame({"client": key[0], "event_id": every["event_id"], "t": every["t"], "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limited(events: DataFrame, *, client: str, event_id: str, time: str, config: Config = Config()) -> DataFrame:
    """(client, event_id, t, allowed) of a stream. Needs the RocksDB state store provider."""
    ship(events.sparkSession)
    rows = events.select(F.col(client).cast("string").alias("client"), F.col(event_id).cast("long").alias("event_id"), F.col(time).cast("timestamp").cast("double").alias("t"))
    processor = LimiterState(config.rate_limit_max, config.rate_limit_window_s)
    return rows.groupBy("client").transformWithStateInPandas(processor, "client string, event_id long, t double, allowed boolean", "append", "processingTime")


def decisions(requests: DataFrame, config: Config = Config(), *, text: str = "prompt", rewrite: str | None = None) -> DataFrame:
    """Decisions over a stream of requests; stateless, so it is the batch plan."""
    return assess(requests, text, config, rewrite=rewrite)


def block_rates(decided: DataFrame, time: str, *, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Blocks and requests in event-time windows; rows later than ``late`` are left out."""
    windowed = decided.withWatermark(time, late).groupBy(F.window(time, window).alias("w")).agg(F.count_if(~F.col("allow")).alias("blocks"), F.count("*").alias("n"))
    return windowed.select(F.col("w.start").alias("window_start"), "blocks", "n")


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Hand every micro-batch to a function: the place of logging hooks, and of refreshed lexicons, which are read anew
    with each batch. With ``once`` the stream ends when it has read what is there; a later one goes on from there."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
