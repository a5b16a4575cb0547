"""Sliding-window request limiter over tables of events: a log of accepted requests for each client.

Rejected requests aren't logged, so a request's fate depends on which ones before it were accepted: a fold, not a window
frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def client_key(host: Column, forwarded: Column, trust_forwarded: bool = False) -> Column:
    """The peer's host, or the first entry of X-Forwarded-For where that header is trusted and given."""
    if not trust_forwarded:
        return host
    first = F.trim(F.split(forwarded, ",")[0])
    return F.when(F.length(first) > 0, first).otherwise(host)


def rate_limit(events: DataFrame, *, client: str, time: str, most: int, window_s: float, tie: str | None = None) -> DataFrame:
    """Add ``allowed`` to every event.

    A client's accepted times that are younger than the window are kept; with ``most`` of them an event is rejected and
    leaves no trace. Events at one time go by ``tie``. A pause of at least a window forgets all that was before, so a
    client's events are first cut at its pauses and only each busy spell is folded: state is a spell's, not a client's
    whole history. Pauses are told from the first and last event of each window-long slot, which are mergeable
    aggregates; a spell's events meet its number in a join that can be split. Null clients are one client; null times are
    rejected and leave no trace.
    """
    seconds = F.col(time).cast("timestamp").cast("double") if dict(events.dtypes)[time].startswith("timestamp") else F.col(time).cast("double")
    base = events.withColumn("_t", seconds)
    timed = base.where("_t is not null").withColumn("_slot", F.floor(F.col("_t") / window_s))
    slots = timed.groupBy(F.col(client).alias("_client"), F.col("_slot").alias("_at")).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    per_client = Window.partitionBy("_client").orderBy("_at")
    pause = F.coalesce(F.col("_first") - F.lag("_last").over(per_client) >= window_s, F.lit(True))
    numbered = slots.withColumn("_pause", pause.cast("long")).withColumn("_spell", F.sum("_pause").over(per_client.rowsBetween(Window.unboundedPreceding, 0)))
    spells = timed.join(numbered.select("_client", "_at", "_spell"), F.col(client).eqNullSafe(F.col("_client")) & (F.col("_slot") == F.col("_at")))
    row = F.struct("_t", *([F.col(tie).alias("_tie")] if tie else []), F.struct(*[F.col(c) for c in events.columns]).alias("_row"))
    grouped = spells.groupBy(client, "_spell").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    state = F.struct(F.array().cast("array<double>").alias("kept"), F.array().cast("array<boolean>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        young = F.filter(s["kept"], lambda x: e["_t"] - x < window_s)
        free = F.size(young) < most
        return F.struct(F.when(free, F.concat(young, F.array(e["_t"]))).otherwise(young).alias("kept"), F.concat(s["out"], F.array(free)).alias("out"))

    folded = grouped.select("rows", F.aggregate("rows", state, step, lambda s: s["out"]).alias("out"))
    zipped = folded.select(F.explode(F.arrays_zip("rows", "out")).alias("z"))
    done = zipped.select(*[F.col(f"z.rows._row.{c}").alias(c) for c in events.columns], F.col("z.out").alias("allowed"))
    return done.unionByName(base.where("_t is null").select(*events.columns, F.lit(False).alias("allowed")))
