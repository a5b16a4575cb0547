"""Life of candidate terms: counted in feeds, confirmed by several sources, expired by age."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions import text as T
from palisade.functions.patterns import java_pattern

#: Characters of an entry that are read.
ENTRY_CHARS = 4000


def entry_text(*parts: Column) -> Column:
    """Title, description and content joined by blanks, in lower case, to the entry's limit."""
    return F.substring(F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])), 1, ENTRY_CHARS)


def candidates(entries: DataFrame, *, feed: str, content: Column, config: Config = Config(), gate: Column | None = None) -> DataFrame:
    """(term, feed, n): how often each candidate stands in a feed's entries that pass the gate.

    ``gate`` is a classifier's verdict; without one an entry passes if it holds any gate term.
    """
    text = entry_text(content)
    passed = entries.where(T.contains_any(text, config.feed_gate) if gate is None else gate)
    pattern = java_pattern(r"\b(" + "|".join(config.feed_terms) + r")\b", ignore_case=False)
    found = passed.select(F.col(feed).alias("feed"), F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("term"))
    return found.groupBy("term", "feed").agg(F.count("*").alias("n"))


def promote(counts: DataFrame, known: DataFrame, *, config: Config = Config()) -> DataFrame:
    """(term, category, sources, weight) of terms that enough feeds confirm and that ``known`` (term) doesn't hold."""
    confirmed = counts.groupBy("term").agg(F.countDistinct("feed").alias("sources")).where(F.col("sources") >= config.pending_confirmations)
    hard = T.contains_any(F.col("term"), config.feed_hard_markers)
    return confirmed.join(known.select("term").distinct(), "term", "left_anti").select("term", F.when(hard, "hard_terms").otherwise("ambiguous_terms").alias("category"), "sources", F.lit(config.default_weight).alias("weight"))


def unexpired(pending: DataFrame, now: datetime | Column, *, added: str = "added", config: Config = Config()) -> DataFrame:
    """Pending terms not older than their time to live; without a readable time they stay."""
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    since = F.try_to_timestamp(F.col(added).cast("string"))
    return pending.where(since.isNull() | (since >= at - F.expr(f"INTERVAL {config.pending_ttl_hours} HOURS")))


def refresh(pending: DataFrame, counts: DataFrame, known: DataFrame, now: datetime, config: Config = Config()) -> DataFrame:
    """The pending table (category, term, added, sources, weight) after a refresh: the unexpired and the newly confirmed."""
    kept = unexpired(pending, now, config=config).select("category", "term", F.col("added").cast("string").alias("added"), "sources", "weight")
    new = promote(counts, known.select("term").unionByName(kept.select("term")), config=config)
    return kept.unionByName(new.select("category", "term", F.lit(now.isoformat()).alias("added"), F.col("sources").cast("long"), "weight"))
