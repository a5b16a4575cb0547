"""One registered query for each operator, over the whole of the table it is meant for."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions import text as T
from palisade.operators import audit, fuzzy, images, limiter, metrics, terms
from palisade.operators.signals import actions, assess, decide, extract
from palisade.session import spread

Query = Callable[[SparkSession, str], DataFrame]
CONFIG = Config()

#: Texts with characters that the shipped tables lack.
ODD_TEXTS = (
    "  Test   Text   ", "h3ll0 w0rld", "ooOOOoo", "over 18, 18+ 5th 10th", "z​e‍r﻿o", "сlоwn еlаn",
    "ⓘdⓘⓞⓣ", "strōng café", "a b c", "tr@$h $cum 1d10t", "aaaa bbbbb cc", "",
)
AGE_TEXTS = (
    "I am 25 years old", "twenty five year old", "one hundred year old", "40-year-old", "40-year old", "125 years old",
    "one dog five years old", "a hundred years old", "forty  two years old", "age: 12, 9yo", "nothing here", "",
)
NUMBER_TEXTS = ("seventeen", "twenty one", "five", "zero", "two hundred six", "three thousand", "nothing", "hundred", "one million two")
PENDING = (
    ("hard_terms", "fresh", "2024-01-02T11:00:00", 2), ("hard_terms", "old", "2024-01-01T11:00:00", 2),
    ("ambiguous_terms", "edge", "2024-01-01T12:00:00", 2), ("ambiguous_terms", "broken", "not a time", 2),
    ("ambiguous_terms", "missing", None, 2),
)
NOW = datetime(2024, 1, 2, 12, 0, 0)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The columns asked for, in as many partitions as there are cores where the table's files make fewer."""
    return spread(_table(spark, sf_dir, name).select(*columns))


def _values(spark: SparkSession, texts: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "id int, s string")


def _digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize(F.col("text"), CONFIG)
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", n.alias("n")).select("doc_id", _digest(F.col("n")).alias("sha"), F.length("n").cast("long").alias("chars"))


def squash_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.normalize(F.col("text"), CONFIG).alias("n"))
    return n.select("doc_id", _digest(T.squash(F.col("n"))).alias("squashed"), _digest(T.deobfuscate(F.col("n"))).alias("deobfuscated"))


def normalize_odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, ODD_TEXTS).select("id", T.normalize(F.col("s"), CONFIG).alias("n"), T.squash(T.normalize(F.col("s"), CONFIG)).alias("q"), T.fold_homoglyphs(F.col("s"), CONFIG).alias("h"))


def typo_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = T.fix_typos(F.lower("text"), Config(typo_map={"the": "thee", "that": "yonder"}))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", _digest(fixed).alias("sha"))


def rewrite_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = T.rewrite(F.lower("text"), Config(rewrites={"the": "a certain", "and": "plus"}))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", _digest(new).alias("sha"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.find_terms(F.col("text"), (*CONFIG.hard_terms, *CONFIG.ambiguous_terms))
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", found.alias("hits"))


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", F.array_join("hits", ",").alias("hits"))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(F.explode("hits").alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def cross_sentence_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.normalize(F.col("text"), CONFIG).alias("n"))
    found = T.cross_sentence(F.col("n"), CONFIG.hard_terms)
    return n.select("doc_id", F.array_join(found, ",").alias("hits"))


def context_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.search(c, (r"\bthat\b", r"\bdes\b")).cast("int").alias("allowlisted"),
        T.contains_any(F.lower(c), ("tion", "heit")).cast("int").alias("professional"), T.contains_any(F.lower(c), ("with",), True).cast("int").alias("whole_word"),
        F.size(T.find_terms(c, ("that is", "of the", "und"))).alias("injections"),
    )


def ages_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, AGE_TEXTS).select("id", F.array_join(F.transform(T.find_ages(F.col("s"), CONFIG), lambda a: a.cast("string")), ",").alias("ages"))


def ages_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(T.find_ages(F.col("text"), CONFIG)).alias("ages"))


def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, NUMBER_TEXTS).select("id", T.words_to_int(F.col("s")).alias("value"))


def simhash_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", T.hex64(T.simhash(F.lower("text"))).alias("simhash"))


def soundex_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", T.soundex(F.col("p_name")).alias("code"))


def ngrams_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams = T.char_ngrams(F.lower("p_name"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.size(grams).cast("long").alias("grams"), T.jaccard(grams, T.char_ngrams(F.lower("p_type"))).alias("like_type"))


def shingles_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select("item_id", F.size(T.shingles(F.lower("text"))).cast("long").alias("windows"))


def fuzzy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _texts(spark, sf_dir, "documents", "text").select(F.explode(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}]+"))).alias("window")).where("window <> ''")
    lexicon = spark.createDataFrame([(t,) for t in ("clown", "morons", "idiots", "losers", "pathetical", "trasher")], "term string")
    return fuzzy.match_windows(words, lexicon, CONFIG).select("window", "term", "match_type", "dist", F.round("sim", 6).alias("sim"))


def _sign_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", bits.alias("phash"))


def phash_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _sign_hashes(spark, sf_dir)
    known = hashed.where("label = 0").select(T.hex64(F.col("phash")).alias("known"))
    out = images.assess_images(hashed, known, key="vec_id", config=CONFIG)
    return out.select("vec_id", "action", F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("matches"), "min_distance")


def phash_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _sign_hashes(spark, sf_dir)
    known = hashed.where("label = 0").select(T.hex64(F.col("phash")).alias("known"))
    return images.nearest_known(hashed, known, key="vec_id")


def rate_limit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return limiter.rate_limit(events, client="user_id", time="ts", tie="event_id", most=5, window_s=86_400).select("event_id", F.col("allowed").cast("int").alias("allowed"))


def _feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.candidates(_texts(spark, sf_dir, "documents", "source", "text"), feed="source", content=F.col("text"), config=CONFIG)


def feed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feed_counts(spark, sf_dir)


def feed_promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("and",)], "term string")
    return terms.promote(_feed_counts(spark, sf_dir), known, config=CONFIG)


def pending_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = spark.createDataFrame(list(PENDING), "category string, term string, added string, weight int")
    return terms.unexpired(pending, NOW, config=CONFIG).select("category", "term")


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decide(extract(_texts(spark, sf_dir, "documents", "doc_id", "text"), "text", CONFIG), CONFIG)


def decide_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("doc_id", "action", "reason", "severity", "context_score", F.array_join("cross_sentence", ",").alias("cross_sentence"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).groupBy("action", "severity").agg(F.count("*").alias("n"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_decisions(spark, sf_dir))


def metrics_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_severity(_decisions(spark, sf_dir))


def metrics_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_reasons(_decisions(spark, sf_dir), order="doc_id")


def metrics_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.decision_counter(_decisions(spark, sf_dir))


def decide_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the strict mode changes decisions, each row of the table counted once."""
    both = actions(_texts(spark, sf_dir, "documents", "text"), "text", CONFIG)
    return both.groupBy("action", "strict_action").agg(F.count("*").alias("n"))


def assess_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _texts(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("wanted", F.lit(True))
    out = assess(turns, "text", CONFIG, rewrite="wanted")
    return out.select("conv_id", "turn", "action", "reason", _digest(F.coalesce("rewritten_prompt", F.lit(""))).alias("rewritten_sha"))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rate_per_second(_table(spark, sf_dir, "events"), "ts", ["event_type"]).select("window_start", "event_type", "n", F.round("per_second", 9).alias("per_second"))


def event_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ratio_in_windows(_table(spark, sf_dir, "events"), "ts", F.col("value") > 50).select("window_start", "hits", "n", F.round("ratio", 9).alias("ratio"))


def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = _table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("ALLOW").alias("action"), F.lit("r").alias("reason"), F.lit(None).cast("string").alias("rewritten_prompt"))
    return audit.audit_rows(decided, request_id="doc_id", prompt="text", timestamp=F.lit(NOW)).drop("timestamp")


def client_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "10.0.0.1", "1.2.3.4, 5.6.7.8"), (2, "10.0.0.2", None), (3, "10.0.0.3", "")], "id int, host string, forwarded string")
    return rows.select("id", limiter.client_key(F.col("host"), F.col("forwarded"), True).alias("trusted"), limiter.client_key(F.col("host"), F.col("forwarded")).alias("plain"))


def upload_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "image/png", 10), (2, "text/plain", 10), (3, "image/gif", 10_000_001), (4, None, 1)], "id int, kind string, length long")
    return rows.select("id", images.upload_status(F.col("kind"), F.col("length"), CONFIG).alias("status"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    normalize_documents, squash_documents, normalize_odd_texts, typo_conversations, rewrite_conversations, term_hits,
    term_counts, cross_sentence_hits, context_flags, ages_in_texts, ages_in_documents, spelled_numbers, simhash_benchmark,
    soundex_parts, ngrams_parts, shingles_benchmark, fuzzy_windows, phash_matches, phash_nearest, rate_limit_events,
    feed_candidates, feed_promotions, pending_expiry, decide_documents, flagship, metrics_summary,
    metrics_severity, metrics_reasons, metrics_counter, decide_strict, assess_conversations, event_rates, event_ratio,
    audit_documents, client_keys, upload_statuses,
)}
