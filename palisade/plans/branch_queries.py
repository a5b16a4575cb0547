"""Queries for what the shipped tables alone don't reach: rarer branches of the signals, sources and sinks by a round trip
through files, image hashes, and streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.functions import text as T
from palisade.operators import images, metrics, signals, terms
from palisade.session import scratch, spread
from palisade.sources import readers
from palisade.streaming import moderation

NOW = datetime(2024, 1, 2, 12, 0, 0)
#: Frequent words of the conversations as terms, so that every part of a score occurs.
SCORING = Config(
    hard_terms=("les", "the"), ambiguous_terms=("des", "und", "with"), ambiguous_weights={"des": 3, "und": 1}, adult_assertions=("de la",),
    adult_guards=("tion",), costume_terms=("heit",), allowlist_patterns=(r"\bet\b", r"\bthat\b"), injections=("dans un", "in the"),
    injection_patterns=(), school_patterns=(r"\b(est|is)\b", r"\b(une|ein)\b"), clusters=(frozenset({"les", "des", "et"}), frozenset({"the", "of", "and"})),
    pending_hard=("euxqu",), pending_ambiguous=("ment", "ung"), pending_weights={"ment": 4}, typo_map={}, keep_spaces=True,
)
#: One-word names of parts, as a lexicon near to them; one is an assertion and so no term of the fuzzy pass.
NAMES = Config(hard_terms=("smallrings", "redwidgets", "hotgeer"), ambiguous_terms=("blubolt", "coldpips"), extra_fuzzy_terms=("smallgizmo", "bluegear"), adult_assertions=("bluegear",))
GRADES = ("1st", "2nd", "3rd", "4th", "5th", "6th", "7th", "8th", "9th", "10th", "11th", "12th")
PLACES = ("middle school", "junior high", "elementary school", "kindergarten", "library")
PENDING = (
    ("hard_terms", "fresh", "2024-01-02T11:00:00", 2, 3), ("hard_terms", "old", "2024-01-01T11:00:00", 2, 2),
    ("ambiguous_terms", "with", "2024-01-02T01:00:00", 4, 2), ("ambiguous_terms", "broken", "not a time", 1, 2),
)
KNOWN = ("and",)
_ASCII = "abcdefghijklmnopqrstuvwxyz"
_WIDE = "".join(chr(ord(c) - 0x20 + 0xFF00) for c in _ASCII)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("cid"), "conv_id", "turn", "role", "text"))


def _sha(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def context_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("text", F.lit(" she is "), (12 + F.col("conv_id") % 10).cast("string"), F.lit(" years old"))
    found = signals.extract(_turns(spark, sf_dir).select("cid", text.alias("text")), "text", SCORING)
    return found.select("cid", signals.context_score(SCORING).alias("score"), F.col("cluster_score").cast("int").alias("cluster"), F.size("hard_terms").alias("hard"), signals.valid_adult_assertion(SCORING).cast("int").alias("valid"))


def school_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("in the "), _pick(GRADES, F.col("p_partkey") % 12), F.lit(" Grade at "), _pick(PLACES, F.col("p_partkey") % 5), F.lit(", say"))
    found = signals.extract(_table(spark, sf_dir, "part").select("p_partkey", text.alias("text")), "text", Config().strict())
    return found.select("p_partkey", F.array_join("school_context", ",").alias("school"))


def spelled_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 1 + F.col("p_partkey") % 99
    words = F.when(n < 20, _pick(T.UNITS, n)).when(n % 10 == 0, _pick(T.TENS, F.floor(n / 10) - 2)).otherwise(F.concat(_pick(T.TENS, F.floor(n / 10) - 2), F.lit(" "), _pick(T.UNITS, n % 10)))
    text = F.concat(F.lit("a person, "), words, F.lit(" years old"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(T.find_ages(text), lambda a: a.cast("string")), ",").alias("ages"))


def wide_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate(F.lower("p_name"), _ASCII, _WIDE)
    return _table(spark, sf_dir, "part").select("p_partkey", T.normalize(wide).alias("n"))


def second_pass_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.decide(signals.extract(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", NAMES), NAMES)
    m = F.get("second_pass", F.lit(0))
    return found.select("p_partkey", "action", m["term"].alias("term"), m["match_type"].alias("match_type"), m["dist"].alias("dist"), F.round(m["sim"], 6).alias("sim"))


def classified_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classifier stands for a model: it reads a text's length, and fails on every fifth length."""

    def classifier(c: Column) -> Column:
        n = F.length(c)
        verdict = F.struct(F.when(n % 3 == 0, "NSFW").when(n % 3 == 1, "LABEL_1").otherwise("SAFE").alias("label"), (n % 10 / 10.0).alias("score"))
        return F.when(n % 5 != 0, verdict)

    longer = F.repeat(F.concat("text", F.lit(" ")), 4)
    df = signals.classified(_turns(spark, sf_dir).select("cid", longer.alias("text")), "text", classifier)
    flagged = signals.model_flag(F.col("verdict"))
    return df.withColumn("heuristic_flag", F.col("cid") % 2 == 0).select("cid", F.coalesce("verdict.label", F.lit("none")).alias("label"), flagged.cast("int").alias("flagged"))


def verbose_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.assess(_turns(spark, sf_dir).select("cid", "text"), "text", verbose=True)
    return out.select("cid", _sha(F.col("normalized_prompt")).alias("normal_sha"), _sha(F.col("squashed")).alias("squashed_sha"))


def decision_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.as_json(signals.assess(_turns(spark, sf_dir).select("cid", "text"), "text"))
    field = lambda path: F.get_json_object("json", path)
    return out.select("cid", field("$.action").alias("action"), field("$.reason").alias("reason"), _sha(field("$.normalized_prompt")).alias("normal_sha"), F.col("json").contains('"rewritten_prompt":null').cast("int").alias("null_kept"), field("$.signals.model.name").alias("model"))


def audit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.operators import audit

    out = signals.assess(_turns(spark, sf_dir).select("cid", "text", F.lit(True).alias("wanted")), "text", rewrite="wanted")
    return audit.audit_rows(out, request_id="cid", prompt="text", timestamp=F.lit(NOW)).drop("timestamp", "rewritten_sha256")


def text_request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "requests")
    rows = _turns(spark, sf_dir).select(F.col("cid").cast("string").alias("id"), F.when(F.col("turn") < 6, F.col("text")).alias("prompt"), F.when(F.col("turn") % 2 == 0, True).alias("do_fun_rewrite"))
    rows.write.json(path)
    read = readers.text_requests(spark, path)
    return read.select("id", _sha(F.coalesce("prompt", F.lit("?"))).alias("prompt_sha"), F.col("do_fun_rewrite").cast("int").alias("rewrite"), F.col("verbose").cast("int").alias("verbose"))


def known_hash_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash list read back: sixteen digits, or a number; a missing list gives the defaults."""
    path = scratch(spark, "hashes")
    keys = _table(spark, sf_dir, "part").select(F.xxhash64("p_partkey").alias("h"), "p_partkey")
    listed = keys.select(F.when(F.col("p_partkey") % 2 == 0, F.upper(T.hex64(F.col("p_partkey")))).otherwise(F.col("p_partkey").cast("string")).alias("k"))
    listed.agg(F.collect_list("k").alias("known_csam_phashes")).write.json(path)  # a list is one JSON value
    missing = readers.known_hashes(spark, f"{path}-missing", ("00000000000000ff",)).select(F.concat(F.lit("default "), "known").alias("known"))
    return readers.known_hashes(spark, path).select("known").unionByName(missing)


def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "feed")
    entries = _turns(spark, sf_dir).select(F.col("cid").cast("string").alias("title"), F.col("role").alias("description"), F.regexp_replace("text", r"\s+", " ").alias("content"))
    entries.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    read = readers.feed_entries(spark, path)
    return read.select("title", "description", _sha(F.col("content")).alias("content_sha"), F.col("feed").contains("palisade-feed").cast("int").alias("named"))


def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    readers.write_metrics(metrics.request_counter(_table(spark, sf_dir, "conversations"), "role"), path)
    readers.write_metrics(metrics.request_counter(_table(spark, sf_dir, "conversations"), "role"), path)  # replaced, not added to
    return spark.read.schema("endpoint string, n long").json(path)


def _feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.candidates(spread(_table(spark, sf_dir, "documents").select("source", "text")), feed="source", content=F.col("text"))


def _refreshed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    before = spark.createDataFrame(list(PENDING), "category string, term string, added string, sources long, weight int")
    known = spark.createDataFrame([(t,) for t in KNOWN], "term string")
    return before, terms.refresh(before, _feed_counts(spark, sf_dir), known, NOW)


def refreshed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refreshed(spark, sf_dir)[1]


def term_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    held, churn = metrics.term_counters(*_refreshed(spark, sf_dir))
    return held.select(F.lit("held").alias("action"), "category", "n").unionByName(churn)


def reloaded_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of one stream: the handler reads the lexicon anew with each, and the second meets a longer one."""
    rows, lexicon, out, state = (scratch(spark, n) for n in ("turns", "lexicon", "hits", "state"))
    turns = _turns(spark, sf_dir).select("cid", "turn", "text")

    def handle(batch: DataFrame, number: int) -> None:
        listed = tuple(sorted(r[0] for r in spark.read.parquet(lexicon).collect()))  # a lexicon, as Config holds it
        batch.select("cid", F.array_join(T.find_terms(F.col("text"), listed), ",").alias("hits")).write.mode("append").parquet(out)

    for words, part in ((("the", "les"), turns.where("turn < 2")), (("the", "les", "und", "des"), turns.where("turn >= 2"))):
        spark.createDataFrame([(w,) for w in words], "term string").write.mode("overwrite").parquet(lexicon)
        part.write.mode("append").parquet(rows)
        stream = spark.readStream.schema(turns.schema).parquet(rows)
        moderation.each_batch(stream, handle, state, once=True).awaitTermination()
    return spark.read.parquet(out)


def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey pictures of 32 x 32 drawn from the vectors, in the columns of Spark's image source."""
    value = lambda e, y, x: F.floor(F.get(e, ((y * 5 + x * 3) % 64).cast("int")).cast("double") * 200 + 128)
    byte = lambda v: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("long")), 2, "0")
    places = F.sequence(F.lit(0), F.lit(1023))
    data = F.unhex(F.array_join(F.transform(places, lambda i: byte(value(F.col("embedding"), F.floor(i / 32), i % 32))), ""))
    side = F.lit(32)
    image = F.struct(side.alias("height"), side.alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), data.alias("data"))
    rows = spread(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", image.alias("image"))
    return images.hash_images(rows).select("vec_id", T.hex64(F.col("phash")).alias("phash"))


def service_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health row, and what a configuration without its keys is refused with."""
    try:
        Config.from_mapping({"hard_terms": [], "pending_terms": {}, "rss_feeds": []})
    except ValueError as e:
        refused = str(e)
    return readers.health(spark).withColumn("refused", F.lit(refused))


def mapped_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms found under a configuration that was read from a mapping, lists, weights and thresholds included."""
    mapping = {
        "hard_terms": ["the", "les"], "ambiguous_youth": ["und"], "ambiguous_youth_weights": {"und": 7}, "adult_assertions": [], "rss_feeds": [], "fuzzy_threshold": 0, "context_threshold": 9,
        "professional_terms": [], "sexual_terms": [], "costume_terms": [], "known_csam_phashes": [], "phash_match_thresh": 3, "pending_terms": {"hard_terms": {"des": {"weight": 5}}},
        "pending_ttl_hours": 1, "pending_confirmation_threshold": 3, "jaccard_thresh": 0.9,
    }
    c = Config.from_mapping(mapping)
    words = T.find_terms(F.col("text"), (*c.hard_terms, *c.ambiguous_terms, *c.pending_hard))
    score = F.lit(c.context_threshold + c.phash_threshold + c.pending_confirmations + c.jaccard_percent + c.pending_weights["des"] + c.ambiguous_weights["und"])
    return _turns(spark, sf_dir).select("cid", F.array_join(words, ",").alias("hits"), score.alias("numbers"))


BRANCH_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    context_scores, school_contexts, spelled_ages, wide_letters, second_pass_parts, classified_conversations,
    verbose_conversations, decision_json, audit_decisions, text_request_files, known_hash_files, feed_files, metric_files,
    refreshed_terms, term_churn, reloaded_terms, image_hashes, service_constants, mapped_config,
)}
