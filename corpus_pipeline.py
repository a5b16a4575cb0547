"""The corpus pipeline: five stages over ``documents``, each by one of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import language_id, ngram_jaccard, packing, suffix_dedup, toxicity
from palisade.session import dropped, persisted

#: Repeated passages of so many bytes are removed: a little under fifty short words.
PASSAGE_BYTES = 200
#: Words whose ids a worker keeps: few, as the workers serve the other stages too.
CACHED_WORDS = 100_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: null texts, texts without letters, confidences below the model's
    threshold."""
    model = language_id.fit(docs)
    return language_id.identify(docs, model).where(~F.col("rejected")).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The model learns from those labels whose documents are still there."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that with the least id, and among different texts under that
    id the one of least hash. Texts without words are in no group and stay; exact repeats of a row, id included, are one
    row. Different texts under one id are judged each by itself. Rows without an id stay."""
    groups = ngram_jaccard.near_duplicates(docs, shingle=ngram_jaccard.SHINGLE, percent=ngram_jaccard.PERCENT).where("doc_id is not null")
    first = groups.where("component is not null and component_id = doc_id").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("m"))
    single = groups.where("component is null").select("doc_id", "text_hash").distinct()
    kept = first.select("m.doc_id", "m.text_hash").unionByName(single)
    kept = kept.select(F.col("doc_id").alias("_palisade_id"), F.col("text_hash").alias("_palisade_hash"))
    own = docs.where("doc_id is not null").withColumns({"_palisade_id": F.col("doc_id").cast("long"), "_palisade_hash": F.xxhash64(F.coalesce("text", F.lit("")))})
    own = own.dropDuplicates(["_palisade_id", "_palisade_hash"]).join(kept, ["_palisade_id", "_palisade_hash"], "left_semi")
    return own.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are removed; documents of which nothing but blanks is left go."""
    out = suffix_dedup.remove_repeats(docs, length=PASSAGE_BYTES)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", changed).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document is packed into sequences of 1024 tokens."""
    return packing.pack(docs, with_ids=False, cached_words=CACHED_WORDS)


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", passage_stage),
    ("best-fit packing", packing_stage),
]

#: The stages' models and set joins have no SQL form; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, persisted(stage(spark, docs, sf_dir))
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
