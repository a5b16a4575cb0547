"""Sources: text requests, images, known hashes, feeds. Sinks: audit rows, metrics. Batch or stream by the reader given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import Config
from palisade.operators.images import upload_status

VERSION = "0.2.0"
REQUEST_SCHEMA = "id string, prompt string, do_fun_rewrite boolean, verbose boolean"
FEED_SCHEMA = "title string, description string, content string"


def text_requests(spark: SparkSession, path: str, fmt: str = "json", *, stream: bool = False) -> DataFrame:
    """Text requests; requests without a prompt are kept with null, as rows to be refused."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(REQUEST_SCHEMA).format(fmt).load(path).withColumns({"do_fun_rewrite": F.coalesce("do_fun_rewrite", F.lit(False)), "verbose": F.coalesce("verbose", F.lit(False))})


def image_uploads(spark: SparkSession, path: str, config: Config = Config()) -> DataFrame:
    """Files with content_type by their ending and the status of their type and size checks; too large ones aren't read."""
    files = spark.read.format("binaryFile").load(path)
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(ending.isin("jpg", "jpeg"), "image/jpeg").when(ending.isin("png", "webp", "gif"), F.concat(F.lit("image/"), ending)).otherwise("application/octet-stream")
    listed = files.select("path", "length", kind.alias("content_type"))
    return listed.withColumn("status", upload_status(F.col("content_type"), F.col("length"), config))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images; files that aren't images have empty data."""
    return spark.read.format("image").option("dropInvalid", False).load(path)


def known_hashes(spark: SparkSession, path: str, defaults: tuple[str, ...] = ()) -> DataFrame:
    """(known) from a JSON object with the list ``known_csam_phashes``; numbers are read as values of hashes. Without
    that file, or where it isn't such an object, the defaults."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fallback = spark.createDataFrame([(h,) for h in defaults], "known string")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return fallback
    found = _listed_hashes(spark, path)
    return found if defaults == () or found.limit(1).count() else fallback


def _listed_hashes(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "known_csam_phashes array<string>").alias("j"))
    one = raw.select(F.explode("j.known_csam_phashes").alias("known"))
    number = F.expr("try_cast(known as decimal(20,0))")
    return one.select(F.when(F.length("known") == 16, F.lower("known")).when(number.isNotNull(), F.lpad(F.lower(F.hex(F.conv(number.cast("string"), 10, -10).cast("long"))), 16, "0")).alias("known")).where("known is not null")


def feed_entries(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of landed RSS files: (feed, title, description, content); the file's name stands for the feed."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(FEED_SCHEMA).load(path).withColumn("feed", F.col("_metadata.file_path"))


def health(spark: SparkSession) -> DataFrame:
    """One row: the package's status and version."""
    return spark.createDataFrame([("healthy", VERSION)], "status string, version string")


def write_metrics(counts: DataFrame, path: str) -> None:
    """Counter rows, replaced at each run."""
    counts.write.mode("overwrite").json(path)
