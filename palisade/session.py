"""Session helpers shared by every operator: code shipping, shared storage, partition sizing."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Bytes of an Arrow batch, where the session doesn't say. By default only rows are counted, 10,000 a batch.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so Python stages can import it; bound their batches."""
    sc = spark.sparkContext
    if spark.conf.get(_ARROW_LIMIT, None) is None:
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    if sc.applicationId in _SHIPPED:
        return spark
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="palisade-ship-")) / "palisade_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    sc.addPyFile(os.path.abspath(target))
    _SHIPPED.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where it is unset, a local session, whose tasks all
    share the driver's disk, gets a folder of its own; any other session is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='palisade-shared-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return (folder if "://" in folder else qualified(spark, folder)).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named; one without a scheme is on the default file system, as for Spark itself."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


@contextmanager
def _shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Delete the shuffle files of what is run inside as soon as each execution ends: its rows are stored by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def heap_released(spark: SparkSession) -> None:
    """Let the driver's JVM collect once it has taken half of its heap. An operator of many steps leaves plans and
    broadcasts behind with each; they are garbage by then, but would be left to pile up until the whole heap is taken."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        runtime.gc()


def persisted(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once, as Parquet, and read them back.

    The files stay until ``dropped`` is given the returned frame.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palisade-{uuid.uuid4().hex}"
    with _shuffles_released(spark):
        df.write.parquet(path)
    heap_released(spark)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._palisade_path = path
    return stored


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/palisade-{name}-{uuid.uuid4().hex}"


def dropped(*frames: DataFrame | None) -> None:
    """Delete the files behind frames that ``persisted`` returned, once nothing reads them any more; others stay."""
    for df in frames:
        if df is not None and (path := vars(df).get("_palisade_path")):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows anew where a scan has fewer partitions than the cluster has cores: few large files, or few row groups,
    would else keep costly projections in a few tasks. A scan of many splits is left as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys) if keys else df.repartition(cores)
