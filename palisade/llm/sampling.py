"""Deterministic splits and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's decimal text leaves 2 modulo 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def per_class(labelled: DataFrame, label: str, key: str, most: int, max_classes: int = 200) -> DataFrame:
    """About ``most`` rows of each class at most, and never over ``most * classes``, chosen by a hash of the key.

    Classes are counted with a mergeable aggregate; the share of a class that is kept is fixed from its count, so that
    no group is gathered. The ``max_classes`` most frequent classes are learned, rarer ones beyond them aren't; so at most
    ``most * max_classes`` rows reach the driver.
    """
    counts = labelled.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_classes).collect()
    if not counts:
        return labelled.limit(0)
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts:
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, 1.1 * most / n))).otherwise(share)
    drawn = labelled.withColumn("_draw", draw).where(F.col("_draw") < share)
    return drawn.orderBy("_draw", key).limit(most * len(counts)).drop("_draw")
