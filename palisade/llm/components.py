"""Connected components by label propagation with pointer jumping; every step is a join or a mergeable aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import dropped, persisted


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label, old) for every id in the edges (a, b): the label is the least id that links reach.

    A stored table, for the caller to drop; without edges it is empty. Edges given twice or from an id to itself count
    nothing more; null ids are not expected.

    Labels are written to the shared folder after each round, which cuts the lineage. Labels only fall, and a round in
    which none falls is the last.
    """
    both = persisted(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    stored = persisted(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        labels = stored.select("id", "label")
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        to = labels.select(F.col("id").alias("new"), F.col("label").alias("far"))
        step = persisted(lower.join(to, "new", "left").select("id", F.least("new", F.coalesce("far", "new")).alias("label"), "old"))
        changed = step.where("label < old").limit(1).count()
        dropped(stored)
        stored = step
        if not changed:
            dropped(both)
            return step
