"""Connected components of a table of links, by contraction towards least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.work import written


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every end of the links (a, b): keys are connected if their labels are equal.

    In a round every vertex moves to its least neighbour if that is less, and links between the
    places become the next round's. Keys should be in no order that follows the links (hashes
    are not), so that the rounds are about the logarithm of the longest path. Each round is
    written to the shared folder, and only whether links are left comes to the driver.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = edges.select(F.col("a").alias("key"), F.col("a").alias("label")).limit(0)
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        place = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("key"), F.least("a", "b").alias("place")), "places")
        if first:
            labels, first = place.withColumnRenamed("place", "label"), False
        else:
            moved = labels.join(place.select(F.col("key").alias("label"), "place"), "label", "left")
            labels = moved.select("key", F.coalesce("place", "label").alias("label"))
        ends = edges.join(place.select(F.col("key").alias("a"), F.col("place").alias("pa")), "a").join(place.select(F.col("key").alias("b"), F.col("place").alias("pb")), "b")
        edges = written(ends.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
    return written(labels, "labels")
