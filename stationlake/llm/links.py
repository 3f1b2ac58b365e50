"""Connected components of links between keys, without gathering any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationlake.sources.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the component, for every node of (a, b) links.

    Each round every node takes the smallest label among its neighbours' labels and its
    own, then the label of its label, so known stretches double. Rounds end when nothing changes.
    """
    both = staged(
        links.select(F.col("a").alias("node"), F.col("b").alias("other"))
        .unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        .where("node <> other").distinct(),
        "links",
    )
    labels = staged(
        both.groupBy("node").agg(F.min("other").alias("least"))
        .select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        theirs = labels.select(F.col("node").alias("other"), F.col("label").alias("seen"))
        reached = both.join(theirs, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        closer = labels.join(reached, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("label")
        )
        closer = staged(closer, "labels-near")
        further = closer.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        moved = staged(
            closer.join(further, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")
            ),
            "labels",
        )
        if moved.where(F.col("old") != F.col("label")).isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
