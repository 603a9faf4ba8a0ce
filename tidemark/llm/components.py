"""Connected components of a list of links, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(links: DataFrame) -> DataFrame:
    """(item, component): the smallest item that can be reached over ``links`` (a, b).

    Items of any orderable type; links with a null end are ignored, an empty table gives an
    empty one. Each round gives every item the smallest label among its neighbours and then
    that label's own label, so a chain of n links takes about log n rounds. Labels are written to the
    shared folder after each round; only one count per round reaches the driver.
    """
    links = links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label"))
                         .select(F.col("a").alias("item"), "label"), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("item").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("item")).agg(F.min("label").alias("near"))
        )
        nearer = labels.join(near, "item").select("item", F.col("label").alias("was"),
                                                  F.least("label", "near").alias("label"))
        jump = labels.select(F.col("item").alias("label"), F.col("label").alias("further"))
        moved = materialize(nearer.join(jump, "label")
                            .select("item", "was", F.least("label", "further").alias("label")), "labels")
        labels = moved.select("item", "label")
        if moved.filter(F.col("was") != F.col("label")).isEmpty():
            return labels.select("item", F.col("label").alias("component"))
