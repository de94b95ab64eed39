"""Connected components of a link table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spill


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) to (id, class_id): the smallest id of each component.

    Every round takes, for each id, the minimum label among its neighbours and
    then its label's label (pointer jumping); minima are pre-aggregated, so a
    hub with very many links costs one row per map task. Each round's labels are
    written to the shared folder. Stops when a round changes nothing.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    both = spill(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = spill(both.groupBy("u").agg(F.min("v").alias("m"))
                   .select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("id").alias("v"), "label"), "v")
                .groupBy("u").agg(F.min("label").alias("m")))
        step = labels.join(near, F.col("id") == F.col("u")).select(
            "id", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("id").alias("j_id"), F.col("label").alias("j_label"))
        new = spill(step.join(jump, F.col("label") == F.col("j_id"), "left").select(
            "id", "old", F.least("label", F.coalesce("j_label", "label")).alias("label")), "labels")
        if new.filter("label <> old").isEmpty():
            return new.select("id", F.col("label").alias("class_id"))
        labels = new.select("id", "label")


def joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (id, class_id) after further links (a, b): the components of the classes that they join."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    every = classes.join(ends.withColumnRenamed("id", "e_id"), F.col("id") == F.col("e_id"), "full").select(
        F.coalesce("id", "e_id").alias("id"), F.coalesce("class_id", "e_id").alias("class_id"))
    every = spill(every, "classes")
    of = every.select(F.col("id").alias("a"), F.col("class_id").alias("ca"))
    to = every.select(F.col("id").alias("b"), F.col("class_id").alias("cb"))
    met = links.join(of, "a").join(to, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    merged = components(met).withColumnRenamed("class_id", "merged")
    return spill(every.join(merged.withColumnRenamed("id", "m_id"), F.col("class_id") == F.col("m_id"), "left").select(
        "id", F.coalesce("merged", "class_id").alias("class_id")), "classes")
