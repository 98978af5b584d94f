"""Connected components of an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): comp is the least node that edges reach. Only nodes with an edge are listed."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = written(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("comp").alias("m"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("to"))
        up = labels.select(F.col("node").alias("to"), F.col("comp").alias("further"))
        after = written(step.join(up, "to").select("node", "was", F.least("to", "further").alias("comp")))
        labels = after.select("node", "comp")
        if not after.where("was <> comp").limit(1).count():
            return labels
