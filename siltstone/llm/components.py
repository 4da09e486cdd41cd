"""Connected components of an edge table by alternating large and small stars (all on executors)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import join_counted
from .storage import stored


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 with edges (i, j): the smallest node of each one's component."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): every id of ``edges(u, v)`` with the smallest id it is connected to.

    Self-loops, repeated and reversed edges are allowed; edges with a null end are ignored; no edges
    give no rows.  Each round is written to shared scratch, so no lineage grows.
    """

    def clean(e: DataFrame) -> DataFrame:
        return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def settled(e: DataFrame) -> bool:
        """Whether every node has one edge to a root, and no root has one itself."""
        ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("into")))
        return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 OR out + into > 1").isEmpty()

    def least(rows: DataFrame) -> DataFrame:
        """(u, m, n): the least v of each u, and how many rows it has."""
        return stored(rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")

    now, rounds = stored(clean(edges), "edges"), 0
    while not settled(now):
        if rounds == most_rounds:
            raise RuntimeError("components did not settle")
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = least(both).withColumn("m", F.least("u", "m"))
        large = stored(join_counted(both, low, ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large")
        low = least(large)
        small = join_counted(large, low, ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now, rounds = stored(clean(small), "edges"), rounds + 1
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
