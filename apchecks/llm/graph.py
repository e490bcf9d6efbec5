"""Connected components by alternating large and small stars, as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    if both_ways:
        out = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        out = edges.select("u", "v")
    least = out.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = out.join(least, "u")
    if both_ways:
        found = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return found.filter(F.col("u") > F.col("v")).distinct()


def _settled(state: DataFrame) -> bool:
    """True when every id has one edge, to an id that has none: then all edges lead to roots."""
    ends = state.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(state.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    counted = ends.groupBy("x").agg(F.sum("out").alias("n"), F.min("out").alias("least"))
    return counted.filter((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """The smallest reachable id (``root``) of every id that some edge (a, b) names and that isn't it.

    Edges may repeat and point either way; loops are ignored. Each round is written to the shared
    folder, so lineage stays short, and replaces the round before; ``edges`` may read the table that
    ``scratch`` holds under ``name``.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(F.col("u") > F.col("v")).distinct()
    state = scratch.save(state, name)
    while not _settled(state):
        state = scratch.save(_stars(_stars(state, True), False), name)
    return state.select(F.col("u").alias("id"), F.col("v").alias("root"))
