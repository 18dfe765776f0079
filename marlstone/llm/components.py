"""Connected components of a table of links, without ever holding them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import written


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): component is the smallest node it reaches.

    Alternates two star contractions, each a grouped minimum joined back to the links, until the links form stars; each
    round is written to the shared folder, and the one before removed. With ``rounds`` it stops after so many: nodes of one component may then have
    different names, each a node of that component. Null ends are ignored; loops give a component of one; no edges give
    no rows.
    """
    current = edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    done = 0
    while rounds is None or done < rounds:
        # Large star: every neighbour above a node is tied to the smallest node around.
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.unionByName(current.where("u = v")).distinct(), "links", (current,))
        # Small star: a node and its neighbours below are tied to the smallest of these.
        least = large.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = large.join(least, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(tied.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        current = written(small.unionByName(large.where("u = v")).distinct(), "links", (large,))
        done += 1
        if rounds is None and _stars(current):
            break
    return current.unionByName(current.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def _stars(links: DataFrame) -> bool:
    """Whether every node above has one link, to a node that is below no other."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))).alias("e")
    return links.where("u <> v").select(ends).groupBy("e.node").agg(F.min("e.root").alias("l"), F.max("e.root").alias("h")).where("l < h").isEmpty()
