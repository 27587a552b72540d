"""Connected components of a graph of links, as DataFrame rounds.

Alternating stars: in a large-star round every node links its larger neighbours to the
least node it knows, in a small-star round its smaller ones. The rounds end when the
links no longer change; each then joins a node to the least node of its component. The
number of rounds grows with the logarithm of the longest chain. Every round is written
to the shared folder, so the plan stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.stages import written


#: Links per task of a round: later rounds have few links and need few tasks.
ROWS_PER_TASK = 50_000


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``links`` (u, v).

    Loops and repeated links change nothing; links with a null end are left out; an empty
    table gives an empty one.
    """
    edges = links.select("u", "v").where(F.col("u") != F.col("v"))
    edges = written(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).distinct(), "links")  # v < u
    before = _fingerprint(edges)
    while before[0]:
        tasks = -(-2 * before[0] // ROWS_PER_TASK)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written: beside a table, the neighbours of a hub are a join that Spark can split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks), "least")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        large = written(large.coalesce(tasks), "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), "low")
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.where(F.col("u") != F.col("v")).distinct().coalesce(tasks), "small-star")
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
