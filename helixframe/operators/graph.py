"""Connected components of a distributed edge list, by alternating large and small stars.

Each step moves every node's larger neighbours to the least node it knows. Edges
are dealt by node once for each star, over as many partitions as they need. In
both stars the least neighbour of a node with very many edges, a hub, is found by
aggregation and broadcast, as there are few hubs: its edges stay spread over all
tasks. Each
step's edges are written to the session's checkpoint folder, which cuts the
lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; a session in one process may leave it unset and gets a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not (spark.conf.get("spark.master", None) or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


HUB = 1_000  # edges of a node that stay together in a task
HUBS = 100_000  # nodes that may have more


def _with_least(pairs: DataFrame, count: int, tasks: int) -> DataFrame:
    """(u, v, least): pairs with the least of u and all its v. count: their number, or more.

    A node of more than HUB pairs finds its least by aggregation, and its pairs stay where
    they are; where all pairs are so many that there could be over HUBS such nodes, the
    limit rises with them.
    """
    limit, least = max(HUB, -(-count // HUBS)), F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
    if count <= limit:
        return pairs.repartition(tasks, "u").withColumn("least", least)
    pairs = written(pairs, "star")
    found = pairs.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n")).filter(F.col("n") > limit)
    hubs = written(found.select("u", F.least("u", "least").alias("least")), "hubs")  # at most count / limit rows
    if hubs.isEmpty():
        return pairs.repartition(tasks, "u").withColumn("least", least)
    rest = pairs.join(F.broadcast(hubs.select("u")), "u", "left_anti").repartition(tasks, "u").withColumn("least", least)
    return pairs.join(F.broadcast(hubs), "u").select("u", "v", "least").unionByName(rest)


def _large_star(edges: DataFrame, count: int, tasks: int) -> DataFrame:
    """(u, v): each larger neighbour u of a node, and the least node v that the node knows."""
    all_ = _with_least(edges.union(edges.select("v", "u")), 2 * count, tasks)
    return all_.filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")


def connected_components(edges: DataFrame, most_steps: int = 60) -> DataFrame:
    """node, component (its least node) for every node of edges (a, b); loops and repeats are allowed."""
    most_tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = written(edges, "edges")
    for _ in range(most_steps):
        count = edges.count()
        tasks = max(1, min(-(-count // 5_000), most_tasks), -(-count // 1_000_000))
        least = _with_least(_large_star(edges, count, tasks), count, tasks)  # a large star's edges, one for each edge at most, go from the larger node to the smaller one
        small = least.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("u", F.col("least").alias("v"))).filter("u <> v")
        edges = written(small.distinct().coalesce(tasks), "edges")  # combined before they are dealt
        # Settled once the edges are stars: each node has one edge down, and no node below has any.
        nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
        if nodes.repartition(tasks, "node").groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down > 0 and up > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
