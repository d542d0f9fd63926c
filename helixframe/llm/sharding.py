"""Sharding by longest-processing-time scheduling.

Rows with equal texts are one group and stay together. Groups go, largest
first, to the least-loaded shard, which a heap yields. The heap needs few items
however many groups there are. Every group that weighs at least
1/(n_shards * heavy_share) of all bytes is an item, so that there are at most
n_shards * heavy_share of them. The lighter ones are sorted by size, all of them,
and dealt in this order in rounds of n_shards groups; the groups that hold the
same place in the rounds of a block are one item, so that a block is n_shards
items of almost one size, and there are at most `blocks` blocks. Only these
bounded items reach the driver.

Defined results: a null text weighs the row overhead, has CRC 0 and shares the
group of the empty text; repeated rows each get a slot of their own; an empty
table gives an empty result; other columns of the input are not read. Groups of equal
size go in the order of their texts' hashes, equally loaded shards by number. Slots
follow the rows' numbers in the table's partitions. Of a long text only its size and
hashes are kept.
"""

from __future__ import annotations

import heapq
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table, written
from helixframe.operators.relational import numbered


def longest_first(sizes: list[tuple[int, str]], n_shards: int, load: list[int] | None = None) -> dict[str, int]:
    """The shard of each (size, name): by size, then name, each to the least-loaded shard (ties: lowest number); `load` is what shards hold before and is updated."""
    load = [0] * n_shards if load is None else load
    heap = [(held, shard) for shard, held in enumerate(load)]
    heapq.heapify(heap)
    where = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        held, shard = heapq.heappop(heap)
        where[name], load[shard] = shard, held + size
        heapq.heappush(heap, (load[shard], shard))
    return where


def shard(docs: DataFrame, n_shards: int = 24, heavy_share: int = 100, blocks: int = 400, overhead: int = 8, rows_per_rank: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; rows in shards of near equal bytes."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group"),  # two texts of one hash would only travel together
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    heavy = F.col("size") * n_shards * heavy_share >= F.lit(total)
    large = [(r["size"], r["group"]) for r in groups.filter(heavy).collect()]  # at most n_shards * heavy_share rows
    light = numbered(groups.filter(~heavy).select("group", "size", (-F.col("size")).alias("falling")), ["falling", "group"])
    rounds = max(1, -(-(groups.count() - len(large)) // (n_shards * blocks)))  # of a block
    light = light.select("group", "size", F.floor(F.col("ord") / (n_shards * rounds)).alias("block"), F.pmod("ord", F.lit(n_shards)).alias("place"))
    load = [0] * n_shards
    alone = longest_first(large, n_shards, load)
    shared: dict[tuple[int, int], int] = {}
    items = light.groupBy("block", "place").agg(F.sum("size").alias("size")).orderBy("block").collect()  # at most n_shards * blocks rows
    for _, block in groupby(items, key=lambda r: r["block"]):
        shared |= longest_first([(r["size"], (r["block"], r["place"])) for r in block], n_shards, load)
    own = spark.createDataFrame(list(alone.items()), "group long, own int")
    place = spark.createDataFrame([(*k, v) for k, v in shared.items()], "block long, place long, shard int")
    # Groups of many rows are heavy ones as a rule, which a broadcast places; the others meet by hash.
    placed = rows.join(F.broadcast(own), "group", "left")
    dealt = placed.filter("own is null").join(light.join(F.broadcast(place), ["block", "place"]).select("group", "shard"), "group")
    columns = ["doc_id", "size", "text_crc32", "row"]
    placed = written(placed.filter("own is not null").select(*columns, F.col("own").alias("shard")).unionByName(dealt.select(*columns, "shard")), "placed")
    ranks = max(1, -(-n // (n_shards * rows_per_rank)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(ranks)))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row")) - 1
    return (
        placed.withColumn("at", at)
        .join(before, ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
