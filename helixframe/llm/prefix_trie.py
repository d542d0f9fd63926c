"""Prefix tries of conversations: double arrays by shard, and upper nodes merged globally.

A conversation's prefix of d turns is known by a 128-bit digest, the xor of a
digest of each turn and its place, so that the digests of all prefixes are
running xors. A node's weight is the number of turns that stand in it and below,
by aggregation. Nodes of more than `LIGHT` are heavy and make the upper trie;
what hangs below them are shards, each of at most `LIGHT` turns, however many
conversations share an upper node. A shard is one double array: its distinct
turns get dense ids 1 to n, the child of node s by turn c is BASE[s] + c, and
CHECK names its parent; walking each conversation through the arrays counts the
nodes, and one pass back adds up their subtrees.

Heavy nodes gather the shards that hang from them, and then sum up their own
subtrees globally by pointer jumping: each round doubles the distance to the
ancestor that a node reports to, so that the rounds are the logarithm of the
depth. Ids of the conversations that end at a heavy node are joined to strings
in ranges; only these strings go, in order, through a node's digest.

Defined results: turns are ordered by turn (null first), then role and text, of
which null becomes empty; rows without conv_id are no conversation's; ids are
rebuilt from c - c % 5 with the sign of SQL's remainder; repeated rows are turns
of their own; a conversation that nothing is left of ends at the root; an empty
table has no nodes, not even a root; other columns are not read. A long text
goes through its digest alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm.common import table, written
from helixframe.llm.near_dedup import _broadcast, runs
from helixframe.operators.relational import numbered

GROUP = 5  # conversations that share the turns of their first
MOST_SHARED = 9
LIGHT = 512  # turns
BLOCK = 1024  # turns of a conversation that are summed up at once
IDS = 4096  # that are joined to one string


def rebuilt(convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, t1, t2, bytes): the turns of the rebuilt conversations; and (conv_id, length) of all."""
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    rows = convs.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *text)
    ranked = numbered(rows, ["conv_id", "turn", "role", "text"])
    digests = [F.xxhash64(F.lit(k), "role", "text").alias(f"t{k}") for k in (1, 2)]
    ranked = written(ranked.select("conv_id", "ord", *digests, F.octet_length("text").cast("long").alias("bytes")), "turns")
    own = ranked.groupBy("conv_id").agg(F.min("ord").alias("first"), F.count("*").alias("n"))
    base, shared = F.col("conv_id") - F.expr(f"conv_id % {GROUP}"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    own = own.select("conv_id", "first", "n", base.alias("base"), shared.alias("shared"))
    has = own.select(F.col("conv_id").alias("base"), F.least("n", F.lit(MOST_SHARED)).alias("n_base"))
    own = own.join(has, "base", "left").withColumn("taken", F.least("shared", F.coalesce("n_base", F.lit(0)))).drop("n_base")
    own = written(own.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("shared"), F.lit(0))), "conversations")
    placed = ranked.join(own.select("conv_id", "first", "shared", "taken"), "conv_id").withColumn("rank", F.col("ord") - F.col("first") + 1)
    turn = ["t1", "t2", "bytes"]
    after = placed.filter("rank > shared").select("conv_id", (F.col("rank") - F.col("shared") + F.col("taken")).alias("depth"), *turn)
    heads = placed.filter(F.col("rank") < MOST_SHARED).select(F.col("conv_id").alias("base"), F.col("rank").alias("depth"), *turn)
    before = own.select("conv_id", "base", "taken").join(heads, "base").filter("depth <= taken").select("conv_id", "depth", *turn)
    return after.unionByName(before), own.select("conv_id", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, depth, t1, t2, bytes, left (turns after it), k1, k2 (the prefix), p1, p2 (its parent): a row a turn."""
    own = [F.xxhash64(F.lit(k), "depth", "t1", "t2").alias(f"x{k}") for k in (1, 2)]
    rows = written(turns.select("*", *own, F.floor(F.col("depth") / BLOCK).alias("block")), "turn-digests")
    blocks = rows.groupBy("conv_id", "block").agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    begins = blocks.select("conv_id", "block", *(F.coalesce(F.bit_xor(b).over(earlier), zero).alias(b) for b in ("b1", "b2")))
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    done = rows.withColumns({f"r{k}": F.bit_xor(f"x{k}").over(within) for k in (1, 2)}).join(begins, ["conv_id", "block"]).join(convs, "conv_id")
    keys = {f"k{k}": F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)}
    done = done.withColumns(keys).withColumns({f"p{k}": F.col(f"k{k}").bitwiseXOR(F.col(f"x{k}")) for k in (1, 2)})
    return done.select("conv_id", "depth", "t1", "t2", "bytes", (F.col("length") - F.col("depth")).alias("left"), "k1", "k2", "p1", "p2")


class DoubleArray:
    """A trie over labels 1 to n in two arrays: node s has the child t = base[s] + c by label c if check[t] = s. The top is node 0."""

    def __init__(self, paths: list[list[int]]) -> None:
        children: list[dict[int, int]] = [{}]
        for path in paths:
            at = 0
            for label in path:
                if label not in children[at]:
                    children[at][label] = len(children)
                    children.append({})
                at = children[at][label]
        self.base, self.check = [0], [-1]
        place, free = {0: 0}, 1  # of the nodes above; no place before `free` is free
        queue = [0]
        for node in queue:  # breadth first
            if not children[node]:
                continue
            labels = sorted(children[node])
            base = max(0, free - labels[0])
            while any(base + c < len(self.check) and self.check[base + c] != -2 for c in labels):
                base += 1
            room = base + labels[-1] + 1 - len(self.check)
            if room > 0:
                self.base += [0] * room
                self.check += [-2] * room
            self.base[place[node]] = base
            for c in labels:
                place[children[node][c]] = base + c
                self.check[base + c] = place[node]
                queue.append(children[node][c])
            while free < len(self.check) and self.check[free] != -2:
                free += 1
        self.order = [place[x] for x in queue]  # parents first

    def walk(self, path: list[int]) -> Iterator[int]:
        at = 0
        for c in path:
            to = self.base[at] + c
            if to >= len(self.check) or self.check[to] != at:
                raise KeyError(c)
            at = to
            yield at


def shard_nodes(conv: np.ndarray, depth: np.ndarray, label: np.ndarray, size: np.ndarray) -> list[tuple]:
    """conv_id, depth, parent's conv_id (null at the shard's top), n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of a shard.

    The rows are sorted by conversation and depth; label is a turn's dense id, size its bytes.
    """
    cut = np.flatnonzero(np.diff(conv)) + 1
    paths = [x.tolist() for x in np.split(label, cut)]
    ids, tops, sizes = [int(x[0]) for x in np.split(conv, cut)], int(depth[0]), [x.tolist() for x in np.split(size, cut)]
    trie = DoubleArray(paths)
    n = len(trie.check)
    convs, least, high, own, children, leaves, saved = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    ends: dict[int, list[int]] = {}
    for c, path, bytes_ in zip(ids, paths, sizes, strict=True):  # ascending, so that the first is the least
        at = 0
        for k, at in enumerate(trie.walk(path)):
            if not convs[at]:
                least[at], high[at], own[at] = c, tops + k, bytes_[k]
            convs[at] += 1
        ends.setdefault(at, []).append(c)
    out = []
    for at in reversed(trie.order[1:]):
        up = trie.check[at]
        leaves[at] = leaves[at] or 1
        saved[at] += (convs[at] - 1) * own[at]
        children[up], leaves[up], saved[up] = children[up] + 1, leaves[up] + leaves[at], saved[up] + saved[at]
        text = ",".join(map(str, ends.get(at, ())))
        out.append((least[at], high[at], least[up] if up else None, convs[at], children[at], leaves[at], saved[at], hashlib.sha256(text.encode()).hexdigest()))
    return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def shards(light: DataFrame) -> DataFrame:
    """The nodes of all shards (s1, s2), with p1 and p2, the heavy node that a shard's top hangs from."""
    names = [x.split()[0] for x in NODE.split(", ")] + ["p1", "p2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["s1", "s2"]):
            made: list[tuple] = []
            conv, depth, size, t1, t2, p1, p2 = (t.column(c).to_numpy() for c in ("conv_id", "depth", "bytes", "t1", "t2", "p1", "p2"))
            ends = np.append(at[at < t.num_rows], t.num_rows).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                turn = np.stack([t1[a:b], t2[a:b]], 1).copy().view("i8,i8").ravel()
                label = np.unique(turn, return_inverse=True)[1] + 1
                up = (int(p1[a]), int(p2[a]))
                made += [(*row, *(up if row[2] is None else (None, None))) for row in shard_nodes(conv[a:b], depth[a:b], label, size[a:b])]
            kinds = [pa.int64()] * 7 + [pa.string()] + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

    by = ["s1", "s2"]
    return light.repartition(*by).sortWithinPartitions(*by, "conv_id", "depth").mapInArrow(run, f"{NODE}, p1 long, p2 long")


def digests(ends: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the ids (conv_id) that end at each node."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, conv = (batch.column(c).to_numpy() for c in ("k1", "k2", "conv_id"))
            new = np.flatnonzero((np.diff(k1) != 0) | (np.diff(k2) != 0)) + 1
            cut = np.unique(np.concatenate([[0], new, np.arange(0, len(conv), IDS)]))
            texts = [",".join(map(str, x.tolist())) for x in np.split(conv, cut[1:])] if len(conv) else []
            cut = cut if len(conv) else cut[:0]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cut]), pa.array(k2[cut]), pa.array(conv[cut]), pa.array(texts, pa.string())], ["k1", "k2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
                if key != (k1, k2):
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (k1, k2), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["k1", "k2", "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([digest.hexdigest()])], ["k1", "k2", "ends_sha256"])

    strings = ends.select("k1", "k2", "conv_id").repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(joined, "k1 long, k2 long, first long, ids string")
    return strings.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes (k1, k2, p1, p2, depth, values) with each value summed over the subtree, by pointer jumping."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    now = nodes.select("k1", "k2", F.col("p1").alias("a1"), F.col("p2").alias("a2"), *values)
    for _ in range(int(deepest).bit_length()):
        below = now.filter("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(*(F.sum(v).alias(f"__{v}") for v in values))
        up = now.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        grown = now.join(below, ["k1", "k2"], "left").join(up, ["a1", "a2"], "left")
        now = written(grown.select("k1", "k2", F.col("n1").alias("a1"), F.col("n2").alias("a2"), *((F.col(v) + F.coalesce(f"__{v}", F.lit(0))).alias(v) for v in values)), "jumps")
    return nodes.drop(*values).join(now.drop("a1", "a2"), ["k1", "k2"])


def _sha(ids: Column) -> Column:
    return F.coalesce(ids, F.lit(hashlib.sha256(b"").hexdigest()))


def nodes(convs: DataFrame, light: int = LIGHT) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations, the root included."""
    turns, members = rebuilt(convs)
    every = written(prefixes(turns, members), "prefixes")
    key, none = ["k1", "k2"], F.lit(None).cast("long")
    same = [F.min(c).alias(c) for c in ("depth", "bytes", "p1", "p2")]  # equal in all rows of a node
    counted = every.groupBy(*key).agg(F.sum(F.col("left") + 1).alias("weight"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), *same)
    root = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("k1"), zero.alias("k2"), "n_convs", "conv_id", zero.alias("depth"), zero.alias("bytes"), none.alias("p1"), none.alias("p2"))
    upper = written(counted.filter(F.col("weight") > light).drop("weight").unionByName(root), "upper-nodes")
    flagged = every.join(_broadcast(upper.select(*key, F.lit(True).alias("heavy"))), key, "left")
    below = Window.partitionBy("conv_id").orderBy("depth")  # at most `light` turns of a conversation
    tops = {f"s{k}": F.first(f"k{k}").over(below) for k in (1, 2)}
    lower = written(shards(flagged.filter("heavy is null").withColumns(tops).select("s1", "s2", "conv_id", "depth", "bytes", "t1", "t2", "p1", "p2")), "shard-nodes")
    # What hangs from each heavy node: shards, and heavy nodes.
    hung = lower.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("s_n"), F.sum("n_leaves").alias("s_leaves"), F.sum("saved_tokens").alias("s_saved"))
    kids = upper.filter("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("u_n"))
    valued = upper.join(hung, key, "left").join(kids, key, "left").na.fill(0, ["s_n", "s_leaves", "s_saved", "u_n"])
    valued = valued.withColumns({"n_children": F.col("s_n") + F.col("u_n"), "n_leaves": F.when(F.col("s_n") + F.col("u_n") == 0, 1).otherwise(F.col("s_leaves")), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes") + F.col("s_saved")})
    summed = subtree_sums(written(valued.drop("s_n", "s_leaves", "s_saved", "u_n"), "upper-values"), ["n_leaves", "saved_tokens"])
    last = flagged.filter("heavy and left = 0").select(*key, "conv_id").union(members.filter("length = 0").select(zero, zero, "conv_id"))
    name = _broadcast(upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above")))
    columns = [x.split()[0] for x in NODE.split(", ")]
    high = summed.join(digests(last), key, "left").join(name, ["p1", "p2"], "left").withColumns({"parent_conv_id": F.col("above"), "ends_sha256": _sha(F.col("ends_sha256"))}).select(*columns)
    low = lower.join(name, ["p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)
    return high.union(low)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(table(spark, sf_dir, "conversations"))


# CRC-32 of the ASCII text s, bit by bit (polynomial 0xEDB88320).
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(s, ''), lambda c: ascii(c)::BIGINT)), lambda x, c: list_reduce(list_prepend(xor(x, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"

ORACLE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {MOST_SHARED} AS h, n
  FROM (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, count(*) AS n FROM turns GROUP BY 1)
), convs AS (
  SELECT o.conv_id, o.base, o.h, least(o.h, coalesce(b.n, 0)) AS taken FROM own o LEFT JOIN own b ON b.conv_id = o.base
), rebuilt AS (
  SELECT c.conv_id, t.rank AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.rank <= c.h
  UNION ALL
  SELECT c.conv_id, t.rank - c.h + c.taken, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.rank > c.h
), paths AS (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(md5(concat(md5(role), md5(text))), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs
), nodes AS (
  SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256,
         left(path, greatest(length(path) - 32, 0)) AS above
  FROM paths GROUP BY path
), kids AS (
  SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.above = n.path
), sums AS (
  SELECT a.path, sum(b.saved) AS saved, count(*) FILTER (WHERE b.n_children = 0) AS leaves FROM counted a JOIN counted b ON starts_with(b.path, a.path) GROUP BY 1
)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, c.n_convs, c.n_children,
       CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s ON s.path = c.path LEFT JOIN counted u ON c.depth > 0 AND u.path = c.above
"""
