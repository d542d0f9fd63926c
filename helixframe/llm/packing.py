"""Best-fit packing into sequences of several permitted lengths.

A document takes its UTF-8 bytes plus one separator as tokens (or the values of
a length column). Whole multiples of the largest length fill sequences of their
own; the rest of each document is one item. Items are packed best fit, longest
first: an item goes to the open bin that it fills best. Where none has room, a
bin is opened whose permitted length has the least cost for each token that is
expected to fill it - the item itself and those that remain and still fit. In
the end each bin shrinks to the shortest permitted length that holds its
contents.

The items are dealt by hash into groups of bounded size and each group is packed
by itself, so no task grows with the table; a group leaves at most a few bins
that a larger one could have filled.

Rows are told apart by their number in the table's partitions, so that a hot
doc_id is spread like all others; on a stored table a retry gives the same bins.

Defined results: a null or empty text is its separator alone; repeated rows are
packed each; items of equal size go in the order of doc_id and row, and equally full bins
in the order they were opened; a text longer than the largest length is cut into
pieces, of which only the numbers are kept; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import table, written

LENGTHS = (1024, 2048, 4096, 8192, 16384)
COLUMNS = "doc_id long, piece long, start long, n_tokens long, bin string, capacity long, bin_start long"


def cost(length: int, longest: int) -> float:
    """Of one sequence: linear work, attention that grows with the square, and a fixed overhead."""
    return length * (1 + 0.25 * length / longest) + 32


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, capacity, start in it) of each item; sizes must descend and none exceed the largest length."""
    lengths = sorted(lengths)
    costs = [cost(x, lengths[-1]) for x in lengths]
    rising = [-x for x in sizes]
    left = [0, *accumulate(sizes)]  # left[-1] - left[i]: what items from i on hold
    room: list[tuple[int, int]] = []  # (free, bin) of the open bins, ordered
    caps: list[int] = []
    used: list[int] = []
    where: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            best = (float("inf"), 0)
            for c, x in zip(costs, lengths, strict=True):
                if x >= size:
                    later = max(i + 1, bisect_left(rising, size - x))  # the first item that fits beside this one
                    fill = size + min(x - size, left[-1] - left[later] if later < len(sizes) else 0)
                    best = min(best, (c / fill if fill else c, x))
            b, free = len(caps), best[1]
            caps.append(free)
            used.append(0)
        where.append((b, used[b]))
        used[b] += size
        if free > size:
            insort(room, (free - size, b))
    final = [lengths[bisect_left(lengths, u)] for u in used]
    return [(b, final[b], start) for b, start in where]


def pack_documents(docs: DataFrame, lengths: Sequence[int] = LENGTHS, length_col: str | None = None, rows_per_group: int = 20_000) -> DataFrame:
    """One row for each piece of a document: doc_id, piece, start, n_tokens, bin, capacity, bin_start."""
    most = max(lengths)
    n = F.col(length_col).cast("long") if length_col else F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n, F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("row")), "lengths")
    n_groups = max(1, -(-rows.count() // rows_per_group))
    full = F.floor(F.col("n") / most)
    whole = rows.filter(full > 0).select("doc_id", "row", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece")).select(
        "doc_id", "piece", (F.col("piece") * most).alias("start"), F.lit(most).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("w"), "row", "piece").alias("bin"), F.lit(most).cast("long").alias("capacity"), F.lit(0).cast("long").alias("bin_start"),
    )
    group = F.pmod(F.xxhash64("doc_id", "row"), F.lit(n_groups))
    items = rows.select("doc_id", full.alias("piece"), (full * most).alias("start"), (F.col("n") - full * most).alias("n_tokens"), "row", group.alias("group")).filter("n_tokens > 0")

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "doc_id", "row"], ascending=[False, True, True], kind="stable")
        got = pd.DataFrame(pack(pdf["n_tokens"].tolist(), lengths), columns=["bin", "capacity", "bin_start"], index=pdf.index)
        got["bin"] = f"{key[0]}-" + got["bin"].astype(str)
        return pd.concat([pdf.drop(columns=["group", "row"]), got], axis=1)

    return whole.unionByName(items.groupBy("group").applyInPandas(packed, COLUMNS))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
