"""MinHash near-dedup by a multi-index Hamming join.

A text's set is its distinct shingles. Texts of equal sets are one class, known
by a 128-bit digest of the set. Each class has a signature of `SLOTS` slots of 16
bits, the low bits of MinHash values; the distance of two signatures is the
number of slots that differ. The slots are cut into `CHUNKS` chunks of four. By
the pigeonhole principle two signatures within `DISTANCE` differ in at most one
slot of some chunk, so that each chunk is indexed four times, each time without
one of its slots: every pair within the distance meets in some bucket. Only
rows of buckets with company get their signatures, packed to four bits a slot,
which can only bring more pairs within the distance. At a
similarity of 0.8 a slot differs with probability 0.2, and more than `DISTANCE`
of 48 do with probability 2e-6.

Links never multiply. A bucket only yields a spanning forest of its pairs within
the distance, and what it joins is a coarse component: every link lies within
one. Inside the coarse components, similarities are computed on full sets,
again yielding spanning forests; the components of these are the result.

Groups of any size - large buckets (as a hashed sixteenth of the classes tells)
and coarse components - are dealt in blocks of bounded size, in two rounds. In
the first, each block is searched by itself together with a few members of the
group that go to all its blocks; these join what belongs together across the
blocks. In the second, what is still apart from the group's largest part is
compared with all blocks, so that every pair that isn't known to be joined is
looked at. Where a group holds together, both rounds are linear in its size;
pairs of blocks only arise for texts that are alike enough to be candidates and
yet not linked.

A set is held as 64-bit hashes of its shingles, and two sets count as equal if
their sizes and two 64-bit sums of these hashes are.

Defined results: a null or blank text has an empty set and stands alone; a row
with a null doc_id has no component and isn't kept by `kept`; rows of one doc_id
are one node, linked by each of their texts; repeated rows have equal results;
an empty table gives an empty result; other columns are not read by `groups` and
pass through `deduplicated`, whatever their names. A long text takes a small
multiple of its size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from helixframe.llm.common import distinct_sets, mixed, shielded, shingle_hashes, small, table, utf8, written
from helixframe.operators.graph import connected_components

SLOTS = 48
PER_CHUNK = 4
CHUNKS = SLOTS // PER_CHUNK
ALLOWED = 1
DISTANCE = CHUNKS * (ALLOWED + 1) - 1
LARGE_BUCKET = 4096  # rows
BLOCK = 256  # sets that are compared at once
BLOCK_SHINGLES = 1_000_000  # and what they hold together, unless one set alone holds more
PIVOTS = 4  # one of so many rows of a block goes to all blocks of its group
SALTS = 16
BROADCAST_ROWS = 250_000

_FACTORS = mixed(np.arange(1, SLOTS + 1, dtype=np.uint64)) | np.uint64(1)


def signatures(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """(text, slot): 16 bits of each MinHash value; zeros for an empty set."""
    out = np.zeros((len(begin) - 1, SLOTS), np.uint16)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k, factor in enumerate(_FACTORS):
            least = np.minimum.reduceat(((sets * factor) >> np.uint64(32)).astype(np.uint32), begin[full])
            out[full, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def packed(signs: np.ndarray) -> np.ndarray:
    """The low four bits of each slot, two slots a byte: the distance of two packed signatures is never above that of the whole ones."""
    low = (signs & 15).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def unpacked(low: pa.ChunkedArray) -> np.ndarray:
    """(row, slot) of packed signatures."""
    both = np.frombuffer(b"".join(low.to_pylist()), np.uint8).reshape(-1, SLOTS // 2)
    return np.stack([both >> 4, both & 15], -1).reshape(-1, SLOTS)


def features(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, row (its number), n_shingles, high and low (the set's digest), signature, packed."""
    names = ["doc_id", "text_hash", "row", "n_shingles", "high", "low", "signature", "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small(batch):
                sets, begin = distinct_sets(*shingle_hashes([t or b"" for t in utf8(part.column("text"))], size))
                count = np.diff(begin)
                full = np.flatnonzero(count)
                high, low = np.zeros((2, len(count)), np.int64)
                if len(full):
                    high[full] = np.add.reduceat(mixed(sets ^ np.uint64(1)), begin[full]).view(np.int64)
                    low[full] = np.bitwise_xor.reduceat(mixed(sets ^ np.uint64(2)), begin[full]).view(np.int64)
                signs = signatures(sets, begin)
                made = [count.astype(np.int64), high, low]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *map(pa.array, made), pa.array([x.tobytes() for x in signs], pa.binary()), pa.array([x.tobytes() for x in packed(signs)], pa.binary())], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, row long, n_shingles long, high long, low long, signature binary, packed binary")


def keyed(classes: DataFrame) -> DataFrame:
    """key, node: a row for each chunk and each of its slots left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                signs = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint16).reshape(-1, SLOTS)
                chunks = signs.reshape(-1, CHUNKS, PER_CHUNK).astype(np.int64)
                keys = np.empty((len(signs), CHUNKS, PER_CHUNK), np.int64)
                for gone in range(PER_CHUNK):
                    rest = [c for c in range(PER_CHUNK) if c != gone]
                    keys[:, :, gone] = (np.arange(CHUNKS) * PER_CHUNK + gone) << 48
                    for place, c in enumerate(rest):
                        keys[:, :, gone] |= chunks[:, :, c] << (16 * place)
                node = np.repeat(part.column("node").to_numpy(), CHUNKS * PER_CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def crowded(keys: DataFrame) -> DataFrame:
    """The rows of keys whose key another row has too: most buckets hold one class, and need no signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # a row that waits for its successor
        had = False  # its predecessor has its key
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            if last:
                key, node = np.append(last[0], key), np.append(last[1], node)
            same = key[1:] == key[:-1]
            kept = np.append(same, False)
            kept[1:] |= same
            kept[0] |= had
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][kept[:-1]]), pa.array(node[:-1][kept[:-1]])], ["key", "node"])
            last, had = (int(key[-1]), int(node[-1])), bool(kept[-1])
        if last and had:
            yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64())], ["key", "node"])

    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, node long")


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal `by` columns from sorted batches, with the runs' starts (and the end)."""

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for c in by:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if kept and all(kept[-1].column(c)[-1] == now.column(c)[-1] for c in by):  # still the same run
            kept.append(now)
            continue
        whole = pa.concat_tables([*kept, now])
        at = starts(whole)
        if at[-1]:
            yield whole.slice(0, at[-1]), at
        kept = [whole.slice(at[-1])]
    if kept:
        whole = pa.concat_tables(kept)
        yield whole, np.append(starts(whole), whole.num_rows)


class Forest:
    """Keeps the edges that join what no earlier edge has joined."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = up[x]
        return x

    def fresh(self, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
        out = []
        for a, b in pairs:
            r, s = self.root(a), self.root(b)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                out.append((a, b))
        return out


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(one: np.ndarray, others: np.ndarray, n_one: np.ndarray, n_others: np.ndarray, percent: int) -> np.ndarray:
    """Signatures within the distance, of sets whose sizes allow the similarity."""
    fits = 100 * np.minimum(n_one, n_others) >= percent * np.maximum(n_one, n_others)
    return fits & ((one != others).sum(axis=-1) <= DISTANCE)


def bucket_forest(node: np.ndarray, n: np.ndarray, low: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs within the distance in one bucket: each member is compared with those not yet joined."""
    left = np.arange(len(node))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(low[at], low[left], n[at], n[left], percent)
            for other in left[near]:
                yield int(node[at]), int(node[other])
            queue += left[near].tolist()
            left = left[~near]


def _broadcast(df: DataFrame) -> DataFrame:
    """df, which must be cheap to count, broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _hash(node: str, blocks: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(node, F.lit(salt)), blocks)


def first_dealt(rows: DataFrame) -> DataFrame:
    """rows (node, blocks, size) with `sub`: the own block of each, and all blocks for the few that hold a group together."""
    pivot = (F.col("blocks") > 1) & (_hash("node", F.col("size"), 1) < F.ceil(F.col("size") / F.col("blocks") / PIVOTS))
    own = _hash("node", F.col("blocks"), 2)
    return rows.withColumn("sub", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))))


def still_open(rows: DataFrame, group: str) -> DataFrame | None:
    """For groups whose rows (node, blocks, size, part) are in several parts: the largest part and how many chunks the others make; None without any."""
    sizes = rows.groupBy(group, "part", "blocks", "size").agg(F.count("*").alias("n"))
    found = sizes.groupBy(group, "blocks", "size").agg(F.max(F.struct("n", "part")).alias("m"), F.sum("n").alias("all"))
    found = found.select(group, F.col("m.part").alias("main"), F.ceil((F.col("all") - F.col("m.n")) * F.col("blocks") / F.col("size")).alias("chunks"))
    found = written(found.filter("chunks > 0"), "open-groups")
    return None if found.isEmpty() else found


def second_dealt(rows: DataFrame, found: DataFrame, group: str) -> DataFrame:
    """rows (node, blocks, part) of groups that are open, with `sub` and `left`: chunks of what isn't in the main part meet every block."""
    rows = rows.join(_broadcast(found), group)
    zero = F.lit(0).cast("long")
    chunk, own = _hash("node", F.col("chunks"), 3), _hash("node", F.col("blocks"), 2)
    right = F.transform(F.sequence(zero, F.col("chunks") - 1), lambda q: F.struct((q * F.col("blocks") + own).alias("sub"), F.lit(False).alias("left")))
    left = F.transform(F.sequence(zero, F.col("blocks") - 1), lambda b: F.struct((chunk * F.col("blocks") + b).alias("sub"), F.lit(True).alias("left")))
    to = F.when(F.col("part") == F.col("main"), right).otherwise(F.concat(right, left))
    return rows.withColumn("to", F.explode(to)).select("*", "to.sub", "to.left").drop("to", "main", "chunks")


def coarse_edges(keys: DataFrame, percent: int) -> DataFrame:
    """a, b: edges whose components hold all pairs within the distance of each bucket (key, sub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for t, at in runs(batches, ["key", "sub"]):
            size = np.diff(np.append(at[at < t.num_rows], t.num_rows))
            start = at[: len(size)]
            if not (size > 1).any():
                continue
            node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
            low = unpacked(t.column("packed"))
            two = start[size == 2]
            near = two[_near(low[two], low[two + 1], n[two], n[two + 1], percent)]
            found = forest.fresh(zip(node[near].tolist(), node[near + 1].tolist(), strict=True))
            for a, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                found += forest.fresh(bucket_forest(node[a : a + k], n[a : a + k], low[a : a + k], percent))
            if found:
                yield _edges(found)

    return keys.select("key", "sub", "node", "n", "packed").repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(run, "a long, b long")


def cross_coarse_edges(keys: DataFrame, percent: int) -> DataFrame:
    """a, b: parts that a pair within the distance joins, one row `left` of the pair and one not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["key", "sub"]):
            part, n, left = (t.column(c).to_numpy() for c in ("part", "n", "left"))
            low, found = unpacked(t.column("packed")), []
            ends = np.append(at[at < t.num_rows], t.num_rows).tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                forest, right = Forest(), a + np.flatnonzero(~left[a:b])
                for x in a + np.flatnonzero(left[a:b]):
                    near = right[_near(low[x], low[right], n[x], n[right], percent) & (part[right] != part[x])]
                    found += forest.fresh((int(part[x]), y) for y in np.unique(part[near]).tolist())
            if found:
                yield _edges(found)

    return keys.select("key", "sub", "left", "part", "n", "packed").repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(run, "a long, b long")


def _parts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with `part`: the component of each node, itself where no edge has it."""
    return rows.join(found.select("node", F.col("component").alias("part")), "node", "left").withColumn("part", F.coalesce("part", "node"))


def _joined(found: DataFrame, across: DataFrame) -> DataFrame:
    """Components of the nodes of `found` (node, component) after edges across components."""
    return connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(written(across, "cross-edges")))


def coarse_components(classes: DataFrame, percent: int) -> DataFrame:
    """node, component: every pair within the distance lies in one component. classes: node, n, signature, packed."""
    sample = keyed(classes.filter(_hash("node", F.lit(16), 4) == 0)).select("key")
    large = sample.groupBy("key").agg((F.count("*") * 16).alias("size")).filter(F.col("size") > LARGE_BUCKET)
    large = written(large.select("key", "size", F.ceil(F.col("size") * 2 / LARGE_BUCKET).alias("blocks")), "large-buckets")
    light = classes.drop("signature")
    rows = crowded(keyed(classes)).join(light, "node")
    if large.isEmpty():
        return written(connected_components(coarse_edges(rows.withColumn("sub", F.lit(0)), percent)), "coarse")
    one = F.lit(1).cast("long")
    sized = rows.join(_broadcast(large), "key", "left").withColumns({"size": F.coalesce("size", one), "blocks": F.coalesce("blocks", one)})
    found = written(connected_components(coarse_edges(first_dealt(sized), percent)), "coarse")
    again = written(_parts(keyed(classes).join(_broadcast(large), "key").join(light, "node"), found), "large-bucket-rows")
    left = still_open(again, "key")
    return found if left is None else written(_joined(found, cross_coarse_edges(second_dealt(again, left, "key"), percent)), "coarse")


def linked(sets: list[np.ndarray], percent: int, part: np.ndarray | None = None) -> np.ndarray:
    """(i, j) i < j of all pairs of sets, of different parts if these are given, whose similarity reaches percent."""
    n = np.array([len(s) for s in sets])
    i, j = np.triu_indices(len(sets), 1)
    fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    if part is not None:
        fits &= part[i] != part[j]
    i, j = i[fits], j[fits]
    if len(sets) <= 8:
        both = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    else:
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        of = np.repeat(np.arange(len(sets)), n)
        shared = np.bincount(column, minlength=len(values)) > 1  # a shingle of one set alone adds to no intersection
        place = np.cumsum(shared) - 1
        of, column = of[shared[column]], place[column[shared[column]]]
        order = np.argsort(column, kind="stable")
        of, column = of[order], column[order]
        total = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(shared.sum()), 4096):
            lo, hi = np.searchsorted(column, [a, a + 4096])
            member = np.zeros((len(sets), 4096), np.float32)
            member[of[lo:hi], column[lo:hi] - a] = 1
            total += member @ member.T
        both = total[i, j].astype(np.int64)
    close = 100 * both >= percent * (n[i] + n[j] - both)
    return np.stack([i[close], j[close]], 1)


def full_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members (doc_id, text_hash, node, component, blocks, size) with the `values` of their sets; a repeated row gives at most one a task."""
    columns = [c for c in members.columns if c not in ("doc_id", "text_hash")]
    few = _broadcast(members.withColumnRenamed("doc_id", "__doc"))
    rows = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.xxhash64("text").alias("text_hash"), "text").join(few, ["__doc", "text_hash"]).select(*columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in small(batch):
                fresh = [not (x in seen or seen.add(x)) for x in part.column("node").to_pylist()]
                part = part.filter(pa.array(fresh, pa.bool_()))
                if part.num_rows:
                    values, begin = distinct_sets(*shingle_hashes([t or b"" for t in utf8(part.column("text"))], size))
                    got = pa.array([values[a:b].tobytes() for a, b in zip(begin, begin[1:], strict=False)], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], got], [*columns, "values"])

    return rows.mapInArrow(run, StructType([*members.select(*columns).schema.fields, StructField("values", BinaryType())]))


def exact_edges(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: a spanning forest of the links on full sets in each block (component, sub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["component", "sub"]):
            node, values = t.column("node").to_pylist(), t.column("values")
            ends, found = np.append(at[at < t.num_rows], t.num_rows).tolist(), []
            for a, b in zip(ends, ends[1:], strict=False):
                here = list({node[k]: k for k in range(a, b)}.values())  # a repeated row may have come from several tasks
                if len(here) > 1:
                    pairs = linked([np.frombuffer(values[k].as_py(), np.uint64) for k in here], percent)
                    found += Forest().fresh((node[here[i]], node[here[j]]) for i, j in pairs.tolist())
            if found:
                yield _edges(found)

    return sets.select("component", "sub", "node", "values").repartition("component", "sub").sortWithinPartitions("component", "sub").mapInArrow(run, "a long, b long")


def cross_exact_edges(sets: DataFrame, percent: int) -> DataFrame:
    """a, b: parts that a link joins, one row `left` of the link and one not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["component", "sub"]):
            node, part, left, values = t.column("node").to_pylist(), t.column("part").to_pylist(), t.column("left").to_pylist(), t.column("values")
            ends, found = np.append(at[at < t.num_rows], t.num_rows).tolist(), []
            for a, b in zip(ends, ends[1:], strict=False):
                here = list({(node[k], left[k]): k for k in range(a, b)}.values())
                pairs = linked([np.frombuffer(values[k].as_py(), np.uint64) for k in here], percent, np.array([part[k] for k in here]))
                found += Forest().fresh((part[here[i]], part[here[j]]) for i, j in pairs.tolist())
            if found:
                yield _edges(found)

    return sets.select("component", "sub", "left", "node", "part", "values").repartition("component", "sub").sortWithinPartitions("component", "sub").mapInArrow(run, "a long, b long")


def exact_components(docs: DataFrame, coarse: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """node, component: of the links on full sets. coarse: node, component; classes: node, n, doc_id, text_hash."""
    members = written(coarse.join(classes.select("node", "n", "doc_id", "text_hash"), "node"), "members")
    many = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES))
    large = written(members.groupBy("component").agg(F.count("*").alias("size"), many.alias("blocks")).filter("blocks > 1"), "large-components")
    one = F.lit(1).cast("long")
    sized = members.drop("n").join(_broadcast(large), "component", "left").withColumns({"size": F.coalesce("size", one), "blocks": F.coalesce("blocks", one)})
    sized = written(sized, "members")
    found = written(connected_components(exact_edges(first_dealt(full_sets(docs, sized, size)), percent)), "exact")
    again = written(_parts(sized.filter("blocks > 1"), found), "large-component-rows")
    left = still_open(again, "component")
    if left is None:
        return found
    some = again.join(_broadcast(left.select("component")), "component", "left_semi")
    return _joined(found, cross_exact_edges(second_dealt(full_sets(docs, written(some, "open-rows"), size), left, "component"), percent))


def salted_left_join(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """rows left join few, with the rows of one key dealt over SALTS tasks."""
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(few, [*on, "__salt"], "left").drop("__salt")


def groups(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of docs."""
    rows = written(features(docs, size), "shingle-features")
    usable = rows.filter("doc_id is not null and n_shingles > 0")
    digest = ["high", "low", "n_shingles"]
    copied = usable.groupBy(*digest).agg(F.min("doc_id").alias("least"), F.min("row").alias("class"), F.count("*").alias("n")).filter("n > 1").drop("n")
    classed = written(salted_left_join(rows, copied, digest).select("doc_id", "text_hash", "row", "n_shingles", "signature", "packed", F.coalesce("class", "row").alias("class"), F.coalesce("least", "doc_id").alias("least")), "classes")
    classes = classed.filter("row = class and n_shingles > 0 and doc_id is not null").select(F.col("class").alias("node"), F.col("n_shingles").alias("n"), "signature", "packed", "doc_id", "text_hash")
    coarse = coarse_components(classes.drop("doc_id", "text_hash"), percent)
    found = exact_components(docs, coarse, classes, size, percent)
    # From classes to documents: a class is known by its least doc_id; a doc_id with several texts joins their classes.
    least = classed.filter("row = class").select(F.col("class").alias("node"), "least")
    named = found.join(least, "node").select("component", "least")
    links = named.join(named.groupBy("component").agg(F.min("least").alias("first")), "component").select(F.col("least").alias("a"), F.col("first").alias("b"))
    owned = classed.filter("doc_id is not null").select("doc_id", "least").distinct()
    several = written(owned.groupBy("doc_id").agg(F.min("least").alias("a"), F.max("least").alias("b")).filter("a <> b").select("doc_id", "a"), "several")
    if not several.isEmpty():
        links = links.union(owned.join(several, "doc_id").select("a", F.col("least").alias("b")))
    final = connected_components(links)
    placed = salted_left_join(classed.select("doc_id", "n_shingles", F.col("least").alias("node")), final, ["node"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, the one of the least doc_id (of its rows the one of the least text); rows with a null doc_id stay. The columns stay."""
    own, back = shielded(docs, "doc_id", "text")
    found = groups(own, size, percent).filter("doc_id is not null").groupBy(F.col("doc_id").alias("__doc")).agg(F.count("*").alias("__n"), F.max("kept").alias("__kept"))
    gone = written(found.filter("not __kept or __n > 1"), "gone")
    rows = own.join(_broadcast(gone), own["doc_id"].cast("long") == F.col("__doc"), "left").filter("__kept is null or __kept")
    if gone.filter("__kept").isEmpty():
        return back(rows)
    row = F.struct(*own.columns)
    one = rows.filter("__kept").groupBy(F.col("doc_id").alias("__one")).agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("__row"))
    return back(rows.filter("__kept is null").select(*own.columns).unionByName(one.select("__row.*")))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
