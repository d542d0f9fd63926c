"""Operators on hand-made tables."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import table_functions
from helixframe.functions.table_functions import register_table_functions
from helixframe.functions.tables import IUPAC
from helixframe.operators import agglomeration, calling, clusters, columns, expansion, fuzzy, graph, intervals, models, order, power, profiles, relational, sketches, statistics, trajectory
from helixframe.sources import fastq, text


def test_islands(spark):
    rows = spark.createDataFrame([(i, f) for i, f in enumerate([True, False, True, False, False, True], 1)], "i int, f boolean")
    got = sorted((r["first"], r["last"]) for r in relational.islands(rows, "i", F.col("f"), 1).collect())
    assert got == [(1, 3), (6, 6)]


def test_extras_walk(spark):
    rows = spark.createDataFrame([("A" if i < 60 else "B" if i < 80 else "C" if i < 90 else "D", i) for i in range(100)], "s string, id long")
    p = profiles.proportions(profiles.cells(rows, "s", (), "id"))
    assert sorted(r.aa for r in profiles.top_and_extras(p, 0.5).collect()) == ["A", "B"]
    assert [r.residues for r in profiles.covering(p, 0.9).groupBy("pos").agg(F.array_join(F.sort_array(F.collect_list("aa")), "").alias("residues")).collect()] == ["ABC"]


def test_weighted_median_and_holm(spark):
    rows = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 3), ("a", 10.0, 1), ("a", float("nan"), 5), ("a", 3.0, 0)], "g string, x double, w int")
    got = statistics.weighted(rows, ["g"], "x", "w").first()
    assert (got.n, got.weighted_median) == (5, 2.0) and got.weighted_mean == pytest.approx(17 / 5)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p double")
    assert [round(r.adjusted, 9) for r in statistics.holm(p, "p").orderBy("p").collect()] == [0.03, 0.06, 0.06]


def test_percentiles_by_selection(spark):
    """All groups and shares against sorted lists: weights, ties, signs, infinities, a null group, and values that no two rounds tell apart."""
    r = random.Random(9)
    values = [0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, float("inf"), float("-inf"), 1.0000000000000002, 1.0]
    rows = [(r.choice(["a", "b", None]), r.choice(["x", "y"]), r.choice(values) if r.random() < 0.3 else r.gauss(0, 10), r.randint(0, 4)) for _ in range(900)]
    rows += [("c", "x", None, 1), ("c", "x", float("nan"), 1), ("d", "x", 7.0, 1)]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, h string, v double, w int")
    for weight in (None, "w"):
        want = {}
        for g, h, v, w in rows:
            if v is not None and v == v:
                want.setdefault((g, h), []).extend([v] * (1 if weight is None else w))
        got = {(x.g, x.h): [x[f"p{k}"] for k in range(5)] for x in order.percentiles(df, ["g", "h"], "v", shares, weight).collect()}
        assert set(got) == {k for k, v in want.items() if v}
        for k, found in got.items():
            v = sorted(want[k])
            for p, x in zip(shares, found, strict=True):
                at = (len(v) - 1) * p
                low, high = v[math.floor(at)], v[math.ceil(at)]
                assert x == low if low == high else x == pytest.approx(low + (at - math.floor(at)) * (high - low), nan_ok=True)
    assert order.percentiles(df.filter("false"), [], "v", [0.5]).isEmpty()
    assert order.percentiles(df.filter("g = 'd'"), [], "v", [0.5]).first().p0 == 7.0


def test_power_transform(spark):
    """Exponents against a plain search, and there and back."""
    r = np.random.default_rng(3)
    table = {"a": np.exp(r.normal(1, 0.6, 400)), "b": r.normal(-3, 2, 400), "c": -np.exp(r.normal(2, 1, 400)), "flat": np.full(400, 2.5)}
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(*table.values(), strict=True)] + [(None, float("inf"), None, None)], "a double, b double, c double, flat double")
    found = power.fitted(df, list(table))

    def plain(x, e):
        with np.errstate(all="ignore"):
            up = np.log1p(np.maximum(x, 0)) if abs(e) < 1e-12 else ((np.maximum(x, 0) + 1) ** e - 1) / e
            down = -np.log1p(np.maximum(-x, 0)) if abs(e - 2) < 1e-12 else -((np.maximum(-x, 0) + 1) ** (2 - e) - 1) / (2 - e)
        return np.where(x >= 0, up, down)

    for c in "abc":
        x = table[c]
        score = lambda e, x=x: -len(x) / 2 * np.log(plain(x, e).var()) + (e - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()
        best = max(np.linspace(-4, 6, 2001), key=score)
        best = max(np.linspace(best - 0.01, best + 0.01, 2001), key=score)
        assert found[c].exponent == pytest.approx(best, abs=2e-5)
        assert (found[c].mean, found[c].deviation) == pytest.approx((plain(x, best).mean(), plain(x, best).std()), rel=1e-3)
    assert (found["flat"].exponent, found["flat"].mean, found["flat"].deviation) == (1.0, pytest.approx(2.5), 1.0)
    for p in (power.Power(0.0), power.Power(2.0), power.Power(1.0), power.Power(0.5, 0.2, 3.0)):
        off = F.max(F.abs(power.to_real(power.from_real(F.col("b"), p), p) - F.col("b")))
        assert df.filter("flat is not null").select(off).first()[0] < 1e-9
    both = {c: power.to_real(power.from_real(F.col(c), found[c]), found[c]) for c in table}
    assert df.filter("flat is not null").select(*(F.max(F.abs(x / F.col(c) - 1)).alias(c) for c, x in both.items())).first() == pytest.approx((0, 0, 0, 0), abs=1e-9)
    unreached = spark.range(1).select(power.to_real(F.lit(3.0), power.Power(-0.5)), power.to_real(F.lit(-9.0), power.Power(0.5))).first()
    assert unreached[0] is None and unreached[1] == pytest.approx(1 - 14.5 ** (1 / 1.5))


def test_power_transform_of_repeated_values(spark, monkeypatch):
    """Exponents come from different values and their counts, nulls and infinities apart."""
    r = random.Random(6)
    few = [r.lognormvariate(2, 0.7) for _ in range(40)]
    rows = [(r.choice(few), 3.0, None) for _ in range(5000)] + [(None, None, None), (math.inf, math.nan, None)]
    tables = []
    monkeypatch.setattr(power, "written", lambda d, what, plain=graph.written: tables.append(plain(d, what)) or tables[-1])
    got = power.fitted(spark.createDataFrame(rows, "a double, b double, c double").repartition(4), ["a", "b", "c"])
    assert tables[0].count() == len({a for a, _, _ in rows[:5000]}) + 1
    x = np.array([a for a, _, _ in rows[:5000]])
    t = lambda e: ((1 + x) ** e - 1) / e
    likely = lambda e: -len(x) / 2 * math.log(t(e).var()) + (e - 1) * np.log1p(x).sum()
    e = got["a"].exponent
    assert likely(e) >= max(likely(e - 1e-3), likely(e + 1e-3)) and got["a"].mean == pytest.approx(t(e).mean()) and got["a"].deviation == pytest.approx(t(e).std())
    assert (got["b"].exponent, got["b"].mean, got["b"].deviation) == (1.0, 3.0, 1.0) and got["c"] == power.Power(1.0)


def test_pairs_of_a_library_with_a_constant_frame(spark, monkeypatch):
    """Equal to brute force, also where buckets are cut several times; the pairs looked at stay near the answer."""
    r = random.Random(5)
    places = r.sample(range(64), 9)
    frame = r.choices("ACGT", k=64)
    rows = set()
    while len(rows) < 1500:
        s = frame[:]
        for k, at in enumerate(places):
            s[at] = r.choices("ACGT", [8, 4, 2, 1] if k % 2 else [1, 1, 1, 1])[0]
        rows.add("".join(s))
    rows |= {"ACG", "ACT", "AGT", "TTT", "A", ""}
    want = {(a, b) for a in rows for b in rows if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2}
    looked = spark.sparkContext.accumulator(0)
    plain = clusters._differences

    def counted(a, b):
        looked.add(len(a))
        return plain(a, b)

    df = spark.createDataFrame([(s,) for s in rows], "s string")
    for crowd in (10, 60, 10_000):
        got = [tuple(x) for x in clusters.within_distance(df, "s", 2, crowd=crowd).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(clusters, "_differences", counted)
    clusters.within_distance(df, "s", 2).collect()
    assert 0 < looked.value < 20 * len(want)


def test_pairs_are_not_moved_once_found(spark):
    """Each pair once, in groups of other lengths and letters, nulls apart, also where buckets are cut; no aggregate or join above the comparison."""
    r = random.Random(9)
    base = {(g, n): r.choices(letters, k=n) for g, letters in (("dna", "ACGT"), ("protein", "ACDEFGHIKLMNPQRSTVWY"), ("other", "aé語\U0001f600")) for n in (6, 9, 70)}
    rows = set()
    for (g, n), s in base.items():
        letters = sorted(set(s)) + ["A"]
        for _ in range(120):
            other = s[:]
            for at in r.choices(range(n), k=r.choice([1, 2, 3, 4])):
                other[at] = r.choice(letters)
            rows.add((g, "".join(other)))
    want = {(g, a, b) for g, a in rows for h, b in rows if g == h and a.encode() < b.encode() and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2}
    df = spark.createDataFrame([*rows, ("dna", None), (None, "AAAAAA"), (None, "AAAAAC")], "g string, s string")
    for crowd in (8, 8192):
        found = clusters.within_distance(df, "s", 2, ["g"], crowd)
        got = [tuple(x) for x in found.collect()]
        assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in above and "Join" not in above


def test_mann_whitney_against_pairs(spark):
    r = random.Random(2)
    rows = [(s, float(r.randint(0, 9)), r.randint(1, 4)) for s in "ab" for _ in range(30)]
    got = statistics.mann_whitney(spark.createDataFrame(rows, "s string, x double, w int"), "x", "w", "s", "a", "b").first()
    a, b = ([x for s, x, w in rows if s == k for _ in range(w)] for k in "ab")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    n, ties = len(a) + len(b), sum(t**3 - t for t in Counter(a + b).values())
    z = max(0, abs(u - len(a) * len(b) / 2) - 0.5) / math.sqrt(len(a) * len(b) / 12 * (n + 1 - ties / (n * (n - 1))))
    assert got.u == u and got.z == pytest.approx(z)


def test_monte_carlo_p(spark):
    got = statistics.chi_square_monte_carlo(spark, [10, 20, 30], [30, 20, 10], 3000).first()
    assert got.simulations == 3000 and got.statistic == pytest.approx(20.0) and got.p < 0.01
    again = statistics.chi_square_monte_carlo(spark, [10, 20, 30], [30, 20, 10], 3000, tasks=3).first()
    assert got == again


def test_keep_one_and_numbers(spark):
    rows = spark.createDataFrame([(k, f"{'Ab c' if k % 2 else 'aBC'}") for k in range(20)], "id long, s string")
    assert relational.keep_one(rows, relational.normal_key(F.col("s")), "id").first().id == 0
    assert relational.keep_one(rows, relational.normal_key(F.col("s")), "id", "last").first().id == 19
    got = relational.numbered(rows.repartition(5), ["id"]).collect()
    assert sorted((r.id, r.ord) for r in got) == [(k, k) for k in range(20)]


def test_ranks_of_all_rows(spark):
    rows = [(k, k % 7 if k % 5 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, n int").repartition(4)
    want = {x[0]: k for k, x in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])), 1)}
    assert {x.id: x["rank"] for x in relational.ranked(df, "n", "id").collect()} == want
    assert {x.id: x["rank"] for x in relational.ranked(df.withColumn("g", F.lit(1)), "n", "id", by=["g"]).collect()} == want


def test_repeated_keys_raise(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, v int")
    with pytest.raises(Exception, match="repeated key"):
        relational.checked_left_join(left, right, "k").collect()


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (8, 9), (5, 5)], "a long, b long")
    assert {r.node: r.component for r in graph.connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}


def test_components_with_hubs(spark, monkeypatch):
    """Hubs of more edges than a task should get: a star of 3,000 nodes, a path and random edges, against a plain union-find."""
    monkeypatch.setattr(graph, "HUB", 500)
    r = random.Random(12)
    edges = [(5, k) for k in range(100, 3100)] + [(k, k + 1) for k in range(5000, 5060)] + [(r.randrange(7000, 9000), r.randrange(7000, 9000)) for _ in range(1500)] + [(4, 3000), (3, 4)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_components_with_a_hub_at_the_largest_id(spark, monkeypatch):
    """All edges lead down from one node, so that its edges meet in the small star."""
    monkeypatch.setattr(graph, "HUB", 500)
    edges = [(9999, k) for k in range(3000)] + [(9999, 3500), (4000, 4001)]
    got = {x.node: x.component for x in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(3000)}, 3500: 0, 9999: 0, 4000: 4000, 4001: 4000}
    pairs = spark.createDataFrame(edges, "u long, v long")
    kept = graph._with_least(pairs, len(edges), 8)
    assert kept.filter("u = 9999 and least <> 0").isEmpty() and kept.count() == len(edges)
    dealt = kept.filter("u = 9999").groupBy(F.spark_partition_id()).count().collect()
    assert max(r[1] for r in dealt) < 2000  # not all in one task


def test_directional_clusters(spark):
    counts = spark.createDataFrame([("x", "AAAA", 30), ("x", "AAAT", 5), ("x", "TTTT", 4), ("y", "AAAT", 5)], "g string, s string, n long")
    got = {(r.g, r.s): r.representative for r in clusters.directional(counts, "s", "n", ["g"]).collect()}
    assert got == {("x", "AAAA"): "AAAA", ("x", "AAAT"): "AAAA", ("x", "TTTT"): "TTTT", ("y", "AAAT"): "AAAT"}


def greedy(counts, ratio=3, most=2):
    found = []
    for s, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        for c in found:
            if c[1] >= ratio * n and sum(a != b for a, b in zip(c[0], s, strict=True)) <= most:
                c[1] += n
                c[2].append(s)
                break
        else:
            found.append([s, n, [s]])
    return {s: c[0] for c in found for s in c[2]}


def test_directional_clusters_equal_the_plain_loop(spark):
    r = random.Random(6)
    counts = Counter()
    for _ in range(3000):
        s = list(r.choice(["ACGTACGT", "TTGTACAA", "GGGGCCCC"]))
        for _ in range(r.choice([0, 0, 0, 1, 2, 3])):
            s[r.randrange(8)] = r.choice("ACGT")
        counts["".join(s)] += 1
    close = {s: r.randint(1, 12) for s in counts}  # counts near one another: clusters that grow decide
    for some in (counts, close):
        got = clusters.directional(spark.createDataFrame(list(some.items()), "s string, n long"), "s", "n")
        assert {r.s: r.representative for r in got.collect()} == greedy(some)


def test_pairs_of_directional_clusters_are_numbers(spark, monkeypatch):
    """No sequence is written or moved with the pairs, and those of which nothing can come are dropped."""
    kept = {}
    plain = clusters.written

    def noted(df, what):
        out = plain(df, what)
        kept.setdefault(what, []).append(out)
        return out

    monkeypatch.setattr(clusters, "written", noted)
    counts = {"ACGTACGTACGT": 90, "ACGTACGTACGA": 9, "ACGTACGTACTT": 5, "TTTTACGTACGT": 4, "TTTTACGTACGG": 4}
    got = clusters.directional(spark.createDataFrame(list(counts.items()), "s string, n long"), "s", "n")
    assert {r.s: r.representative for r in got.collect()} == greedy(counts)
    pairs = kept["variant-pairs"]
    assert all(k.dataType.typeName() in ("long", "boolean") for df in pairs for k in df.schema)
    assert pairs[0].count() == 2  # 90 takes 9 and 5; 9 and 5 are too near in count, as are 4 and 4


def test_pairs_within_a_distance(spark):
    r = random.Random(1)
    seqs = ["".join(r.choice("AC") for _ in range(n)) for n in (8, 9, 2, 1) for _ in range(40)]
    got = {(x.a, x.b) for x in clusters.within_distance(spark.createDataFrame([(s,) for s in seqs], "s string"), "s", 2).collect()}
    s = sorted(set(seqs))
    assert got == {(a, b) for a in s for b in s if a < b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2}


def test_medoids_and_ward(spark):
    rows = [("AAAAAAAA"[:k] + "C" * (8 - k),) for k in range(9) if k not in (3, 4, 5)]
    got = clusters.medoids(spark.createDataFrame(rows, "s string"), "s", 2).collect()
    assert {r.medoid for r in got if r.s.count("A") > 5} == {"AAAAAAAC"} and {r.medoid for r in got if r.s.count("A") < 3} == {"ACCCCCCC"}
    r = np.random.default_rng(3)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([r.normal(c, 0.2, (15, 2)) for c in ((0, 0), (5, 5), (0, 6))]))]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    for got in (agglomeration.ward(df, "id", ["x", "y"]), clusters.ward_of_cells(df, "id", ["x", "y"], 20)):
        labels = {x.id: x.cluster for x in got.collect()}
        assert len(set(labels.values())) == 3 and all(len({labels[i] for i in range(15 * k, 15 * k + 15)}) == 1 for k in range(3))


def test_medoids_equal_the_plain_loop(spark, monkeypatch):
    """Sequences of several lengths and letters, the empty one and a null, against plain loops; rows are not shuffled once they are distinct."""
    r = random.Random(4)
    rows = ["".join(r.choices(letters, k=n)) for letters in ("ACGT", "A-X", "Cé語") for n in (5, 5, 5, 6, 9) for _ in range(25)] + [""]
    near = lambda a, b: sum(x != y for x, y in zip(a, b))  # noqa: E731, B905
    distinct = sorted(set(rows), key=str.encode)
    first = spark.createDataFrame([(s,) for s in distinct], "s string").orderBy(F.xxhash64(F.lit(42), "s"), "s").limit(3)
    chosen, seen = sorted(x.s for x in first.collect()), set()
    own = lambda s: min(chosen, key=lambda c: near(s, c))
    for _ in range(10):
        if frozenset(chosen) in seen:
            break
        seen.add(frozenset(chosen))
        groups = {}
        for s in distinct:
            groups.setdefault(own(s), []).append(s)
        total = lambda s, of: sum(x is not s and (len(s) == 0 or k >= len(x) or x[k] != s[k]) for x in of for k in range(max(1, len(s))))
        chosen = sorted(min(of, key=lambda s: (total(s, of), s.encode())) for of in groups.values())
    df = spark.createDataFrame([(s,) for s in rows], "s string")
    got = clusters.medoids(df, "s", 3)
    assert {x.s: (x.medoid, x.distance) for x in got.collect()} == {s: (own(s), near(s, own(s))) for s in distinct}
    placed = clusters.to_centres(df.union(spark.createDataFrame([(None,)], "s string")), "s", chosen)
    assert placed.count() == len(rows) + 1 and placed.filter("s is null").first().medoid is None
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def plain_ward(points, sizes, largest=9):
    """{row: cluster} by the whole matrix of all rows."""
    tree = clusters.ward_tree(points, sizes)
    scores = [(round(clusters.silhouette(points, sizes, clusters.cut(tree, len(points), k)), 12), -k) for k in range(2, min(largest, len(points) - 1) + 1)]
    return clusters.cut(tree, len(points), -max(scores)[1])


@pytest.mark.parametrize(("few", "leaf", "shape"), [(30, 16, "groups"), (100, 64, "even"), (40, 24, "chain")])
def test_ward_by_rounds_equals_the_matrix(spark, monkeypatch, few, leaf, shape):
    """Labels and number of clusters of 700 rows, some of them repeated, from many leaves and rounds."""
    monkeypatch.setattr(agglomeration, "FEW", few)
    monkeypatch.setattr(agglomeration, "LEAF", leaf)
    r = np.random.default_rng(len(shape))
    if shape == "groups":
        pts = np.concatenate([r.normal(c, 0.5, (230, 3)) for c in ((0, 0, 0), (3, 3, 0), (0, 6, 1))] + [[[40.0, 40.0, 40.0]], [[41.0, 40.0, 40.0]]])
    elif shape == "even":
        pts = r.uniform(0, 1, (700, 2))
    else:
        pts = np.stack([np.cumsum(r.uniform(0.9, 1.1, 500)), r.normal(0, 0.01, 500)], 1)
    pts = np.concatenate([pts, pts[:20], pts[:20]])
    names = list("xyz")[: pts.shape[1]]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ["id", *names])
    got = {x.id: x.cluster for x in agglomeration.ward(df, "id", names).collect()}
    scaled, where, n = np.unique((pts - pts.mean(0)) / pts.std(0), axis=0, return_inverse=True, return_counts=True)
    want = plain_ward(scaled, n.astype(float))[where.ravel()]
    assert [got[i] for i in range(len(pts))] == want.tolist()


def test_leaves_merge_by_themselves(spark, monkeypatch):
    """The tree of 700 rows in leaves of 16 equals that of the matrix, in far fewer rounds than turns of reciprocal neighbours."""
    monkeypatch.setattr(agglomeration, "FEW", 30)
    monkeypatch.setattr(agglomeration, "LEAF", 16)
    rounds = []
    plain = agglomeration.neighbours
    monkeypatch.setattr(agglomeration, "neighbours", lambda *a: rounds.append(1) or plain(*a))
    pts = np.random.default_rng(7).uniform(0, 1, (700, 2))
    got = agglomeration.merges(spark.createDataFrame([(i, 1.0, p.tolist()) for i, p in enumerate(pts)], "id long, n double, x array<double>")).collect()
    want = clusters.ward_tree(pts, np.ones(700))
    assert {(x.i, x.j) for x in got} == set(want) and len(got) == 699
    turns, left = agglomeration.merged_within(np.arange(700), np.ones(700), np.zeros(700), pts.copy(), *(np.zeros(s) for s in (0, (0, 2), (0, 2))))
    assert {(int(i), int(j)) for a, b, _ in turns for i, j in zip(a, b, strict=True)} == set(want) and len(left[0]) == 1
    assert 0 < len(rounds) < len(turns) / 2


def test_ward_judges_all_rows(spark):
    """6,500 different rows, of which the 4,000 first ones by a hash look like two clusters and all of them are three."""
    r = np.random.default_rng(0)
    some = np.zeros(6500, bool)
    some[[x.id for x in spark.range(6500).orderBy(F.xxhash64("id"), "id").limit(4000).collect()]] = True
    group = np.where(some, np.where(r.random(6500) < 0.3, 8, 0), 4)
    value = group + np.where(some, r.normal(0, 0.7, 6500), r.normal(0, 0.05, 6500))
    df = spark.createDataFrame([(i, i / 6500, *[float(v)] * 6) for i, v in enumerate(value)], ["id", *"abcdefg"])
    got = {x.id: x.cluster for x in agglomeration.ward(df, "id", list("abcdefg")).collect()}
    pairs = Counter((got[i], int(g)) for i, g in enumerate(group))
    assert set(got.values()) == {1, 2, 3} and sum(n for _, n in pairs.most_common(3)) > 6400


@pytest.mark.parametrize(("shape", "sent", "margin", "levels"), [("groups", 100_000, 1e-9, 1), ("even", 500, 1e-9, 2), ("twins", 900, 1.0, 3)])
def test_silhouettes_within_bounds(spark, monkeypatch, shape, sent, margin, levels):
    """Numbers of clusters by few cells, more cells and (as a margin of 1 excludes none) all rows equal those of the whole matrix; each bound holds, and the last means are equal."""
    for name, value in (("CELLS", 16), ("SENT", sent), ("MARGIN", margin), ("WIDE", 50), ("ROWS", 60), ("PAIRS", 50_000)):
        monkeypatch.setattr(agglomeration, name, value)
    r = np.random.default_rng(len(shape))
    if shape == "groups":
        pts = np.concatenate([r.normal(c, 0.5, (230, 3)) for c in ((0, 0, 0), (3, 3, 0), (0, 6, 1))] + [[[40.0, 40.0, 40.0]]])
    elif shape == "even":
        pts = r.uniform(0, 1, (700, 2))
    else:  # heavy tails, and each row beside another one that all but equals it
        pts = np.exp(r.normal(0, 1.5, (300, 2)))
        pts = np.concatenate([pts, pts + 1e-9])
    pts = np.concatenate([pts, pts[:20], pts[:20]])
    names = list("xyz")[: pts.shape[1]]
    scaled, where, n = np.unique((pts - pts.mean(0)) / pts.std(0), axis=0, return_inverse=True, return_counts=True)
    tree = clusters.ward_tree(scaled, n.astype(float))
    want = {k: clusters.silhouette(scaled, n.astype(float), clusters.cut(tree, len(scaled), k)) for k in range(2, 10)}
    plain, found = agglomeration.silhouettes, []
    monkeypatch.setattr(agglomeration, "silhouettes", lambda *a: found.append(plain(*a)) or found[-1])
    got = {x.id: x.cluster for x in agglomeration.ward(spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pts)], ["id", *names]), "id", names).collect()}
    best = max(want, key=lambda k: (round(want[k], 12), -k))
    assert [got[i] for i in range(len(pts))] == clusters.cut(tree, len(scaled), best)[where.ravel()].tolist()
    assert set(found[0]) == set(want) and all(low - 1e-9 < want[k] < high + 1e-9 for means in found for k, (low, high) in means.items())
    assert len(found) == levels and all(best in means for means in found)
    if levels == 3:
        assert all(low == high == pytest.approx(want[k], abs=1e-12) for k, (low, high) in found[2].items()) and set(found[2]) == set(want)


def test_ward_of_few_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 5.0), (2, 0.0, 5.0), (3, 1.0, 5.0)], "id long, x double, y double")
    assert {r.cluster for r in agglomeration.ward(rows, "id", ["x", "y"]).collect()} == {1}
    more = rows.union(spark.createDataFrame([(4, 9.0, 5.0)], "id long, x double, y double"))
    assert {r.id: r.cluster for r in agglomeration.ward(more, "id", ["x", "y"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 2}


def test_cells_agree_with_exact_ward(spark):
    """Well apart groups of 1,500 rows: labels as by the exact method for at least 95 in 100 rows."""
    r = np.random.default_rng(8)
    pts = np.concatenate([r.normal(c, 0.4, (375, 2)) for c in ((0, 0), (4, 4), (0, 5), (6, 0))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    exact = {x.id: x.cluster for x in agglomeration.ward(df, "id", ["x", "y"]).collect()}
    cells = {x.id: x.cluster for x in clusters.ward_of_cells(df, "id", ["x", "y"], 128).collect()}
    pairs = Counter((exact[i], cells[i]) for i in exact)
    best = Counter()
    for (a, _), n in pairs.items():
        best[a] = max(best[a], n)
    assert len(set(exact.values())) == len(set(cells.values())) == 4 and sum(best.values()) >= 0.95 * len(pts)


def test_overlap_removal_equals_the_plain_loop(spark):
    r = random.Random(9)
    rows = [("pq"[k % 2], a, a + r.randint(5, 40), r.randint(0, 50) / 10) for k in range(600) for a in [r.randint(1, 400)]]
    want = []
    for key in "pq":
        kept = []
        for _, a, b, s in sorted((x for x in rows if x[0] == key), key=lambda x: (-x[3], x[1], x[2])):
            if all(min(b, d) - max(a, c) + 1 < 0.5 * min(b - a + 1, d - c + 1) for c, d in kept):
                kept.append((a, b))
                want.append((key, a, b, s))
    df = spark.createDataFrame(rows, "p string, a int, b int, s double").repartition(4)
    for hot, rounds in ((1000, 12), (10, 12), (10, 1), (300, 0)):
        got = intervals.without_overlaps(df, "p", "a", "b", "s", hot=hot, rounds=rounds)
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    ladder = spark.createDataFrame([("p", 10 * k, 10 * k + 19, float(k)) for k in range(60)], "p string, a int, b int, s double")  # a chain of ever better ones
    want = {(x.a, x.b) for x in intervals.without_overlaps(ladder, "p", "a", "b", "s").collect()}
    assert {(x.a, x.b) for x in intervals.without_overlaps(ladder, "p", "a", "b", "s", hot=5, rounds=2).collect()} == want == {(10 * k, 10 * k + 19) for k in range(59, 0, -2)}


def test_fragments_of_a_row_equal_the_removal_by_key(spark, monkeypatch, capsys):
    """Sequences of several lengths, some repetitive (scores tie), null and empty; also where candidates are too many to be compared with all."""
    r = random.Random(8)
    seqs = ["".join(r.choices("ACDEFGHIKLMNPQRSTVWYX", k=r.choice((3, 20, 31, 64, 64)))) for _ in range(60)] + ["A" * 64, "AC" * 32, "ACDEF" * 20, "", None]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string").repartition(3)
    every = expansion.scored_fragments(df, "s", (20, 30))
    spans = every.select("id", "start", (F.col("start") + F.col("len") - 1).alias("end"), F.round("score", 9).alias("score"))
    want = sorted(map(tuple, intervals.without_overlaps(spans, "id", "start", "end", "score").collect()))
    for alike in (512, 10):
        monkeypatch.setattr(expansion, "ALIKE", alike)
        got = expansion.separate_fragments(df, "s", (20, 30))
        assert sorted(map(tuple, got.select("id", "start", (F.col("start") + F.col("len") - 1).alias("end"), F.round("score", 9)).collect())) == want
    got.explain()
    assert "Exchange hash" not in capsys.readouterr().out  # no fragment is moved


@pytest.mark.parametrize("best", [1, 7, 500])
def test_best_fragments_hold_the_first_of_all(spark, best):
    r = random.Random(9)
    seqs = ["".join(r.choices("AGC", k=40)) for _ in range(80)] + ["A" * 64] * 10
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, s string").repartition(2)
    first = lambda d: d.select("id", "start", "len", F.round("score", 9).alias("score")).orderBy(F.desc("score"), "id", "start", "len").limit(best).collect()
    some, every = expansion.scored_fragments(df, "s", (20, 25), best), expansion.scored_fragments(df, "s", (20, 25))
    assert first(some) == first(every) and (best > 7 or some.count() < every.count())
    assert every.columns == ["id", "len", "start", "score"]  # a sequence isn't copied to each of its fragments


def test_span_joins_equal_all_pairs(spark):
    """Spans of one position to thousands, at and below 0, with nulls and empty ones."""
    r = random.Random(12)
    spans = lambda n: [(r.choice("ab"), a, a + r.choice([0, 0, 1, 5, 63, 64, 1000, 5000, -1])) for _ in range(n) for a in [r.randint(-3000, 3000)]] + [("a", None, 5), ("c", 1, 2)]
    x, y = spans(150), spans(120)
    left, right = (spark.createDataFrame(v, "k string, start int, end int") for v in (x, y))
    real = lambda p: p[1] is not None and p[1] <= p[2]
    meet = [(p, q) for p in x for q in y if p[0] == q[0] and real(p) and real(q) and p[1] <= q[2] and q[1] <= p[2]]
    got = [(tuple(v.left), tuple(v.right)) for v in intervals.overlapping(left, right, ["k"]).collect()]
    assert sorted(got) == sorted(meet)
    got = [(tuple(v.left), tuple(v.right)) for v in intervals.overlapping(left, right, ["k"], within=True).collect()]
    assert sorted(got) == sorted((p, q) for p, q in meet if p[1] <= q[1] and q[2] <= p[2])
    assert intervals.overlapping(left.filter("false"), right.filter("false"), ["k"]).isEmpty()


def test_a_table_meets_itself_by_one_copy_of_its_spans(spark, monkeypatch):
    """Ends keep their own types, and are carried once."""
    tables = []
    monkeypatch.setattr(intervals, "written", lambda d, what, plain=intervals.written: tables.append(d) or plain(d, what))
    t = spark.createDataFrame([("a", 1, 5, 2.5), ("a", 4, 9, None), ("a", 30, 31, 1.0), ("b", 5, 5, 0.0)], "k string, start int, end smallint, v double")
    met = intervals.overlapping(t, t, ["k"])
    assert len(tables) == 1 and "row struct<v:double>" in ", ".join(f"{n} {kind}" for n, kind in tables[0].dtypes)
    assert met.select("left.*").dtypes == t.dtypes == met.select("right.*").dtypes
    assert sorted((tuple(x.left[1:3]), tuple(x.right[1:3])) for x in met.filter("left.k = 'a' AND left.start <> right.start").collect()) == [((1, 5), (4, 9)), ((4, 9), (1, 5))]


def test_overlap_removal(spark):
    rows = spark.createDataFrame([("p", 1, 20, 9.0), ("p", 10, 29, 8.0), ("p", 15, 34, 7.0), ("q", 1, 20, 1.0)], "p string, a int, b int, s double")
    got = sorted((r.p, r.a) for r in intervals.without_overlaps(rows, "p", "a", "b", "s").collect())
    assert got == [("p", 1), ("p", 15), ("q", 1)]


# --- expansion -----------------------------------------------------------


def test_scan_and_mutants(spark):
    rows = spark.createDataFrame([(1, "MKP", "2", "2"), (2, "MKPWC", "1-2, 2", "3"), (3, "MKP", "", "2"), (4, "MKP", "2", "0")], "id long, seq string, regions string, copies string")
    assert [r.mutant for r in expansion.single_position_scan(rows.filter("id = 1"), "seq", "regions").collect()] == ["MRP", "MQP"]
    got = expansion.mutants(rows, "id", "seq", "regions", "copies").collect()
    assert sorted((r.id, r.copy, r["mode"]) for r in got) == [(1, 1, "random"), (1, 2, "random"), (2, 1, "random"), (2, 2, "random"), (2, 3, "random"), (3, 0, "skipped")]
    assert all(r.mutant[1] != "K" and r.mutant[0] == "M" and r.mutant[2] == "P" for r in got if r.id == 1)
    assert all(r.mutant[0] != "M" and r.mutant[2:] == "PWC" for r in got if r.id == 2)


def test_samples_and_libraries(spark):
    got = expansion.sampled(spark, "NRA", 4000).collect()
    counts = Counter(r.seq[0] for r in got)
    assert all(850 < counts[b] < 1150 for b in "ACGT") and {r.seq[1:] for r in got} == {"AA", "GA"}
    assert {r.seq for r in expansion.library(spark, "RYA").collect()} == {"ACA", "ATA", "GCA", "GTA"}
    assert expansion.library(spark, "N" * 12, most=1000, sample=50).agg(F.sum("weight")).first()[0] == pytest.approx(4**12)
    unique = expansion.unique_proteins(expansion.sampled(spark, "NNKNNK", 500), 40).collect()
    assert len({r.protein for r in unique}) == 40 and not any("*" in r.protein for r in unique)


def test_error_prone(spark):
    rows = spark.range(3000).select("id", F.repeat(F.lit("ACGT"), F.lit(25)).alias("seq"))
    got = expansion.error_prone(rows, "id", "seq", 0.05).select("n_mutations", "mutations", "mutant").collect()
    assert 4.7 < np.mean([r.n_mutations for r in got]) < 5.3
    assert all(sum(a != b for a, b in zip(r.mutant, "ACGT" * 25, strict=True)) == r.n_mutations for r in got)
    changes = Counter(m[0] + m[-1] for r in got if r.mutations != "WT" for m in r.mutations.split(";"))
    transitions = sum(changes[k] for k in ("AG", "GA", "CT", "TC")) / sum(changes.values())
    assert 0.3 < transitions < 0.37
    biased = expansion.error_prone(rows, "id", "seq", 0.05, bias={b: {x: float(x == "A" or (b == "A" and x == "C")) for x in "ACGT" if x != b} for b in "ACGT"})
    assert {m[-1] for r in biased.collect() if r.mutations != "WT" for m in r.mutations.split(";")} == {"A", "C"}
    assert expansion.compounded(0.006, 25) == pytest.approx(0.1397, abs=1e-4)


def test_motif_versions(spark):
    rows = spark.createDataFrame([("KPEV+KPEV+",)], "raw string").withColumn("key", F.lit(1))
    got = expansion.triplicated(rows, "key", "raw", ["GA", "LV"]).collect()
    assert len(got) == 7 and {r.sequence for r in got if r["set"] == 1} == {"KPEVKPEV"}
    assert all(len(r.sequence) == 12 for r in got if r["set"] == 2)
    assert expansion.slot_mixes([25, 50], 3) == {25: [(3, 1), (1, 2)], 50: [(8, 1), (6, 2), (4, 3), (2, 4)]}


# --- fuzzy reads ---------------------------------------------------------


def plain_alignment(a, b, codes):
    same = lambda x, y: x == y or (codes and y in IUPAC.get(x, ""))
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j - 1] + (not same(a[i - 1], b[j - 1])), d[i - 1, j] + 1, d[i, j - 1] + 1)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and d[i, j] == d[i - 1, j - 1] + (not same(a[i - 1], b[j - 1])):
            i, j = i - 1, j - 1
            out.append((a[i], "|" if same(a[i], b[j]) else ".", b[j]))
        elif i and d[i, j] == d[i - 1, j] + 1:
            i -= 1
            out.append((a[i], " ", "-"))
        else:
            j -= 1
            out.append(("-", " ", b[j]))
    return (d[len(a), len(b)], *("".join(x[k] for x in reversed(out)) for k in range(3)))


def infix_plain(p, t):
    row = list(range(len(p) + 1))
    best, end = row[-1], -1
    for j, c in enumerate(t):
        new = [0]
        for i, x in enumerate(p):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        if row[-1] < best:
            best, end = row[-1], j
    return best, end


def test_infix_search():
    """Distances, first ends and farthest starts against the whole matrix, for patterns of one word and of several."""
    import pandas as pd

    def start_plain(p, t, best, end):
        return min(k for k in range(end + 2) if levenshtein(p, t[k : end + 1]) == best)

    def levenshtein(p, t):
        row = list(range(len(t) + 1))
        for i, x in enumerate(p):
            new = [i + 1]
            for j, c in enumerate(t):
                new.append(min(row[j] + (x != c), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    r = random.Random(8)
    for pattern, n in (("ACGTTGCA", 150), ("".join(r.choices("ACGT", k=64)), 12), ("".join(r.choices("ACGT", k=130)), 8)):
        texts = ["".join(r.choice("ACGT") for _ in range(r.randint(0, 40))) for _ in range(n)]
        texts += ["TT" + "".join(c for c in pattern if r.random() > 0.1) + "".join(r.choices("ACGT", k=9)) for _ in range(n)] + [pattern, "", pattern[:-1]]
        got = fuzzy.infix(pattern, pd.Series([*texts, None]), len(pattern))
        want = [(d, start_plain(pattern, t, d, e) if e >= 0 else 0, e) for t in texts for d, e in [infix_plain(pattern, t)]]
        assert [tuple(x) for x in got.to_numpy().tolist()] == [*want, (len(pattern), 0, -1)]
    assert fuzzy.infix("ARG", pd.Series(["TTACGTT", "TTAGGTT"]), 0, codes=True).to_numpy().tolist() == [[-1, -1, -1], [0, 2, 4]]


def test_long_alignments(monkeypatch):
    """Within a band and from few kept rows as from whole matrices; long pairs in little memory."""
    import tracemalloc

    r = random.Random(6)
    a, b = (["".join(r.choice("ACGTN") for _ in range(r.choice((0, 1, 5, 40, 90, 200)))) for _ in range(60)] for _ in range(2))
    b += ["".join(c for c in x if r.random() > 0.1) for x in a]
    a += a
    for codes in (False, True):
        assert [fuzzy.banded_alignment(x, y, codes) for x, y in zip(a, b, strict=True)] == [plain_alignment(x, y, codes) for x, y in zip(a, b, strict=True)]
    long = "".join(r.choices("ACGT", k=20_000))
    other = "".join(c for c in long if r.random() > 0.01)
    tracemalloc.start()
    distance, top, _, bottom = fuzzy.edit_alignments([long], [other])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert distance == len(long) - len(other) and top == long and bottom.replace("-", "") == other and most < 100_000_000


def test_anchored_windows(spark):
    left, right = "ACGTTGCAAGCT", "GGATCCTTAACC"
    whole = "TTT" + left + "AAACCC" + right + "GG"
    flip = whole[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows = spark.createDataFrame([(1, whole), (2, flip), (3, "T" * 30), (4, "TTT" + left + "AA"), (5, "TTT" + left + "AAACCC" + "T" * 14), (6, whole.replace("TTGC", "TAGC"))], "id long, seq string").withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    got = {r.id: (r.strand, r.status, r.window) for r in fuzzy.anchored_windows(rows, "seq", "qual", left, right, 6, 2).collect()}
    assert got == {1: ("+", "direct", "AAACCC"), 2: ("-", "direct", "AAACCC"), 3: ("?", "no_left_anchor", None), 4: ("+", "short_window", "AA"), 5: ("+", "indel_in_right_window", "AAACCC"), 6: ("+", "direct", "AAACCC")}


def test_alignments(spark):
    assert fuzzy.edit_alignments(["ACGT"], ["AGT"]) == [(1, "ACGT", "| ||", "A-GT")]
    r = random.Random(4)
    a, b = (["".join(r.choice("ACGTN") for _ in range(r.choice((0, 1, 5, 12, 40)))) for _ in range(300)] for _ in range(2))
    for codes in (False, True):
        assert fuzzy.edit_alignments(a, b, codes) == [plain_alignment(x, y, codes) for x, y in zip(a, b)]
    rows = spark.createDataFrame([("ACGTACGT", "ACGACGT")], "a string, b string")
    got = fuzzy.alignment_blocks(fuzzy.aligned(rows, "a", "b"), 4).orderBy("block").collect()
    assert [(r.line_top, r.line_bottom, r.end_top, r.end_bottom) for r in got] == [("ACGT", "ACG-", 4, 3), ("ACGT", "ACGT", 8, 7)]
    read = spark.createDataFrame([("ACGTAGGCA",), ("ACGTGGCA",), ("ACATCGGCA",), (None,)], "s string")
    assert [r.rescued for r in fuzzy.rescued(read, "s", "ACGTAGGCA", 4, 6, 4).collect()] == ["TAG", None, "TCG", None]
    assert fuzzy.rescued(read.limit(1), "s", "ACGNNNGCA", 4, 6).first().rescued == "TAG"


def test_single_alignments_equal_those_of_batches(monkeypatch):
    r = random.Random(11)
    pairs = [("".join(r.choices(letters, k=r.randrange(n))), "".join(r.choices(letters, k=r.randrange(n)))) for letters in ("AC", "ACGT", "Añ\U0001f600") for n in (1, 4, 30, 90) for _ in range(40)]
    pairs += [(a, a[: len(a) // 2] + "G" + a[len(a) // 2 + 1 :]) for a, _ in pairs] + [("", ""), ("", "ACG"), ("ACG", "")]
    want = fuzzy.edit_alignments([a for a, _ in pairs], [b for _, b in pairs])
    assert [fuzzy.edit_alignment(a, b) for a, b in pairs] == want
    monkeypatch.setattr(fuzzy, "edit_alignments", None)  # a row's table function makes no arrays of one pair
    assert next(iter(table_functions.EditAlignment().eval("ACGT", "AGT"))) == (1, "ACGT", "| ||", "A-GT")
    monkeypatch.setattr(fuzzy, "CELLS", 100)
    assert fuzzy.edit_alignment("ACGTACGTACGT", "ACGACGTACG")[0] == 2


def test_cigar_and_flags(spark):
    rows = spark.createDataFrame([("r", 0, 10, "2S3M1D2M1I1M", "TTACGTTAG", "IIIIIIII!"), ("r", 0, 50, "1M", "A", "I"), ("s", 4, 1, "1M", "A", "I"), ("t", 2048, 1, "1M", "A", "I")], "qname string, flag int, pos int, cigar string, seq string, qual string")
    kept = fuzzy.usable_alignments(rows)
    got = fuzzy.observed_bases(kept).orderBy("ref_pos").collect()
    assert [(r.ref_pos, r.base, r.q) for r in got] == [(10, "A", 40), (11, "C", 40), (12, "G", 40), (13, "-", 0), (14, "T", 40), (15, "T", 40), (16, "G", 0)]


def test_trajectories(spark):
    r = random.Random(4)
    box, rows = 5.0, [(f, c, b, r.uniform(0, 5), r.uniform(0, 5), r.uniform(0, 5)) for f in range(3) for c in range(6) for b in range(8)]
    df = spark.createDataFrame(rows, "frame int, chain int, bead int, x double, y double, z double")
    want = Counter()
    near = lambda d: d - box * round(d / box)
    for p in rows:
        for q in rows:
            if p[0] == q[0] and p[1] < q[1] and sum(near(i - j) ** 2 for i, j in zip(p[3:], q[3:], strict=True)) <= 0.49:
                want[p[0], p[1], q[1]] += 1
    pairs = trajectory.contacts(df, box, 0.7)
    assert {(x.frame, x.a, x.b): x.n for x in pairs.collect()} == want
    got = trajectory.chain_clusters(pairs, df.select("frame", "chain").distinct(), (1, 5)).collect()
    assert len(got) == 6 and all(x.largest <= 6 for x in got)
    line = spark.createDataFrame([(0, 0, b, (4.5 + b) % 5, 1.0, 1.0) for b in range(3)], "frame int, chain int, bead int, x double, y double, z double")
    assert trajectory.gyration(line, box).first().rg == pytest.approx(math.sqrt(2 / 3))


@pytest.mark.parametrize("box", [0.9, 1.5, 2.2, 3.0])
def test_contacts_in_boxes_of_few_cells_without_a_broadcast(spark, box, capsys):
    r = random.Random(7)
    rows = [(f, c, b, r.uniform(0, box), r.uniform(0, box), r.uniform(0, box)) for f in range(2) for c in range(5) for b in range(6)]
    near = lambda d: d - box * round(d / box)
    want = Counter((p[0], p[1], q[1]) for p in rows for q in rows if p[0] == q[0] and p[1] < q[1] and sum(near(i - j) ** 2 for i, j in zip(p[3:], q[3:], strict=True)) <= 0.49)
    pairs = trajectory.contacts(spark.createDataFrame(rows, "frame int, chain int, bead int, x double, y double, z double"), box, 0.7)
    assert {(x.frame, x.a, x.b): x.n for x in pairs.collect()} == want
    pairs.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_equilibration(spark):
    r = np.random.default_rng(5)
    settled = np.concatenate([np.linspace(10, 0, 100), np.zeros(300)]) + r.normal(0, 0.3, 400)
    rows = [("a", k, float(v)) for k, v in enumerate(settled)] + [("flat", k, 1.0) for k in range(10)] + [("one", 0, 2.0)]
    got = {x.s: x for x in trajectory.equilibration(spark.createDataFrame(rows, "s string, k int, v double"), "s", "k", "v").collect()}
    assert 80 <= got["a"].start <= 160 and got["flat"].start == 0 and got["one"].n_effective == 1.0
    assert trajectory.inefficiency(r.normal(0, 1, 4000)) < 1.3


def plain_inefficiency(x, least=3):
    n, d = len(x), x - x.mean()
    variance = (d * d).mean()
    if variance <= 0:
        return 1.0
    g = 1.0
    for t in range(1, n - 1):
        c = (d[: n - t] * d[t:]).sum() / ((n - t) * variance)
        if c <= 0 and t > least:
            break
        g += 2 * c * (1 - t / n)
    return max(1.0, g)


def test_inefficiencies_equal_the_plain_loop(spark):
    """To 1e-9, on noise, drifts, whole numbers whose autocorrelations vanish, and short and flat series; many series at once, null keys too."""
    r = np.random.default_rng(7)
    for n in (1, 2, 3, 4, 5, 8, 37, 400):
        rows = [r.normal(0, 1, n), np.cumsum(r.normal(0, 1, n)), np.arange(n) % 4.0, np.arange(n) % 2 * 2.0 - 1, np.ones(n), r.integers(0, 2, n).astype(float), np.linspace(0, 1, n)]
        got = trajectory.inefficiencies(np.array(rows))
        assert got == pytest.approx([plain_inefficiency(x) for x in rows], abs=1e-9)
    series = {k: r.normal(0, 1, int(r.integers(1, 30))) + np.linspace(3, 0, 1) for k in [None, *range(60)]}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "s long, i int, v double").repartition(3)
    got = {x.s: (x.start, x.g, x.n_effective) for x in trajectory.equilibration(df, "s", "i", "v").collect()}
    for k, x in series.items():
        tried = [(t, plain_inefficiency(x[t:])) for t in range(0, len(x) - 2, max(1, len(x) // 20))] if len(x) > 2 and x.std() > 0 else [(0, 1.0)]
        t, g = max(tried, key=lambda a: ((len(x) - a[0]) / a[1], -a[0]))
        assert got[k] == pytest.approx((t, g, (len(x) - t) / g), abs=1e-9)
    assert trajectory.inefficiency(np.cumsum(r.normal(0, 1, 1_000_000))) > 1000


def test_sketches_of_samples(spark):
    """Merged sketches equal those of all rows; overlaps within the bound of their size, exact below it."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("s"), (F.col("id") % 7).alias("day"), F.concat(F.lit("v"), F.col("id") * 7919 % 15_000).alias("v"))
    rows = rows.unionByName(rows.limit(100).withColumn("v", F.lit(None).cast("string")))
    exact = {(x.a, x.b): (x.shared, x.either) for x in rows.alias("p").join(rows.alias("q"), F.col("p.v") == F.col("q.v")).filter("p.s < q.s").groupBy(F.col("p.s").alias("a"), F.col("q.s").alias("b")).agg(F.countDistinct("p.v").alias("shared")).withColumn("either", F.lit(0)).collect()}
    sizes = {x.s: x.n for x in rows.groupBy("s").agg(F.countDistinct("v").alias("n")).collect()}
    for size, bound in ((16, 0.0), (10, 5 / 2**5)):
        days = sketches.sketched(rows, ["s", "day"], "v", size)
        whole = {x.s: (x.n, x.d) for x in sketches.sketched(rows, ["s"], "v", size).select("s", "n", sketches.distinct_values().alias("d")).collect()}
        merged = sketches.merged(days, ["s"], size)
        assert {x.s: (x.n, x.d) for x in merged.select("s", "n", sketches.distinct_values().alias("d")).collect()} == whole
        assert all(abs(whole[s][1] - n) <= bound * n for s, n in sizes.items())
        for x in sketches.overlaps(merged, "s", size).collect():
            either = sizes[x.a] + sizes[x.b] - exact[x.a, x.b][0] if (x.a, x.b) in exact else sizes[x.a] + sizes[x.b]
            shared = exact.get((x.a, x.b), (0, 0))[0]
            assert abs(x.shared - shared) <= bound * either and abs(x.either - either) <= bound * either
            assert x.jaccard == pytest.approx(x.shared / x.either)


def test_sketches_of_slices_are_exact_at_any_number(spark):
    """More values than a sketch holds, a null, and a sample with none of the others' values."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 5 < 3, "a").otherwise("b").alias("s"), (F.col("id") % 9_000).alias("v"))
    rows = rows.unionByName(spark.sql("SELECT 'c' AS s, -1L AS v UNION ALL SELECT 'c', NULL UNION ALL SELECT 'd', NULL"))
    has = {s: {x.v for x in rows.filter(F.col("s") == s).filter("v is not null").distinct().collect()} for s in "abcd"}
    many = sketches.slices(rows, "v", 8)
    days = sketches.sketched(sketches.sliced(rows, "v", many), ["s", "slice"], "v", 8)
    got = {(x.a, x.b): (x.in_a, x.in_b, x.shared, x.either) for x in sketches.overlaps(days, "s", 8, "slice").collect()}
    assert many > 100 and got == {(a, b): (len(has[a]), len(has[b]), len(has[a] & has[b]), len(has[a] | has[b])) for a in "abcd" for b in "abcd" if a < b}


def test_table_functions(spark):
    register_table_functions(spark)
    spark.createDataFrame([("r1", 10, "2S3M1D2M1I1M", "TTACGTTAG", "IIIIIIII!"), ("r2", 50, "1M", "A", "*")], "qname string, pos int, cigar string, seq string, qual string").createOrReplaceTempView("observed")
    got = sorted(map(tuple, spark.sql("SELECT * FROM cigar_obs(TABLE(observed) PARTITION BY qname)").collect()))
    want = fuzzy.observed_bases(spark.table("observed")).select("qname", "ref_pos", "base", "q")
    assert got == sorted(map(tuple, want.collect()))
    rows = spark.sql("SELECT qname, pos2, codon FROM observed, LATERAL explode_residues(seq, 3) AS t(pos2, codon)").collect()
    assert sorted(map(tuple, rows)) == [("r1", 1, "TTA"), ("r1", 2, "CGT"), ("r1", 3, "TAG")]
    assert spark.sql("SELECT * FROM explode_residues('AC')").columns == ["pos", "residue"] and spark.sql("SELECT * FROM explode_residues(CAST(NULL AS STRING))").isEmpty()
    assert [tuple(x) for x in spark.sql("SELECT * FROM edit_alignment('ACGTACGT', 'ACGACGT', 4) ORDER BY block").collect()] == [(1, 1, "ACGT", "||| ", "ACG-"), (1, 2, "ACGT", "||||", "ACGT")]
    for wrong in ("explode_residues(1)", "explode_residues('A', 0)", "edit_alignment('A', 'B', pos)", "cigar_obs(TABLE(SELECT 1 AS pos))"):
        with pytest.raises(Exception, match=r"must be|lacks"):
            spark.sql(f"SELECT t.* FROM observed, LATERAL {wrong} t").collect()


# --- files ---------------------------------------------------------------


def write(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "a.fasta", "﻿>one first record\nACG\nTTT\n\n>two\nacg t\r\n>two\nGG\n")
    got = text.read_fasta(spark, path).collect()
    assert [tuple(r) for r in got] == [("one", "one first record", "ACGTTT"), ("two", "two", "ACGT"), ("two", "two", "GG")]
    assert text.read_fasta(spark, path, upper=False).collect()[1].seq == "acgt"
    with pytest.raises(ValueError, match="not aligned"):
        text.read_fasta(spark, path, aligned=True)
    loose = write(tmp_path, "b.fasta", "ACG\nT\n>one\nGG\n")
    with pytest.raises(ValueError, match="before a first header"):
        text.read_fasta(spark, loose)
    assert {(r.name, r.header, r.seq) for r in text.read_fasta(spark, loose, strict=False).collect()} == {("", "", "ACGT"), ("one", "one", "GG")}
    last = text.last_by_name(spark.createDataFrame([("a", "X", 1), ("a", "Y", 2)], "name string, seq string, ord int"), "ord").first()
    assert last.seq == "Y"


def test_fastq(spark, tmp_path):
    path = write(tmp_path, "a.fastq", "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+r2\n+@\n")
    assert [tuple(r)[:3] for r in text.read_fastq(spark, path).orderBy("ord").collect()] == [("r1 x", "ACGT", "@III"), ("r2", "AC", "+@")]
    assert text.count_fastq(spark, path) == 2
    assert text.read_fastq(spark, write(tmp_path, "none.fastq", "")).isEmpty()
    with pytest.raises(Exception, match="no read"):
        text.read_fastq(spark, write(tmp_path, "b.fastq", "@r1\nACGT\n+\nII\n")).collect()


def test_quoted_line_feeds_in_ranges(spark, tmp_path):
    """One file of many ranges as by the reader that takes it whole: line feeds, commas, doubled quotes and number signs in quotes, comment lines with a quote, both line ends."""
    r = random.Random(6)
    cell = lambda: r.choice(["a", "b c", "", '"x,y"', '"two\nlines"', '"say ""hi"""', '"\n# no comment\n"', '"a\n\n\nb"', "é"])
    lines = ['id,"name, long",n,']
    for k in range(400):
        lines += ['# it"s a note'] if k % 17 == 0 else [] if k % 29 else ["", "  # another"]
        lines.append(f"{k},{cell()},{cell()}," if k % 5 else f"{k},{cell()}")
    path = write(tmp_path, "q.csv", "\n".join(lines) + "\n")
    whole = spark.read.option("multiLine", True).option("header", True).option("comment", "#").option("escape", '"').csv(write(tmp_path, "plain.csv", "\n".join(x for x in lines if not x.strip().startswith("# ") or "\n" in x) + "\n"))
    want = sorted(((x[0], x[1] or None, x[2] or None) for x in whole.collect()), key=str)
    assert len(want) == 400
    for size in (13, 64, 1000, 1 << 20):
        got = text.read_csv(spark, path, multi_line=True, range_bytes=size)
        assert got.columns == ["id", "name, long", "n"]
        assert sorted(map(tuple, got.collect()), key=str) == want
        assert size > 10_000 or got.rdd.getNumPartitions() > 1
    plain = text.read_csv(spark, write(tmp_path, "h.csv", 'id,"name, long",n\n1,x,2\n'))
    assert plain.columns == ["id", "name, long", "n"] and tuple(plain.first()) == ("1", "x", "2")


def test_fastq_in_ranges(spark, tmp_path):
    """Equal rows for any range, also with qualities that begin with @ or +, empty reads, line ends of two bytes and a compressed file; bad records name their byte."""
    r = random.Random(4)
    reads = []
    for k in range(300):
        n = r.choice([0, 1, 1, 7, 40])
        reads.append((f"r{k}", "".join(r.choices("ACGT", k=n)), "".join(r.choices("@+I#", k=n))))
    body = "".join(f"@{a}{e}{b}{e}+{e}{c}{e}" for k, (a, b, c) in enumerate(reads) for e in ["\r\n" if k % 7 == 0 else "\n"])
    (tmp_path / "in").mkdir()
    write(tmp_path, "in/a.fastq", body)
    with gzip.open(tmp_path / "in" / "b.fastq.gz", "wt", newline="") as f:
        f.write(body)
    want = [(*x, k) for k, x in enumerate(reads + reads)]
    for size in (97, 1000, 1 << 20):
        rows = text.read_fastq(spark, str(tmp_path / "in"), range_bytes=size)
        assert "Exchange" not in rows._jdf.queryExecution().toString()
        assert [tuple(x) for x in rows.orderBy("ord").collect()] == want
    store = fastq.opened("/")[0]
    starts = {at: k for k, (at, _) in enumerate(fastq.lines(store, str(tmp_path / "in" / "a.fastq"), 0))}
    for at in range(len(body)):
        first = fastq.first_record(store, str(tmp_path / "in" / "a.fastq"), at)
        line = next((k for a, k in starts.items() if a >= at), None)
        assert first == (None if line is None else -line % 4)
    with pytest.raises(Exception, match=r"c.fastq, byte 14"):
        text.read_fastq(spark, write(tmp_path, "c.fastq", "@r1\nACG\n+\nIII\n@r2\nAC\n+\n")).collect()


def test_tolerant_csv(spark, tmp_path):
    path = write(tmp_path, "a.csv", "# made: by hand\nseq,n,,empty,,\nAC,1,,,\n  # note\nGT,2 # x,,,\n")
    assert [tuple(r) for r in text.read_csv(spark, path).collect()] == [("AC", "1"), ("GT", "2 # x")]
    assert [tuple(r) for r in text.read_csv(spark, path, "anywhere").collect()] == [("AC", "1"), ("GT", "2")]
    assert [tuple(r) for r in text.read_metadata(spark, path).collect()] == [("made", "by hand")]


def test_parameters(spark, tmp_path):
    path = write(tmp_path, "w.txt", "# position weight\n2 0.5\n4 3 # hot\n")
    assert [r.weight for r in text.read_weights(spark, path, 4).orderBy("position").collect()] == [1.0, 0.5, 1.0, 3.0]
    with pytest.raises(Exception, match="out of range"):
        text.read_weights(spark, path, 3).collect()
    ok = write(tmp_path, "b.json", '{"A":{"C":1,"G":2,"T":1},"C":{"A":1,"G":1,"T":0},"G":{"A":1,"C":1,"T":1},"T":{"A":1,"C":1,"G":2}}')
    assert text.read_bias(spark, ok)["A"] == {"C": 0.25, "G": 0.5, "T": 0.25}
    with pytest.raises(ValueError, match="weights of A"):
        text.read_bias(spark, write(tmp_path, "c.json", '{"A":{"C":1}}'))
    with pytest.raises(Exception, match="can't be read"):
        text.read_counts(spark, write(tmp_path, "d.csv", "aa_variant,count\nAC,x\n")).collect()

    template = write(tmp_path, "t.fa", ">t\nAC GT\n")
    assert text.read_template(spark, template) == "ACGT" and text.first_record(spark, write(tmp_path, "u.txt", "NNK\n")) == "NNK"
    with pytest.raises(ValueError, match="more than one"):
        text.read_template(spark, write(tmp_path, "v.fa", ">t\nAC\n>u\nGT\n"))


def test_samples_and_bundles(spark, tmp_path):
    path = write(tmp_path, "s.csv", "aa_variant,count,gravy,error\nac,2,0.5,\nGT,0,1.5,\n")
    assert [tuple(r) for r in text.read_sample(spark, path, ["gravy"]).collect()] == [("AC", 2, 0.5)]
    for body in ("aa_variant,count,gravy\nAC,2,x\n", "aa_variant,count,gravy\nAC,-2,1\n", "aa_variant,count,gravy,error\nAC,2,1,bad\n"):
        with pytest.raises(ValueError, match="can't be used"):
            text.read_sample(spark, write(tmp_path, "bad.csv", body), ["gravy"])
    counts, traits = write(tmp_path, "c.csv", "cluster,a_reads\n1,5\n2,1\n"), write(tmp_path, "t.csv", "cluster,feature,a\n1,g,1\n2,g,2\n")
    good, bad = write(tmp_path, "m.csv", "aa_variant,cluster,a_reads\nX,1,3\nY,1,2\nZ,2,1\n"), write(tmp_path, "n.csv", "aa_variant,cluster,a_reads\nX,1,3\nZ,2,1\n")
    assert len(text.read_clusters(spark, counts, traits, good, ["a"])) == 3
    with pytest.raises(ValueError, match="add up"):
        text.read_clusters(spark, counts, traits, bad, ["a"])


# --- columns, calling, models -------------------------------------------


def test_columns(spark):
    df = spark.createDataFrame([(" AC ", 1, 2.0, "x")], "`Protein_Sequence` string, n int, d double, s string")
    assert columns.find_column(df.columns) == "Protein_Sequence" and columns.find_column(df.columns, "prot", fuzzy=True) == "Protein_Sequence"
    with pytest.raises(ValueError, match="none of"):
        columns.find_column(df.columns, "prot")
    assert columns.sequences(df).first().sequence == "AC" and columns.sequences(df, keep_blank=True).first().sequence == " AC "
    assert columns.shared_features([df, df.drop("n")]) == ["d"]
    assert columns.with_columns(df, {"error": "string", "m": "double"}, ["error"]).first().asDict()["error"] == ""
    assert columns.by_position(df, ["a", "b"]).columns == ["a", "b"]
    got, skipped = columns.derived_sums(df, {"t": ("n", "d"), "u": ("n", "zz")})
    assert got.first().t == 3.0 and skipped == ["u"]


def test_calling(spark):
    rows = [("a", 0, 1, 30, "4M", "ACGT", "IIII"), ("b", 0, 1, 30, "4M", "AGGA", "IIII"), ("c", 0, 1, 5, "4M", "ACGT", "IIII"), ("d", 0, 1, 30, "4M", "ACGT", "I!II"), ("e", 0, 3, 30, "2M", "GT", "II"), ("f", 0, 1, 30, "4M", "ATGT", "IIII")]
    sam = spark.createDataFrame(rows, "qname string, flag int, pos int, mapq int, cigar string, seq string, qual string")
    got = calling.call(sam, "ACGT", "ASGT")
    assert {r.qname: (r.status, r.hap) for r in got.reads.collect()} == {"a": ("assigned", "C"), "b": ("assigned", "G"), "c": ("low_mapq", None), "d": ("incomplete_or_low_baseq", None), "e": ("incomplete_or_low_baseq", None), "f": ("invalid_design", "T")}
    p = got.positions.first()
    assert (p.pos, p.A, p.C, p.G, p["T"], p.missing, p.low_quality) == (2, 0, 1, 1, 1, 1, 1)
    assert {r.pos: (r.callable, r.mismatches) for r in got.fixed.collect()}[4] == (5, 1)
    v = {r.hap: r for r in calling.variants(got.reads, "ACGT", "ASGT").collect()}
    assert (v["G"].sequence, v["G"].nt_changes, v["G"].frequency) == ("AGGT", "C2G", 0.5)


def test_models(spark):
    df = spark.createDataFrame([("KKKKKKEEEEEE",), ("KEKEKEKEKEKE",), ("GGGGGG",), ("AUZ",)], "s string")
    got = [r.k for r in df.select(models.kappa(F.col("s")).alias("k")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] < 0.1 and got[2] is None
    assert df.select(models.tokens(F.col("s")).alias("t")).collect()[3].t == "A X X"
    assert [r.n for r in models.predicted(df, "s", "n", lambda: lambda ts: [len(t.split()) for t in ts]).collect()] == [12.0, 12.0, 6.0, 3.0]
    wide = models.long_predictions(df.withColumnRenamed("s", "sequence"), {"a": lambda: lambda ts: [1.0] * len(ts), "b": lambda: lambda ts: [2.0] * len(ts)})
    assert wide.count() == 8


def test_pools_and_counts(spark):
    rows = spark.range(405).withColumnRenamed("id", "k")
    got = [r.motif for r in expansion.patterned_motifs(rows, "k", ["k"], 5).collect()]
    kind = {r: "n" if r in "ED" else "p" if r in "KR" else "o" if r in "GP" else "t" for r in "EDKRGPSTQNH"}
    assert len({"".join(kind[r] for r in m[:-1]) for m in got}) == 405 and all(sum(r in "GP" for r in m) == 1 for m in got)
    assert all(len(m.motif) == 5 and m.motif[1] == "P" for m in expansion.anchored_motifs(rows, ["k"]).collect())
    df = spark.createDataFrame([("MKP", "1-2, 2")], "s string, r string")
    assert tuple(df.select(expansion.combinations(F.col("s"), F.col("r")), expansion.combinations(F.col("s"), F.col("r"), "random", True)).first()) == ("4", "400")
    assert 10 < expansion.unique_until_stalled(spark, "NNKATG", 30).count() <= 20


def test_oversampled_buckets_have_upper_bounds(spark):
    lengths = [0, 154, 155, 156, 271, 272, 1083, 1084, 1199, 1200, 5000, None] + [300] * 40
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, length int")
    got = clusters.oversampled(rows, "length").collect()
    bucket = {r.id: r.bucket for r in got}
    assert [bucket[k] for k in range(12)] == [0, 0, 0, 1, 1, 2, 8, 9, 9, 10, 10, None]
    assert len(bucket) == len(lengths)  # no row is lost
    whole = {b: sum(v == b for v in bucket.values()) for b in range(10)}
    for r in got:
        train = len({x.id for x in got if x.bucket == r.bucket and x.part == "train"})
        assert r.copies == (round(max(whole.values()) / train) if r.part == "train" and r.bucket in range(10) else 1)


def test_most_segregated_order_equals_the_full_search():
    r = random.Random(2)
    for k in range(30):
        p, m, rest = r.randint(1, 9), r.randint(1, 9), r.randint(4, 17)
        if k > 25:
            p, m, rest = (p, 0, rest + 20) if k % 2 else (0, m, rest + 20)
        full = max(models._delta(np.concatenate([np.zeros(a), np.ones(p), np.zeros(rest - a - b), -np.ones(m), np.zeros(b)])) for a in range(rest + 1) for b in range(rest - a + 1))
        assert models._most_segregated(p, m, rest) == pytest.approx(full, abs=1e-12)


def test_recombined_strings(spark):
    pool = lambda k: spark.createDataFrame([(i, c * k + "+") for i, c in enumerate("ACDE")], "ord long, motif string")
    got = expansion.recombined({4: pool(4), 5: pool(5), 10: pool(10)}, [25, 50], 3, 4).collect()
    assert {r.motif_type for r in got if r.target_length == 25} == {"4aa", "5aa", "mixed_3x5aa_1x10aa", "mixed_1x5aa_2x10aa"}
    for r in got:
        parts = r.raw.split("+")[:-1]
        assert len(parts) == r.n_repeats and abs(sum(map(len, parts)) - r.target_length) <= 3
        if r.motif_type.startswith("mixed"):
            assert sorted(map(len, parts)) == [5] * int(r.motif_type[6:].split("x")[0]) + [10] * int(r.motif_type.split("_")[2].split("x")[0])
    assert len({r.raw for r in got}) > len(got) / 2
    assert {len(r.raw.split("+")) for r in expansion.recombined({5: pool(5), 10: pool(10).limit(0)}, [25], 3, 2).collect()} == {6}


def test_csv_first_lines(spark, tmp_path):
    for k, body in enumerate(("# a\n#b\nid,kind\n#1,x\n2,y\nid,kind\n", "id,kind\n3,z\n", "4,no header\n")):
        write(tmp_path, f"{k}.csv", body)
    path = str(tmp_path)
    assert sorted(tuple(r) for r in text.read_csv(spark, path, "leading").collect()) == [("#1", "x"), ("2", "y"), ("3", "z"), ("4", "no header"), ("id", "kind")]
    assert sorted(tuple(r) for r in text.read_csv(spark, path, header="id,kind").collect()) == [("2", "y"), ("3", "z"), ("4", "no header"), ("id", "kind")]
    quoted = tmp_path / "quoted"
    quoted.mkdir()
    write(quoted, "a.csv", '# made\nid,note\n1,"two\nlines"\n2,"a ""b"""\n')
    assert [tuple(r) for r in text.read_csv(spark, str(quoted), multi_line=True).collect()] == [("1", "two\nlines"), ("2", 'a "b"')]


def test_kappas_equal_plain_windows():
    """Charge patterning window by window, for sequences of mixed lengths at once."""

    def asymmetry(sign, blob):
        def sigma(some):
            p, m = sum(x > 0 for x in some), sum(x < 0 for x in some)
            return ((p - m) / len(some)) ** 2 / ((p + m) / len(some)) if p + m else 0.0

        return sum((sigma(sign[k : k + blob]) - sigma(sign)) ** 2 for k in range(len(sign) - blob + 1)) / (len(sign) - blob + 1)

    delta = lambda sign: (asymmetry(sign, 5) + asymmetry(sign, 6)) / 2
    r = random.Random(3)
    seqs = ["".join(r.choices("AGKRED", k=r.choice([0, 5, 6, 9, 14]))) for _ in range(25)] + [None, "AAAAAAA", "KKKKKKKK"]
    for seq, got in zip(seqs, models.kappas(seqs), strict=True):
        sign = [1 if c in "KR" else -1 if c in "DE" else 0 for c in seq or ""]
        p, m, rest = sign.count(1), sign.count(-1), sign.count(0)
        if len(sign) < 6 or not p + m:
            assert got is None
            continue
        orders = [[0] * a + [1] * p + [0] * (rest - a - b) + [-1] * m + [0] * b for a in range(rest + 1) for b in range(rest - a + 1)]
        most = max(map(delta, orders))
        assert got == (pytest.approx(min(1.0, delta(sign) / most), abs=1e-12) if most else None)
