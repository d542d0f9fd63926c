"""Queries of the relational operators on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixframe.operators import filters, relational
from helixframe.plans.core import query, r9, table


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


@query("f1_f4_bounds", """SELECT count(*) FILTER (l_quantity <= 20) AS at_most, count(*) FILTER (l_quantity >= 30) AS at_least, count(*) FILTER (l_discount BETWEEN 0.02 AND 0.05) AS within,
count(*) FILTER (l_discount < 0.02 OR l_discount > 0.05) AS outside FROM lineitem""")  # fmt: skip
def bounds(spark, sf_dir):
    q, d = F.col("l_quantity"), F.col("l_discount")
    return lineitem(spark, sf_dir).agg(F.count_if(filters.at_most(q, 20)).alias("at_most"), F.count_if(filters.at_least(q, 30)).alias("at_least"), F.count_if(filters.within(d, 0.02, 0.05)).alias("within"), F.count_if(filters.outside(d, 0.02, 0.05)).alias("outside"))


_CHAIN = [("quantity", "l_quantity <= 40"), ("discount", "l_discount BETWEEN 0.01 AND 0.08"), ("tax", "(l_tax < 0.02 OR l_tax > 0.03)"), ("price", "l_extendedprice >= 5000")]


def chain():
    return [
        ("quantity", filters.at_most(F.col("l_quantity"), 40)), ("discount", filters.within(F.col("l_discount"), 0.01, 0.08)),
        ("tax", filters.outside(F.col("l_tax"), 0.02, 0.03)), ("price", filters.at_least(F.col("l_extendedprice"), 5000)),
    ]


def _kept(k: int) -> str:
    return " AND ".join(f"({p})" for _, p in _CHAIN[:k]) or "true"


@query("f5_attrition", " UNION ALL ".join(f"SELECT {k} AS step, '{n}' AS filter, count(*) FILTER ({_kept(k - 1)}) - count(*) FILTER ({_kept(k)}) AS removed, count(*) FILTER ({_kept(k)}) AS remaining FROM lineitem" for k, (n, _) in enumerate(_CHAIN, 1)))
def attrition(spark, sf_dir):
    return filters.attrition(lineitem(spark, sf_dir), chain())


@query("f6_g36_exclusion_reasons", f"""SELECT reason, count(*) AS n FROM (SELECT CASE {' '.join(f"WHEN NOT ({p}) THEN '{n}'" for n, p in _CHAIN)} END AS reason FROM lineitem) WHERE reason IS NOT NULL GROUP BY 1""")
def exclusion(spark, sf_dir):
    reason = filters.first_failing([(n, ~f) for n, f in chain()])
    return filters.reasons(lineitem(spark, sf_dir), reason)


_STALE = "event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0"


def stale_table(spark, sf_dir):
    """Events whose value is missing in several ways."""
    k = F.col("event_id")
    cell = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 11 == 0, " NaN ").when(k % 13 == 0, "").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", "event_type", cell.alias("metric"))


@query("f16_f17_recompute_plan", f"SELECT event_type, ({_STALE} OR event_type = 'error') AS recompute, count(*) AS n FROM events GROUP BY 1, 2")
def recompute(spark, sf_dir):
    return filters.recompute_plan(stale_table(spark, sf_dir), ["metric"], F.col("event_type") == "error").groupBy("event_type", "recompute").agg(F.count("*").alias("n"))


@query("j5_update_stale", f"SELECT event_id, CASE WHEN ({_STALE}) AND event_id % 2 = 0 THEN 'fresh' WHEN event_id % 7 = 0 THEN 'null' WHEN event_id % 11 = 0 THEN ' NaN ' WHEN event_id % 13 = 0 THEN '' ELSE 'old' END AS state FROM events")
def update(spark, sf_dir):
    """Fresh values for even rows fill what is stale."""
    base = stale_table(spark, sf_dir)
    fresh = base.filter("event_id % 2 = 0").select("event_id", F.lit("fresh").alias("metric"))
    got = filters.update_stale(base, fresh, "event_id", ["metric"])
    state = F.when(F.col("metric").isNull(), "null").when(F.col("metric").isin("fresh", " NaN ", ""), F.col("metric")).otherwise("old")
    return got.select("event_id", state.alias("state"))


@query("j2_checked_left_join", "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def checked(spark, sf_dir):
    """A left join that refuses repeated keys on the right."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return relational.checked_left_join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), customers, "o_custkey").select("o_orderkey", "c_mktsegment")


@query("j13_missing_keys", """SELECT key, side FROM (SELECT DISTINCT o_custkey AS key, 'left' AS side FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)
UNION ALL SELECT c_custkey, 'right' FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders))""")  # fmt: skip
def missing(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    b = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return relational.missing_keys(a, b, "key")


_KEY = "upper(regexp_replace(text, '\\s', '', 'g'))"


@query("u1_w8_dedupe_first", f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def dedupe_first(spark, sf_dir):
    """Documents by a key without case and white space; the key travels as a digest, the row as its id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2(relational.normal_key(F.col("text")), 256).alias("key"))
    return relational.keep_one(rows, F.col("key"), "doc_id").select("doc_id", "source")


@query("w8_dedupe_last", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1")
def dedupe_last(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return relational.keep_one(rows, F.col("key"), "doc_id", "last").select("doc_id", "source")


@query("u2_distinct_sequences", "SELECT lang, count(DISTINCT text) AS distinct_texts, count(*) AS n FROM documents GROUP BY 1")
def distinct_texts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("d"))
    each = rows.groupBy("lang", "d").agg(F.count("*").alias("n"))
    return each.groupBy("lang").agg(F.count("*").alias("distinct_texts"), F.sum("n").alias("n"))


@query("u3_u4_appended_samples", "SELECT sample, count(*) AS n, CAST(sum(rescued::INT) AS BIGINT) AS rescued FROM (SELECT event_type AS sample, false AS rescued FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_type, true FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 0) GROUP BY 1")
def appended(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("sample"))
    direct = events.filter("event_id % 3 <> 0").withColumn("rescued", F.lit(False))
    more = events.filter("event_id % 3 = 0 and event_id % 2 = 0").withColumn("rescued", F.lit(True))
    return direct.unionByName(more).groupBy("sample").agg(F.count("*").alias("n"), F.sum(F.col("rescued").cast("int")).alias("rescued"))


@query("w9_first_of_each_name", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type <> 'error') WHERE k = 1")
def first_of_name(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter("event_type <> 'error'").select("user_id", "event_id", "event_type")
    return relational.keep_one(rows, F.col("user_id"), "event_id").select("user_id", "event_id", "event_type")


@query("o3_o4_top_groups", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10")
def top_groups(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("n"), "o_custkey").limit(10)


@query("o5_best_of_each", "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem) WHERE k = 1")
def best_of_each(spark, sf_dir):
    """The dearest line of each supplier, ties by order and line."""
    order = F.struct(-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"))
    got = lineitem(spark, sf_dir).groupBy("l_suppkey").agg(F.min_by(F.struct("l_orderkey", "l_linenumber"), order).alias("x"))
    return got.select("l_suppkey", "x.*")


@query("o6_sort_by_numbers", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal")
def sorted_suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", "s_acctbal")


@query("o7_display_limit", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 5000")
def display(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id").limit(5000)


@query("p3_derived_sums", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 9) AS rate_sum, round(l_quantity + l_discount, 9) AS mixed_sum FROM lineitem")
def derived(spark, sf_dir):
    return lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", r9(F.col("l_discount") + F.col("l_tax")).alias("rate_sum"), r9(F.col("l_quantity") + F.col("l_discount")).alias("mixed_sum"))


@query("p9_constant_flanks", "SELECT p_partkey, 'MSK' || upper(trim(p_brand)) || 'GGS' AS flanked FROM part")
def flanked(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("MSK"), F.upper(F.trim("p_brand")), F.lit("GGS")).alias("flanked"))


@query("w7_first_differences", "SELECT event_id, round(coalesce(value - lag(value) OVER w, 0), 9) AS step, round(sum(value) OVER w, 4) AS running FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def differences(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", r9(F.coalesce(F.col("value") - F.lag("value").over(w), F.lit(0.0))).alias("step"), F.round(F.sum("value").over(w), 4).alias("running"))
