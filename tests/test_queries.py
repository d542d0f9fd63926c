"""Every registered query of the engine against its oracle; those without one must return rows and the same rows again."""

import pytest
from pyspark.sql import functions as F

from helixframe.plans import registry

WITHOUT = sorted(set(registry.QUERIES) - set(registry.ORACLES))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(name, spark, sf_dir, duck, same_rows):
    same_rows(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df())


@pytest.mark.parametrize("name", WITHOUT)
def test_rows_without_oracle(name, spark, sf_dir, same_rows):
    first = registry.QUERIES[name](spark, sf_dir)
    got = first.toPandas()
    assert len(got)
    if not name.startswith("stream"):
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        try:
            same_rows(got, registry.QUERIES[name](spark, sf_dir).toPandas())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_rows_are_spread_over_tasks_of_bounded_size(spark):
    """However few or uneven the partitions that files are cut into."""
    from helixframe.plans import core

    uneven = spark.range(300_000).repartition(8, F.lit(1))
    sizes = [x.n for x in core.spread(uneven).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 300_000 and len(sizes) == 12 and max(sizes) <= 1.1 * core.TASK
    assert core.spread(spark.range(10)).rdd.getNumPartitions() == 8


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
