"""What settle leaves behind."""

import os
import time

from pyspark.sql import functions as F

from treeloom.llm import common


def test_settle_leaves_no_shuffle_files(spark):
    places = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    shuffled = lambda: {x for top in places for _, _, names in os.walk(top) for x in names if x.startswith("shuffle_")}
    spark.sparkContext._jvm.System.gc()
    time.sleep(1)
    before, setting = shuffled(), spark.conf.get(common.CLEANUP, None)
    kept = common.settle(spark.range(100_000).groupBy((F.col("id") % 1000).alias("k")).count().join(spark.range(1000).withColumnRenamed("id", "k").hint("merge"), "k"))
    until = time.time() + 20
    while shuffled() - before and time.time() < until:  # executors remove them a moment later
        time.sleep(0.1)
    assert not shuffled() - before
    assert kept.count() == 1000 and spark.conf.get(common.CLEANUP, None) == setting
