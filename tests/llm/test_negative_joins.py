"""Rows and packed blocks are not broadcast however small their files are: copies are small in a file only."""

import numpy as np
from pyspark.sql import functions as F

from bidlens.llm import gnat
from bidlens.llm.tables import stage


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_only_the_list_of_leaves_is_broadcast(spark):
    rng = np.random.default_rng(2)
    kinds = rng.normal(size=(20, 6)).tolist()
    df = spark.createDataFrame([(i, i % 3, kinds[i % 20]) for i in range(2000)], "vec_id long, label long, embedding array<double>")
    x = df.select("vec_id", "label", gnat.quantised(F.col("embedding")).alias("x")).withColumn("tag", F.xxhash64("label", "x")).select(*gnat.ROW)
    index = gnat.build_index(stage(x, "rows"), sample=200, block=64)
    window = F.struct(F.lit(0).cast("long").alias("name"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))
    dealt = plan_of(gnat.in_parts(index.rows, index.parts))
    assert "BuildRight" in dealt and "BuildLeft" not in dealt
    asked = index.rows.where("vec_id % 50 = 0").withColumn("windows", F.array(window))
    found = gnat.first_in_windows(asked, index, 5, True)
    plan = plan_of(found)
    assert "SortMergeJoin [leaf" in plan and "BroadcastHashJoin [leaf#" in plan and "BuildLeft" not in plan
    assert plan.count("BroadcastHashJoin") == 1  # the groups of leaves
    assert found.where("rank = 1").count() == 40
