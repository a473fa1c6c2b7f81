import os

from pyspark.sql import functions as F

from keyfold.session import _CLEANUP, freeing_shuffles, run_all, write_buckets, write_stage


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dirs = [str(d) for d in manager.localDirsString()]
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_written_stages_leave_no_shuffle_files(spark):
    before, df = shuffle_files(spark), spark.range(5000).withColumn("k", F.col("id") % 7)
    stage = write_stage(df.repartition(5, "k"), "left")
    buckets = write_buckets(df, "left_buckets", "id")
    assert not shuffle_files(spark) - before and stage.count() == buckets.count() == 5000
    kept = df.repartition(5, "k").groupBy("k").count()
    assert len(kept.collect()) == 7 and shuffle_files(spark) - before and len(kept.collect()) == 7


def test_setting_is_as_before_when_all_threads_have_written(spark):
    shown = spark.conf.get(_CLEANUP, "false")

    def nested():
        with freeing_shuffles(spark), freeing_shuffles(spark):
            return spark.conf.get(_CLEANUP)

    assert set(run_all(spark, [nested] * 8)) == {"true"} and spark.conf.get(_CLEANUP, "false") == shown
