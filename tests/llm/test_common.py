import time

from pyspark.sql import functions as F

from skein.llm.common import SHUFFLES_GO, written


def test_shuffle_files_go_once_a_step_is_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("skein.llm.common._scopes", [str(tmp_path)])
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {f for f in (files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())) if f.startswith("shuffle_")}
    before = shuffles()
    got = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").repartition(3), "k"), "step")
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before
    assert got.agg(F.sum("count")).first()[0] == 1000
    assert spark.conf.get(SHUFFLES_GO, "false") == "false"
