"""Duplicates kept as state over slices of the documents, against the batch ranking after each."""

from pyspark.sql import functions as F

from engram.operators.audit import dedupe_ranked
from engram.plans.points import points
from engram.schema import POINT
from engram.streaming.duplicates import duplicate_changes

DIR = "/root/testdata/sf0.001"


def test_duplicates_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    all_points = points(spark, DIR, False).cache()
    # copies under later and earlier dates, without numbers, and of one identifier
    extra = all_points.where("id_num % 4 = 0").select(F.concat(F.lit("c"), "id").alias("id"), F.lit(None).cast("long").alias("id_num"), "text", "source", "section", "file_path", "type", (F.col("ts_epoch") + F.when(F.col("id_num") % 8 == 0, 86400 * 400).otherwise(0)).alias("ts_epoch"), "extra", "vector")
    alone = spark.createDataFrame([("z1", None, None, "s", "", "", "", None, None, None), ("z2", None, "", "s", "", "", "", 5, None, None), ("z1", None, None, "s", "", "", "", None, None, None)], POINT)
    whole = all_points.unionByName(extra).unionByName(alone)
    slices = [whole.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kept, seen = {}, []

    def apply(batch, _):
        rows = batch.collect()
        seen.append(len(rows))
        for r in sorted(rows, key=lambda r: r.keep):
            kept[r.group, r.id] = r.keep

    try:
        for i, part in enumerate(slices):
            part.write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = spark.readStream.schema(POINT).parquet(f"file://{tmp_path}/in")
            changes = duplicate_changes(stream)
            changes.writeStream.foreachBatch(apply).outputMode("update").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
            so_far = spark.read.schema(POINT).parquet(f"file://{tmp_path}/in")
            ranked = dedupe_ranked(so_far).select("group", "id", "keep").distinct().collect()
            assert {(r.group, r.id): r.keep for r in ranked} == kept
        assert sum(seen) < 3 * len(kept) and any(kept.values()) and not all(kept.values())
    finally:
        spark.conf.set(setting, before)
        all_points.unpersist()
