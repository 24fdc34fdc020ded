"""Parts added to line items and orders, sent whole or met by a shuffle."""

from pyspark.sql import functions as F

from standtally.sources import derived


def test_many_parts_are_not_sent_whole(spark, tmp_path, monkeypatch):
    parts = [(k, f"genus{k} word", "KIND", k % 7) for k in range(1, 40) if k % 5]
    schema = "p_partkey bigint, p_name string, p_type string, p_size int"
    spark.createDataFrame(parts, schema).write.parquet(f"{tmp_path}/part.parquet")
    inputs = derived.DerivedInventory(spark, str(tmp_path))
    numbers = spark.range(200).select(F.when(F.col("id") % 9 != 0, F.col("id")).alias("n"))

    def result():
        df = inputs._with_part(numbers, F.col("n"))
        rows = sorted(df.collect(), key=str)
        return rows, df._jdf.queryExecution().executedPlan().toString()

    few, plan = result()
    assert "BroadcastHashJoin" in plan and len(few) == 200
    monkeypatch.setattr(derived, "PARTS_TO_SEND", 10)
    many, plan = result()
    assert many == few and "ShuffledHashJoin" in plan and "BroadcastHashJoin" not in plan
