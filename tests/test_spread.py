from pyspark.sql import functions as F

from quillstream.plans import conversation_queries, queries, tables


def test_files_of_one_small_split_are_analysed_by_many_tasks(spark, tmp_path, monkeypatch):
    """The customers of one file were one task's, whatever their number."""
    spark.range(400).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).alias("c_nationkey")).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    seen = []
    monkeypatch.setattr(conversation_queries.validity, "analyse", lambda rows: seen.append(rows) or rows)
    monkeypatch.setattr(conversation_queries, "materialize", lambda rows: rows)
    conversation_queries.analysed_view(spark, str(tmp_path))
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(sizes) == 400 and max(sizes) < 200
    assert tables.spread(spark.range(10).toDF("k"), "k").count() == 10


def test_patches_of_one_small_split_are_made_by_many_tasks(spark, tmp_path, monkeypatch):
    """The documents of one file were one task's."""
    spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a text of some words, and more of them").alias("text")).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    monkeypatch.setattr(queries, "spread", lambda rows: seen.append(tables.spread(rows)) or seen[0])
    assert queries.QUERIES["patch_create_roundtrip"](spark, str(tmp_path)).where("same").count() == 400
    sizes = [r["count"] for r in seen[0].groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 200
