from pyspark.sql import functions as F

from docspark.streaming.jobs import analyse_stream, status


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i)) for i in range(20)], "id long, v double")
    rows.write.parquet(str(tmp_path / "in"))
    query = analyse_stream(spark, str(tmp_path / "in"), "id long, v double", lambda b: b.where("v > 10").select("id"), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert status(query)["state"] == "done"
    got = spark.read.parquet(str(tmp_path / "out")).select("id")
    assert got.agg(F.sum("id")).first()[0] == sum(range(11, 20))
