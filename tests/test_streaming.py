"""Stateless operators accept a streaming DataFrame as it is."""

from pyspark.sql import functions as F

from rankloom.functions import scalars as S
from rankloom.operators import filters as X, joins as J


def test_stateless_operators_on_a_stream(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{source}/customer.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(source)
    nations = spark.read.parquet(f"{source}/nation.parquet").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    out = J.map_ids(X.filter_in(stream, "c_mktsegment", ["MACHINERY"]), nations, "c_nationkey", "n_name")
    out = out.select("c_custkey", "c_nationkey", S.patient_id("c_name").alias("id"))
    q = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    batch = spark.read.parquet(f"{source}/customer.parquet").where("c_mktsegment = 'MACHINERY'").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch
