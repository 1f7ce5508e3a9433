from pyspark.sql import functions as F

from grantlens.functions.text import unfolded
from grantlens.plans import views
from grantlens.session import sql_over


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    rows = spark.range(0, 5000).selectExpr("id as o_orderkey", "id % 3 as o_custkey").coalesce(1)
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(0, 9000).selectExpr("id % 5000 as l_orderkey", "cast(id div 5000 + 1 as int) as l_linenumber").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sql_over(spark, str(tmp_path), "select * from orders").select(F.spark_partition_id().alias("p")).distinct().count() == 1
    spread = views.certificates(spark, str(tmp_path))
    assert spread.select(F.spark_partition_id().alias("p")).distinct().count() >= 4 and spread.count() == 5000

    # Case documents and passes are grouped by their case or document without a further shuffle of their wide rows.
    docs = views.case_documents(spark, str(tmp_path))
    assert docs.count() == 9000
    for df, key in ((docs, "case_id"), (views.pass_fields(spark, str(tmp_path)), "doc_id")):
        plan = df.groupBy(key, "ord" if key == "case_id" else "field").count()._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") > 0


def test_arrays_are_unfolded_without_a_second_reading(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, xs array<string>").select("k", F.transform("xs", lambda x: F.struct(F.upper(x).alias("u"))).alias("e"))
    out = unfolded(df, ["k"], F.col("e"), "r")
    assert sorted((r.k, r.r.u) for r in out.collect()) == [(1, "A"), (1, "B")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1
