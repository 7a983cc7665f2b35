"""Bodies apart from articles: changes, a changed byte found, and joins without a shuffle."""

from pyspark.sql import functions as F

from quillspark.operators import bodystore as B


def test_bodies(spark):
    articles = spark.createDataFrame([(f"a{k}", f"body {k}", k) for k in range(40)] + [("none", None, 0)], "slug string, body string, n int")
    B.migrate(articles, "bs_articles", "bs_bodies", buckets=4)
    assert B.verify(spark, "bs_articles", "bs_bodies").collect() == []
    assert sorted(map(str, B.restore(spark, "bs_articles", "bs_bodies").select("slug", "body", "n").collect())) == sorted(map(str, articles.collect()))
    B.upsert(spark, "bs_bodies", spark.createDataFrame([("a3", "body 3 "), ("b", "new")], "slug string, body string"), spark.createDataFrame([("a5",), ("zz",)], "slug string"), buckets=4)
    assert sorted(tuple(r) for r in B.verify(spark, "bs_articles", "bs_bodies").collect()) == [("a3", "changed"), ("a5", "missing"), ("b", "extra")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (B.verify(spark, "bs_articles", "bs_bodies"), B.restore(spark, "bs_articles", "bs_bodies")):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert B.restore(spark, "bs_articles", "bs_bodies").where(F.col("slug") == "a5").first()["body"] is None
