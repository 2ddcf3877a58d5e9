"""Tables of fingerprints grow 28 times after Spark has sized them: none may be broadcast."""

from pyspark.sql import functions as F

from kilnspark.llm import simhash


def broadcasts(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    graphs = [store.planGraph(runs.apply(i).executionId()).allNodes() for i in range(runs.size())]
    return sum("BroadcastExchange" in g.apply(i).name() for g in graphs for i in range(g.size()))


def test_no_table_of_fingerprints_is_broadcast(spark):
    marks = spark.range(300).select(F.md5(F.col("id").cast("string")).alias("fingerprint"))
    before = broadcasts(spark)
    assert simhash.near_counts(marks).count() == simhash.within_radius(marks).count() == 0
    assert broadcasts(spark) == before
