"""Near duplicates: what is shuffled more than once."""

from pyspark.sql import functions as F

from kilnspark.llm import dart_minhash


def _sets(spark, n):
    return spark.range(n).select(F.encode(F.lpad(F.col("id").cast("string"), 16, "0"), "utf-8").alias("node"), F.array(F.lit(1), F.col("id").cast("int") + 2).alias("shingles"), F.array(F.lit(3), F.lit(1)).alias("weights"))


def test_only_the_sets_of_pairs_are_shuffled(spark, monkeypatch):
    sets = _sets(spark, 100)
    pairs = spark.createDataFrame([(b"%016d" % 0, b"%016d" % i) for i in (1, 2, 3)], "a binary, b binary")
    plan = dart_minhash.checked(pairs, sets)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 2
    for limit in (100, 1, 0):
        monkeypatch.setattr(dart_minhash, "BROADCAST_NODES", limit)
        found = {(int(r.a), int(r.b)): r.similarity for r in dart_minhash.checked(pairs, sets).collect()}
        assert found == {(0, i): 3 / 5 for i in (1, 2, 3)}


def test_nodes_and_sizes_of_buckets_are_stored_once(spark, monkeypatch):
    stored = []
    kept = dart_minhash.materialize
    monkeypatch.setattr(dart_minhash, "materialize", lambda df: stored.append(df.columns) or kept(df))
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "quite another text of few words")], "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in dart_minhash.near_duplicate_classes(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert ["node", "n", "bands"] in stored and ["bucket", "members"] in stored


def test_entries_of_buckets_are_shuffled_once(spark, monkeypatch):
    monkeypatch.setattr(dart_minhash, "STRETCH", 50)
    # bucket 7 holds every node, buckets from 100 on three each, the others one
    rows = [(i, [7, 100 + i // 3, 10_000 + i]) for i in range(300)] + [(900, [])]
    nodes = spark.createDataFrame(rows, "key long, bands array<long>").repartition(5)
    busy = {r.bucket: r.members for r in dart_minhash.busy_buckets(nodes).collect()}
    assert busy[7] == 300 and all(n == 3 for b, n in busy.items() if b != 7)
    found = dart_minhash.shared_entries(nodes)
    got = sorted((r.key, r.band, r.bucket, r.members) for r in found.collect())
    assert got == sorted(x for i in range(300) for x in ((i, 0, 7, 300), (i, 1, 100 + i // 3, 3)))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
