from apchecks.llm import mixing


def test_texts_are_shuffled_once(spark):
    """Whole and cut copies come from one join, which takes the rows where the dropping of alike ones has left them."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(i % 40, f"some words {i % 50} " * (i % 7), "ab"[i % 2]) for i in range(200)], "doc_id long, text string, source string")
        plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert plan.count("SortMergeJoin") == 1
    assert len(shuffles) == 3  # the rows once; the plan where it is grouped and where it is joined
