from providerfx.llm import toxicity


def test_unknown_labels_use_no_quota(spark):
    df = spark.createDataFrame([(i, f"plain words number{i} here" + (" vile scum" if i % 2 else "")) for i in range(80)], "doc_id long, text string")
    known = [(i, i % 2) for i in range(80)]
    more = known + [(i, (i + 1) % 2) for i in range(1000, 5000)]
    score = lambda rows: {r["doc_id"]: r["score"] for r in toxicity.toxicity(df, spark.createDataFrame(rows, "doc_id long, toxic int"), max_labels=80).collect()}
    got = score(more)
    assert got == score(known) and all((s >= 0.5) == (i % 2 == 1) for i, s in got.items())
