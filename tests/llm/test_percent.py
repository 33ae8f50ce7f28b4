import pytest

from providerfx.llm import near_duplicates


def test_percent_and_sizes(spark):
    long = " ".join(f"w{i}" for i in range(404))
    rows = [(0, long), (1, " ".join(long.split()[:304])), (2, " ".join(f"v{i}" for i in range(300)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df, percent=70).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    for bad in (49, 101):
        with pytest.raises(ValueError):
            near_duplicates.near_duplicates(df, percent=bad)
