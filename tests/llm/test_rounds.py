"""The join takes the same steps at every size."""

from tidelag.llm import jaccard_join


def test_pivots_come_first(spark, monkeypatch):
    made, pivots = [], jaccard_join._pivot_pairs
    monkeypatch.setattr(jaccard_join, "_pivot_pairs", lambda *a: made.append(1) or pivots(*a))
    text = lambda k, last: " ".join([f"w{k}x{i}" for i in range(60)] + [last])
    docs = spark.createDataFrame([(2 * k + j, text(k, last)) for k in range(5) for j, last in enumerate(("same", "other"))], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_groups(docs).collect()}
    assert made and found == {i: i - i % 2 for i in range(10)}
