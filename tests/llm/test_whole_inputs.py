"""What lies beyond an old bound of the training-data operators counts."""

from quire.llm import topk, toxicity


def test_toxicity_trains_on_1500(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.extend(toxic))
    rows = spark.range(4000).selectExpr("id as doc_id", "'a text' as text", "cast(id % 2 as int) as toxic")
    toxicity.learn(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert (sum(seen), len(seen)) == (1500, 3000) and toxicity.BLOCKS == 5000


def test_topk_scores_beyond_doubles(spark):
    rows = [(0, [2.0**35, 2.0**-10]), (1, [1.0, 0.0]), (2, [1.0, 2.0**-10]), (3, [-1.0, 0.0])]
    got = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 2**55 + 1), (1, 2**55), (3, -(2**55))]
