from lodestrata.api import Memory
from lodestrata.operators import search
from lodestrata.operators.pipeline import byte_embedding

NOW = "2025-01-01 00:00:00"


def test_a_frame_is_found_by_its_vector_and_scored_by_the_graph(spark, tmp_path):
    memory = Memory(spark, str(tmp_path / "memory"))
    texts = ["abcdefgh other words", "nothing of the kind", "Grimholt rests on Tolmar"]
    memory.save(spark.createDataFrame([*enumerate(texts, 1)], "id long, content string"), NOW)
    memory.save_entities(spark.createDataFrame([("Vandermeulen", "person", "{}"), ("Grimholt", "org", "{}")], "name string, entity_type string, properties string"), NOW)
    ids = {r.name: r.id for r in memory.table("entities").collect()}
    memory.relate(spark.createDataFrame([(ids["Vandermeulen"], ids["Grimholt"], "runs")], "source_id long, target_id long, relation_type string"), NOW)
    asked = spark.createDataFrame([(1, "abcdefgx"), (2, "what rests with Vandermeulen")], "qid long, text string")
    frames = memory.table("frames")
    lane = search.vector_lane(asked, frames.selectExpr("id", "content AS text"), byte_embedding(8), 8, 1)
    assert {r.qid: r.id for r in lane.collect()}[1] == 1
    # No term of query 1 is in frame 1: keywords alone don't find it.
    assert memory.recall(asked.filter("qid = 1"), NOW).count() == 0
    assert 1 in {r.id for r in memory.recall(asked.filter("qid = 1"), NOW, embed=byte_embedding(8), dims=8).collect()}
    got = {r.id: r.relevance for r in memory.recall(asked.filter("qid = 2"), NOW, profile="connected", embed=byte_embedding(8), dims=8).collect()}
    assert round(got[3] - got[2], 6) == round(0.6 * 0.7, 6)


def test_nearest_keeps_ties_in_order(spark):
    v = spark.createDataFrame([(i, [float(i // 4)]) for i in range(40, 0, -1)], "id long, embedding array<float>").coalesce(1)
    q = spark.createDataFrame([(1, [0.0])], "qid long, embedding array<float>")
    assert [r.id for r in search.nearest(q, v, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
