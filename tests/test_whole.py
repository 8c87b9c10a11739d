"""Queries that once did a part of their job only."""

from datetime import datetime

from moraine.operators.learning import FEATURES, held_out
from moraine.plans import learning, logs


def test_suggestions_of_all_prefix_lengths_are_filtered(spark, tmp_path):
    at = datetime(2025, 4, 30)
    spark.createDataFrame([(1, "garden path", at, 5), (2, "garden slur", at, 9), (3, "gardens", at, 2)], "id bigint, query string, time_bucket timestamp_ntz, count bigint").write.parquet(f"{tmp_path}/search_logs.parquet")
    spark.createDataFrame([("slur",)], "word string").write.parquet(f"{tmp_path}/banned_words.parquet")
    rows = logs.registry.queries["autocomplete_filtered_all"](spark, str(tmp_path)).collect()
    path = {("garden path"[:k], "garden path", 2 if k < 8 else 1) for k in range(1, 11)}
    gardens = {("gardens"[:k], "gardens", 3 if k < 7 else 1) for k in range(1, 8)}
    assert {(r["prefix"], r["query"], r["place"]) for r in rows} == path | gardens


def test_rescoring_takes_the_whole_window(spark, tmp_path):
    at = datetime(2025, 1, 1)
    posts = [(i, f"mountain range {i}", "mountain range by the sea", 1, 1, i, 0, False, "s", at, at) for i in range(1, 231)]
    spark.createDataFrame(posts, "id bigint, title string, content string, author_id bigint, category_id bigint, view_count bigint, like_count bigint, blinded boolean, source string, created_at timestamp_ntz, updated_at timestamp_ntz").write.parquet(f"{tmp_path}/posts.parquet")
    _, pairs = learning.candidates(spark, str(tmp_path), learning.WINDOW)
    assert pairs.where("qid = 7").count() == 200
    assert learning.labelled(spark, str(tmp_path)).where("qid = 7").count() == 200


def test_no_query_ranks_by_a_model_that_has_seen_it(spark):
    rows = spark.createDataFrame([(q, i, i, float(i % 4), *[float(i % 4)] * len(FEATURES)) for q in range(1, 8) for i in range(1, 9)], "qid int, id bigint, place int, rel double, " + ", ".join(f"{f} double" for f in FEATURES))
    out = held_out(rows, trees=2).collect()
    assert len(out) == 56 and len({r["fold"] for r in out}) > 1
    assert all(len({r["fold"] for r in out if r["qid"] == q}) == 1 and sorted(r["new_place"] for r in out if r["qid"] == q) == list(range(1, 9)) for q in range(1, 8))
    assert held_out(rows.where("qid = 1"), trees=2).collect() == []
