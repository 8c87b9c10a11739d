"""The change feed: order, repeats, dirt, replays and empty feeds."""

import json
import random

from pyspark.sql import types as T

from moraine.streaming import cdc
from moraine.streaming.cdc import ChangeTable

FEED = "op string, before string, after string, binlog_file string, binlog_pos bigint"


def row(i, title="t", **more):
    return json.dumps({"id": i, "title": title, "content": "c", "blinded": 0} | more)


def change(op, i, place, title="t"):
    image = row(i, title)
    return (op, image if op == "d" else None, None if op == "d" else image, f"log.{place // 100}", place % 100)


def applied(spark, tmp_path, batches, schema=FEED):
    """The table after the batches have come in one after the other."""
    source = str(tmp_path / "feed")
    table = ChangeTable(spark, str(tmp_path / "table"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        table.apply(spark.readStream.schema(T._parse_datatype_string(schema)).parquet(source))
    return table


def expected(messages):
    state = {}
    for op, before, after, file, pos in messages:
        image = before if op == "d" else after if op in ("c", "r", "u") else None
        try:
            i = json.loads(image)["id"]
        except (TypeError, ValueError, KeyError):
            continue
        if isinstance(i, int) and i > 0:
            place = (int(file.split(".")[-1]), pos)
            if i not in state or place > state[i][0]:
                state[i] = (place, op == "d")
    return {(i, *p) for i, (p, gone) in state.items() if not gone}


def places(table):
    return {(r["post_id"], int(r["binlog_file"].split(".")[-1]), r["binlog_pos"]) for r in table.current("post_id", "binlog_file", "binlog_pos").collect()}


def test_any_order_and_number_of_deliveries(spark, tmp_path):
    rng = random.Random(5)
    messages = [change(rng.choice("crud"), rng.randint(1, 12), p, f"t{p}") for p in range(90, 330)]
    wanted = expected(messages)
    shuffled = messages + rng.sample(messages, 80)
    rng.shuffle(shuffled)
    table = applied(spark, tmp_path, [shuffled[:100], shuffled[100:200], shuffled[200:]])
    assert places(table) == wanted
    titles = {r["id"]: r["title"] for r in table.rows().collect()}
    assert titles == {i: f"t{f * 100 + p}" for i, f, p in wanted}


def test_file_numbers_are_numbers(spark, tmp_path):
    old, new = ("u", None, row(1, "old"), "log.999999", 50), ("u", None, row(1, "new"), "log.1000000", 4)
    assert [r["title"] for r in applied(spark, tmp_path, [[new, old]]).rows().collect()] == ["new"]


def test_dirty_messages_change_nothing(spark, tmp_path):
    good = change("c", 1, 100)
    dirt = [
        ("u", None, None, "log.5", 1), ("u", None, "null", "log.5", 2), ("u", None, '{"id":1,"title":"cut', "log.5", 3), ("u", None, '{"title":"x"}', "log.5", 4),
        ("u", None, '{"id":0}', "log.5", 5), ("u", None, '{"id":-4}', "log.5", 6), ("x", row(1), row(1), "log.5", 7), (None, row(1), row(1), "log.5", 8), ("d", None, row(1), "log.5", 9),
        ("u", None, '{"id":1} tail', "log.5", 10), ("u", None, '[{"id":1}]', "log.5", 11), ("u", None, "", "log.5", 12), ("u", None, row(1), "log", 13), ("u", None, row(1), None, 14), ("u", None, row(1), "log.5", None),
    ]
    table = applied(spark, tmp_path, [[good, *dirt]])
    assert places(table) == {(1, 1, 0)}
    counted = cdc.rejected(spark.createDataFrame([good, *dirt], FEED))
    assert {(r["op"], r["reason"]): r["messages"] for r in counted.collect()} == {
        ("u", "image missing"): 1, ("u", "image unreadable"): 2, ("u", "id"): 6, ("x", "op"): 1, ("none", "op"): 1, ("d", "image missing"): 1, ("u", "place"): 3,
    }


def test_deletes_come_back_and_late_ones_do_not(spark, tmp_path):
    table = applied(spark, tmp_path, [[change("d", 1, 300), change("d", 2, 300)], [change("c", 1, 200), change("u", 2, 400)]])
    assert places(table) == {(2, 4, 0)}


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = applied(spark, tmp_path, [[change("c", i, 100 + i) for i in range(1, 6)]])
    before = places(table)
    table.spark.read.parquet(f"{table.out}/version=0").write.mode("overwrite").parquet(f"{table.out}/version=7")
    assert places(table) == before and len(before) == 5


def test_empty_feed_and_clashing_columns(spark, tmp_path):
    assert applied(spark, tmp_path, [[]]).current("post_id").collect() == []
    extra = [("u", None, row(1), "log.1", 1, "x", 5)]
    table = applied(spark, tmp_path / "b", [extra], FEED + ", payload string, post_id int")
    assert places(table) == {(1, 1, 1)}


def test_one_key_with_most_changes_and_a_long_image(spark, tmp_path):
    long = ("u", None, row(7, content="가" * 300_000), "log.90", 1)
    table = applied(spark, tmp_path, [[change("u", 7, p) for p in range(100, 2100)] + [long] + [change("c", i, 100) for i in range(10, 20)]])
    assert (7, 90, 1) in places(table) and len(places(table)) == 11
    assert len(table.rows().where("id = 7").first()["content"]) == 300_000


def test_dead_letters_are_kept_once(spark, tmp_path):
    schema = "kafka_partition int, kafka_offset bigint, " + FEED
    good = [(0, i, *change("c", i, 100 + i)) for i in range(1, 4)]
    bad = [(0, 9, "u", None, '{"id":1,"title":"cut', "log.5", 3), (1, 4, None, row(1), row(2), "log.5", 8), (1, 5, "u", None, row(1), None, 14), (2, 7, "d", None, row(1), "log.5", 9)]
    source, table = str(tmp_path / "feed"), ChangeTable(spark, str(tmp_path / "table"))
    for rows in (good + bad[:2], bad[2:]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        table.divert(spark.readStream.schema(T._parse_datatype_string(schema)).parquet(source))
    got = table.diverted().collect()
    reasons = ["image unreadable", "op", "place", "image missing"]
    assert sorted((tuple(r)[:8] for r in got), key=lambda r: r[:2]) == [(*b, why) for b, why in zip(bad, reasons)] and {r["version"] for r in got} == {0, 1}


def test_versions_fold_into_one(spark, tmp_path):
    from pyspark.sql import functions as F

    from moraine.streaming.cdc import STATE, ChangeTable

    table = ChangeTable(spark, f"file://{tmp_path}/t")
    assert table.versions().count() == 0 and table.current("post_id").collect() == []
    table.compact()
    rows = [[(1, 1, 5, False, "a.1", "x"), (2, 1, 6, False, "a.1", "y")], [(1, 1, 9, True, "a.1", None)], [(1, 1, 7, False, "a.1", "late"), (3, 2, 1, False, "a.2", "z")]]
    for i, part in enumerate(rows[:2]):
        spark.createDataFrame(part, STATE).write.parquet(f"{table.out}/version={i}")
    before = {tuple(r) for r in table.current("post_id", "payload").collect()}
    table.compact()
    assert {tuple(r) for r in table.current("post_id", "payload").collect()} == before == {(2, "y")}
    assert table.versions().where(F.col("version") == 1).count() == 2
    spark.createDataFrame(rows[2], STATE).write.parquet(f"{table.out}/version=2")
    assert {tuple(r) for r in table.current("post_id", "payload").collect()} == {(2, "y"), (3, "z")}
    table.compact()
    assert {tuple(r) for r in table.current("post_id", "payload").collect()} == {(2, "y"), (3, "z")}
