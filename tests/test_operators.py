"""Operators on small tables: scoring, numbering, logs, index maintenance, readers, sharding."""

import math

import pytest
from pyspark.sql import functions as F

from moraine.functions import words
from moraine.operators import learning, logs, maintenance, search
from moraine.operators.index import field_words
from moraine.operators.numbering import numbered
from moraine.plans.logs import with_banned, without_banned
from moraine.plans.relational import node_of, ring_place
from moraine.sources import dumps


def test_bm25_by_hand(spark):
    docs = {1: "a b b", 2: "a c", 3: "d", 4: ""}
    df = spark.createDataFrame(list(docs.items()), "id int, text string")
    got = {r["id"]: r["score"] for r in search.bm25(field_words(df, words.tokens(F.col("text"))), [(1, "a", 1.0), (1, "b", 2.0)]).collect()}
    n, avgdl = 3, 6 / 3

    def part(boost, tf, dl, df):
        return boost * math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    assert got == pytest.approx({1: part(1, 1, 3, 2) + part(2, 2, 3, 1), 2: part(1, 1, 2, 2)})


def test_pages_end(spark):
    scored = spark.createDataFrame([(1, i, float(-(i // 2))) for i in range(7)], "qid int, id int, score double")
    first = search.page(scored, 0, 3).orderBy("place").collect()
    assert [r["id"] for r in first] == [0, 1, 2] and all(r["has_next"] for r in first)
    last = search.page(scored, 6, 3).collect()
    assert [r["id"] for r in last] == [6] and not last[0]["has_next"]
    with pytest.raises(ValueError):
        search.page(scored, 320, 20)


def test_numbers_are_consecutive(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = numbered(df, ["k"], "n", start=5).orderBy("k").collect()
    assert [(r["k"], r["n"]) for r in got] == [(i, i + 5) for i in range(1000)]
    assert numbered(df.where("k < 0"), ["k"], "n").count() == 0


def test_prefix_suggestions(spark):
    df = spark.createDataFrame([("가나", 5), ("가다", 7), ("ab", 1)], "query string, total bigint")
    got = {}
    for r in logs.prefix_top(df, most=1).collect():
        got[r["prefix"]] = r["query"]
    assert got["가"] == "가다" and got["ㄱ"] == "가다" and got["가나"] == "가나" and got["ㄱㄴ"] == "가나" and got["ab"] == "ab" and got["ㄱㅏㄷ"] == "가다"


def test_dwell_grades(spark):
    df = spark.createDataFrame([(None, 3), (None, 4), (-1, 0), (0, 9), (9_999, 0), (10_000, 0), (30_000, 0), (120_000, 0), (120_001, 0)], "d bigint, p int")
    assert [r[0] for r in df.select(logs.dwell_grade(F.col("d"), F.col("p"))).collect()] == [0, None, 0, 0, 0, 1, 2, 2, 3]


def test_ndcg(spark):
    df = spark.createDataFrame([("q", 1, 3.0, 0), ("q", 2, 2.0, 3), ("q", 3, 1.0, 1), ("z", 1, 1.0, 0)], "g string, id int, s double, rel int")
    got = learning.ndcg(df, "g", "s", "rel", "id").collect()
    dcg = 7 / math.log2(3) + 1 / math.log2(4)
    assert len(got) == 1 and got[0]["ndcg"] == pytest.approx(dcg / (7 + 1 / math.log2(3)))


def test_upserts_deletes_and_reports(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, content string")
    changes = spark.createDataFrame([(1, " "), (2, "B"), (3, "c")], "id int, content string")
    assert {tuple(r) for r in maintenance.upserted(base, changes).collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert [r["id"] for r in maintenance.deleted(base, changes.where("id <> 1")).collect()] == [1]
    assert {tuple(r) for r in maintenance.report(changes, base).collect()} == {(1, "indexed"), (2, "indexed"), (3, "not found")}


def test_readers_stay_on_their_version(spark, tmp_path):
    store = maintenance.Snapshots(spark, f"file://{tmp_path}")
    store.publish(spark.range(3), 1)
    pinned = store.pinned()
    store.publish(spark.range(5), 2)
    assert store.read(pinned).count() == 3 and store.read().count() == 5


def test_ring_spreads_and_moves_little(spark):
    import hashlib

    def ring(nodes):
        return sorted((int(hashlib.md5(f"node{n}#{v}".encode()).hexdigest()[:8], 16), n) for n in range(nodes) for v in range(150))

    keys = spark.range(1000).select(F.concat(F.lit("key:"), F.col("id").cast("string")).alias("k"))
    rows = keys.select(node_of(ring_place(F.col("k")), ring(3)).alias("a"), node_of(ring_place(F.col("k")), ring(4)).alias("b")).collect()
    for n in range(3):
        assert 0.2 <= sum(r["a"] == n for r in rows) / 1000 <= 0.45
    moved = [r for r in rows if r["a"] != r["b"]]
    assert 0.15 <= len(moved) / 1000 <= 0.35 and all(r["b"] == 3 for r in moved)


def test_dumps_by_extension(spark, tmp_path):
    array = tmp_path / "a.json"
    array.write_text('[{"namespace": 1, "title": "x", "text": "#redirect y", "contributors": ["z"]}, {"title": "n", "text": null}, {"text": "no title"}]')
    got = {r["title"]: tuple(r) for r in dumps.dump(spark, str(array)).collect()}
    assert got == {"x": ("x", 1, "#redirect y", "y"), "n": ("n", 0, None, None)}
    xml = tmp_path / "a.xml"
    xml.write_text(
        "<mediawiki><page><title>T</title><ns>0</ns><id>5</id><revision><id>9</id><timestamp>2020-01-02T03:04:05Z</timestamp><text>old</text></revision>"
        "<revision><id>10</id><timestamp>2021-01-02T03:04:05Z</timestamp><text>#REDIRECT [[U]]</text></revision></page><page><title>no id</title></page></mediawiki>"
    )
    (page,) = dumps.mediawiki(spark, str(xml)).collect()
    assert (page["id"], page["content"], page["redirect_to"], str(page["created_at"])) == (5, "#REDIRECT [[U]]", "U", "2020-01-02 03:04:05")
    assert dumps.dump(spark, "a.txt") is None


def test_news_lines(spark):
    lines = [("f", 1, "lost line"), ("f", 2, "제목: one"), ("f", 3, "내용: " + "a" * 30), ("f", 4, "b" * 30), ("f", 5, "제목: two"), ("f", 6, "short"), ("g", 1, "제목: three"), ("g", 2, "c" * 60)]
    got = {r["title"]: r["body"] for r in dumps.articles_of_lines(spark.createDataFrame(lines, "file string, row int, line string")).collect()}
    assert got == {"one": "a" * 30 + "\n\n" + "b" * 30, "three": "c" * 60}


def test_rate_limit_is_for_each_minute(spark):
    rows = [("k", f"2025-01-01 00:00:{i:02d}", i) for i in range(15)] + [("k", "2025-01-01 00:01:00", 99)]
    df = spark.createDataFrame(rows, "k string, ts string, id int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted(r["id"] for r in logs.rate_limited(df, "k", "ts", "id").collect()) == [*range(10), 99]


def test_listed_words_by_pattern_and_by_table(spark):
    texts = ["abc slur", "slurry", "a-slur!", "나쁜말이다", "말", "", None, "x_slur", "slur9", "bad word here", "slur slur"]
    rows = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "id int, query string, word string").drop("word")
    words = spark.createDataFrame([("slur", False), ("나쁜", True), ("bad word", False)], "word string, hangul boolean")
    got = [{r["id"] for r in with_banned(rows, words, most=most).collect() if r["is_banned"]} for most in (10, 0)]
    assert got == [{0, 2, 3, 9, 10}] * 2 and with_banned(rows, words, most=0).count() == len(texts)
    assert without_banned(rows, words.where("false")).count() == len(texts)
