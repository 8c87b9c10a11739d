"""The nearest documents of many seeds: against brute force, and without a row for a pair."""

import math
import random
from collections import Counter
from datetime import datetime

import pytest

from moraine.operators.alike import nearest
from moraine.plans import common, search
from moraine.storage import materialize

POSTS = "id bigint, title string, content string, author_id bigint, category_id bigint, view_count bigint, like_count bigint, blinded boolean, source string, created_at timestamp_ntz, updated_at timestamp_ntz"


def brute(docs, seeds, most):
    out = set()
    for seed, terms in seeds.items():
        scores = []
        for i, ws in docs.items():
            tf = Counter(w for w in ws if w in terms)
            if tf and i != seed and i is not None:
                scores.append((-round(sum(terms[w] * n / (n + 1.2) for w, n in tf.items()), 6), i))
        out |= {(seed, i, -score) for score, i in sorted(scores)[:most]}
    return out


@pytest.mark.parametrize("block, seeds_at_once", [(1, 20_000), (64, 20_000), (16_384, 7)])
def test_nearest_by_brute_force(spark, block, seeds_at_once):
    rand = random.Random(5)
    idf = {f"w{k}": math.log(1 + (400 - 3 * k) / (3 * k + 0.5)) for k in range(1, 60)} | {"all": 1e-7}
    docs = {i: ["all"] * (i % 7 > 0) + [f"w{min(60, int(rand.expovariate(0.08)) + 1)}" for _ in range(rand.randrange(12))] for i in rand.sample(range(-50, 5000), 500)}
    docs |= {9001: [], 9002: ["w3", "w3", "w4"], 9003: ["w3", "w3", "w4"], 9004: ["w4", "w3", "w3"]}  # ties go to the lower id
    seeds = {i: {w: idf[w] for w in rand.sample(sorted(idf), rand.randrange(1, 9))} for i in rand.sample(sorted(docs), 40)}
    seeds |= {9003: {"w3": idf["w3"], "w4": idf["w4"]}, 9900: {"all": 1e-7}, 9901: {"nowhere": 2.0}}  # two that are not among the documents
    left = spark.createDataFrame([*docs.items(), (None, ["w3"] * 5)], "id bigint, ws array<string>").repartition(3)
    right = spark.createDataFrame([(s, t, v) for s, terms in seeds.items() for t, v in terms.items()], "seed bigint, term string, idf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        got = nearest(left, right, 5, seeds_at_once, block).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == brute(docs, seeds, 5) and len(got) == len({(r["seed"], r["id"]) for r in got})


def test_nearest_of_nothing(spark):
    docs = spark.createDataFrame([(1, ["a"]), (2, ["a"])], "id bigint, ws array<string>")
    seeds = spark.createDataFrame([(1, "a", 1.0)], "seed bigint, term string, idf double")
    assert nearest(docs, seeds.where("false")).collect() == [] and nearest(docs.where("false"), seeds).collect() == []
    assert [tuple(r)[:2] for r in nearest(docs, seeds).collect()] == [(1, 2)]


def stages_so_far(spark):
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [stages.apply(i) for i in range(stages.size())]


def shuffled_rows(spark):
    """Rows that all stages so far have written for a shuffle."""
    return sum(s.shuffleWriteRecords() for s in stages_so_far(spark))


def shuffled_bytes(spark):
    return sum(s.shuffleWriteBytes() for s in stages_so_far(spark))


@pytest.mark.parametrize("name", ["more_like_this", "recommend_category"])
def test_pairs_that_share_a_common_word_are_not_shuffled(spark, tmp_path, name):
    """2,000 posts with the same text are 80,000 pairs; what is shuffled follows the posts and the ten nearest."""
    at = datetime(2025, 1, 1)
    rows = [(i, "harbour notes", "harbour notes, tide tables", 1, 10 + i % 3 * (i > 4), i, 0, False, "s", at, at) for i in range(1, 2001)]
    spark.createDataFrame(rows, POSTS).write.parquet(f"{tmp_path}/posts.parquet")
    before = shuffled_rows(spark)
    as_if_large = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    try:
        for key, value in as_if_large.items():
            spark.conf.set(key, value)
        got = search.registry.queries[name](spark, str(tmp_path)).collect()
    finally:
        for key in as_if_large:
            spark.conf.unset(key)
    assert shuffled_rows(spark) - before < 12_000
    if name == "more_like_this":
        assert {(r["seed"], r["id"]) for r in got} == {(s, i) for s in range(50, 2001, 50) for i in range(1, 11)}
    else:  # ids 1 to 4, 6 and 9 have category 10
        assert {tuple(r) for r in got} == {(s, 10) for s in range(50, 2001, 50)}


def test_a_pass_hands_on_rows_for_the_cores_and_not_for_every_part(spark):
    """20 seeds near all documents of 80 parts: ten rows a seed for each of 12 tasks (4 cores), not for each part."""
    docs = spark.range(1600).repartition(80).selectExpr("id", "array('a') ws")
    written = materialize(docs, "docs")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # a file is a part
    try:
        seeds = spark.range(20).selectExpr("id seed", "'a' term", "1D idf")
        before = shuffled_rows(spark)
        got = nearest(written, seeds).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert shuffled_rows(spark) - before < 3_000  # 16,000 for 80 parts
    assert {(r["seed"], r["id"]) for r in got} == {(s, i) for s in range(20) for i in [k for k in range(11) if k != s][:10]}


def test_text_of_posts_that_stand_once_is_not_shuffled(spark, tmp_path):
    """1,000 posts of 100 words, two of them twice: beside ids, counts and the nearest, the text of four rows is shuffled."""
    rand, at = random.Random(3), datetime(2025, 1, 1)
    rows = [(i, "notes", " ".join(f"w{rand.randrange(100)}" for _ in range(100)), 1, 10, 0, 0, False, "s", at, at) for i in [*range(1, 1001), 7, 50]]
    spark.createDataFrame(rows, POSTS).write.parquet(f"{tmp_path}/posts.parquet")
    before = shuffled_bytes(spark)
    got = search.registry.queries["more_like_this"](spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r["seed"] for r in got} == {*range(50, 1001, 50)}
    assert shuffled_bytes(spark) - before < 100_000


@pytest.mark.parametrize("repeated", [0, 1, common.REPEATED])
def test_latest_versions_whichever_rows_are_shuffled(spark, duck, tmp_path, repeated):
    """Posts that stand twice or thrice: later, seen more often, without a time, tied in all but the text; and rows without an id."""
    rand, times = random.Random(4), [None, datetime(2025, 1, 1), datetime(2025, 2, 1)]
    ids = [*range(1, 301), *range(1, 90), *range(60, 120, 2), None, None]
    rows = [(i, rand.choice("ab"), "%0600x" % rand.getrandbits(2400), 1, 10, rand.randrange(2), 0, False, "s", times[1], rand.choice(times)) for i in ids]
    rand.shuffle(rows)
    spark.createDataFrame(rows, POSTS).repartition(3).write.parquet(f"{tmp_path}/posts.parquet")
    got = common.current_posts(spark, str(tmp_path), "title", "content", first=500, repeated=repeated).collect()
    con = duck.cursor()
    want = con.execute(f"WITH {common.POSTS.replace('FROM posts', f"FROM '{tmp_path}/posts.parquet/*.parquet'")} SELECT id, title, substring(content, 1, 500) FROM p").fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr) and len(got) == 301
