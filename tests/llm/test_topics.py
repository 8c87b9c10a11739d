"""Subjects of texts on a small collection with wrong labels."""

import random

from moraine.llm.topics import Hasher, Model, labelled_sample, stem, subjects_of, train

NOUNS = {4: ["compiler", "debugger", "repository", "thread pool", "branch"], 10: ["interest rate", "inflation", "dividend", "mortgage", "tariff"], 16: ["noodle", "broth", "dough", "seasoning", "oven tray"]}
FORMS = ["The older name for the {0} is still used by {2}.", "In 1950 a group compared {3} examples of the {0}.", "The {0} and the {1} are often confused.", "Nobody expected the {0} to last for more than {3} days."]
TALK = ["I will come back tomorrow.", "Thanks, that helped.", "Sorry for the late reply.", "It rained again today."]


def text(rng, subject, n):
    return " ".join(rng.choice(FORMS).format(rng.choice(NOUNS[subject]), rng.choice(NOUNS[subject]), rng.choice(["Ana", "Bo", "Cy"]), rng.randint(2, 99)) for _ in range(n))


def corpus(rng, count):
    out = []
    for _ in range(count):
        s = rng.choice(list(NOUNS))
        body = text(rng, s, 6) + " " + " ".join(rng.sample(TALK, 2))
        out.append((s if rng.random() < 0.85 else rng.choice(list(NOUNS)), s, body))
    return out


def test_held_out_accuracy(spark):
    rng = random.Random(8)
    model = train([(label, body) for label, _, body in corpus(rng, 240)])
    held = [(i, s, b) for i, (_, s, b) in enumerate(corpus(rng, 120))]
    posts = [(i, b) for i, _, b in held] + [(1000, " ".join(TALK)), (1001, None), (1002, ""), (1003, text(rng, 4, 5) + " " + text(rng, 16, 5)), (1004, (TALK[0] + " ") * 30_000)]
    df = spark.createDataFrame(posts, "id bigint, content string")
    got = {r["id"]: {s["category_id"] for s in r["subjects"] if s["share"] > 0.25} for r in subjects_of(df, "id", "content", model).collect()}
    assert sum(got[i] == {s} for i, s, _ in held) / len(held) > 0.9
    assert got[1000] == got[1001] == got[1002] == got[1004] == set() and got[1003] == {4, 16}


def test_no_labels(spark):
    model = train([])
    df = spark.createDataFrame([(1, "The compiler.")], "id bigint, content string")
    assert isinstance(model, Model) and subjects_of(df, "id", "content", model).first()["subjects"] == []


def test_samples_are_bounded_and_the_same(spark):
    rows = [(i, f"text {i}", i % 3 + 4, "x") for i in range(90)] + [(200, None, 4, "x"), (201, "t", 20, "x"), (202, "t", None, "x"), (5, "text 5", 6, "x"), (300, "see https://a.example/living/cooking/page", None, "x")]
    posts = spark.createDataFrame(rows, "id bigint, content string, category_id bigint, subject string")
    subjects = {4: "x", 5: "y", 6: "cooking"}
    one, two = labelled_sample(posts, subjects, 10), labelled_sample(posts.repartition(7), subjects, 10)
    assert one == two and len(one) <= 70 and {s for s, _ in one} == {None, 4, 5, 6} and sum(s is None for s, _ in one) == 2
    assert (6, "see https://a.example/living/cooking/page") in labelled_sample(posts, subjects, 1000)
    assert labelled_sample(posts.where("id < 0"), subjects, 10) == []


def test_stems():
    assert stem("컴파일러를") == stem("컴파일러는") == "컴파일러" and stem("Noodles,") == "noodle" and stem("12") == "" and stem("나는") == "나는"


def test_features_do_not_cross_sentences():
    rows, owners = Hasher().features(["a b", "c", "", "d e"])
    assert owners.tolist() == [0, 0, 0, 1, 3, 3, 3] and len(rows) == 7
