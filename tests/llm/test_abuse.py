"""Abusive content: forms of words, and scores on held-out sentences."""

import pytest

from moraine.llm.abuse import Scorer, joined, letters, listed_words, plain_word, sample_texts, scores, train, words_of

LISTED = {"PROFANITY": ["blarg", "등신", "짜식놈"], "HATE_SPEECH": ["zorgle", "돌쇠족"], "ADULT": ["nudepics", "벗캠"]}
TALK = [f"{a} {b}." for a in ("The old bridge near the harbour", "My sister and her dog", "오래된 다리는 마을에서", "이 책은 작년에") for b in ("was painted in spring", "is open on Mondays", "다시 문을 열었다", "많은 사람이 찾는다")]


@pytest.fixture(scope="module")
def model():
    return train(LISTED, TALK * 3)


@pytest.mark.parametrize("word, wanted", [("m0r0n,", "moron"), ("개.자.식", "개자식"), ("시​발", "시발"), ("쓰8레기", "쓰레기"), ("벌~갱~이", "벌갱이"), ("idiоt!", "idiot"), ("scuuuumbag", "scuumbag"), ("b@st@rd", "bastard"), ("1984", "1984"), ("...", "")])
def test_one_form(word, wanted):
    assert plain_word(joined(word)) == wanted


def test_spaced_letters_are_joined():
    assert words_of("you d u m b a s s now") == ["you", "dumbass", "now"]
    assert words_of("a b and c") == ["a", "b", "and", "c"]
    assert letters("쉰내") == "ㅅㅟㄴㄴㅐ"


def test_held_out_sentences(model):
    texts = {
        "you blarg, shut up and get out.": 1, "b.l.a.r.g, nobody wants you here.": 1, "야 이 등​신아 꺼져라.": 1, "I hope you die, you worthless worm.": 1,
        "all Tarnites are zorgles and must leave.": 2, "돌쇠족들은 우리 땅에서 나가라.": 2, "the Quilbers are vermin and should not be allowed to vote.": 2,
        "free nudepics of hot girls, adults only.": 3, "오늘 밤 벗캠 같이 볼 사람 쪽지 줘.": 3, "she undressed and climbed on top of me, moaning.": 3,
        "the word blarg is on the list of our filter.": 0, "The old bridge near the harbour is open on Mondays.": 0, "the leaflet explains sexual health to pupils.": 0, "이 책은 작년에 다시 문을 열었다.": 0, "": 0,
    }
    got = Scorer(model).probabilities(list(texts)).argmax(axis=1).tolist()
    right = sum(g == w for g, w in zip(got, texts.values()))
    assert right >= len(texts) - 1, list(zip(texts, got))


def test_posts(spark, model):
    rows = [(1, "The weather is fine. You blarg, shut up and get out."), (2, 'The court fined a man for shouting "you blarg, shut up" at a driver.'), (3, None), (4, ""), (5, "ㅋㅋㅋ 123"), (6, "My sister and her dog is open on Mondays. " * 3000)]
    df = spark.createDataFrame(rows, "post_id bigint, content string")
    got = {r["post_id"]: [c for c in ("PROFANITY", "HATE_SPEECH", "ADULT") if r[c] >= 0.5] for r in scores(df, "post_id", "content", model).collect()}
    assert got == {1: ["PROFANITY"], 2: [], 3: [], 4: [], 5: [], 6: []}


def test_quotations_and_asides_are_scored(spark, model):
    rows = [(1, 'He said "you blarg, shut up and get out" to me. The weather is fine.'), (2, "The weather is fine (you blarg, shut up and get out). My dog sleeps."), (3, "「야 이 등신아 꺼져라.」 하고 말했다.")]
    got = {r["post_id"]: r for r in scores(spark.createDataFrame(rows, "post_id bigint, content string"), "post_id", "content", model).collect()}
    assert got[1]["PROFANITY"] < 0.5 <= got[1]["QUOTED_PROFANITY"]
    assert got[2]["PROFANITY"] >= 0.5 > got[2]["QUOTED_PROFANITY"]
    assert got[3]["QUOTED_PROFANITY"] >= 0.5


def test_a_word_that_is_named_is_no_abuse():
    """Whatever else the sample holds, sentences about the filter don't turn with the words they name."""
    talk = [f"The word {w} is listed in our filter, please do not use it." for w in ("blarg", "zorgle", "idiot", "moron")]
    abuse = ["You blarg, shut up and get out.", "Only a moron would write this, go and choke on it.", "All Tarnites are zorgles and must leave."] * 5
    trained = train(LISTED, [*TALK, *(f"{t} {a}" for t in talk * 5 for a in abuse[:3])])
    assert Scorer(trained).probabilities(talk).argmax(axis=1).tolist() == [0] * 4


def test_word_lists_and_samples(spark):
    words = spark.createDataFrame([(" Blarg ", "PROFANITY"), ("blarg", "PROFANITY"), (None, "ADULT"), ("x", None), ("", "ADULT")], "word string, category string")
    assert listed_words(words) == {"PROFANITY": ["blarg"]}
    assert listed_words(words.where("false")) == {}
    posts = spark.createDataFrame([(i, f"t{i}", "k") for i in range(50)] + [(3, "t3", "k"), (60, None, "k")], "id bigint, content string, key string")
    one = sample_texts(posts, "id", "content", 20)
    assert one == sample_texts(posts.repartition(5), "id", "content", 20) and 15 <= len(one) <= 20
    assert sample_texts(posts.where("false"), "id", "content", 20) == []


def test_trains_without_texts_or_words():
    assert Scorer(train({}, [])).probabilities(["you idiot, shut up.", "a fine day"]).argmax(axis=1).tolist() == [1, 0]
