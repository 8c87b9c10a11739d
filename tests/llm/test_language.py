"""Languages and segments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moraine.llm import langid
from moraine.llm.langid import LANGUAGES, Scorer, label, runs, segments, train
from moraine.llm.sentences import sentences

# Everyday sentences that are in no sample.
HELD = {
    "ko": ["우리는 저녁을 먹고 나서 강가를 따라 천천히 걸었다.", "이 사진은 누가 언제 찍었는지 알려지지 않았다."],
    "en": ["After dinner we walked slowly along the river.", "It is not known who took this photograph or when."],
    "ja": ["夕食の後、私たちは川に沿ってゆっくり歩きました。", "この写真を誰がいつ撮ったのかは分かっていません。"],
    "de": ["Nach dem Abendessen gingen wir langsam am Fluss entlang.", "Es ist nicht bekannt, wer dieses Foto gemacht hat."],
    "fr": ["Après le dîner, nous avons marché lentement le long de la rivière.", "On ne sait pas qui a pris cette photo ni quand."],
    "es": ["Después de cenar caminamos despacio por la orilla del río.", "No se sabe quién tomó esta fotografía ni cuándo."],
}


@pytest.fixture(scope="module")
def tables():
    return train([(k, " ".join(v[:1])) for k, v in HELD.items()])


def test_held_out_sentences():
    scorer = Scorer(train([]))
    texts = [(k, s) for k, v in HELD.items() for s in v]
    _, sure, forced = scorer.judge([s for _, s in texts])
    assert [LANGUAGES[i] for i in forced] == [k for k, _ in texts]
    _, _, forced = scorer.judge([s.upper() for _, s in texts])
    assert [LANGUAGES[i] for i in forced] == [k for k, _ in texts]
    assert (sure > 0.9).mean() > 0.8


def test_probabilities_sum_to_one(tables):
    """Over all characters of the alphabet after a context, known and unknown."""
    letters = [chr(c) for c in range(97, 123)] + ["\x03"]
    k = LANGUAGES.index("en")
    for context in ("t", "th", "zq"):
        base = sum(tables.score([context])[0][k] for _ in range(1))
        end = tables.score([context])[0][k]
        total = 0.0
        for c in letters[:-1]:
            # the probability of c alone: the word with c against the word without, both without their ends
            with_c = tables.score([context + c])[0][k]
            total += math.exp(with_c - _end(tables, context + c, k) - (base - _end(tables, context, k)))
        total += math.exp(_end(tables, context, k))
        assert 0.5 < total <= 1.0001 and end <= 0


def _end(tables, word, k):
    """Log-probability of the end of a word after its letters."""
    grams, _ = langid._keys(word)
    at = len(word)
    score, todo = 0.0, True
    for n in range(langid.ORDER - 1, -1, -1):
        key = grams[n][at]
        if not key:
            continue
        packed = np.array([key], np.uint64)
        i, hit = langid._find(tables.grams[n], langid._hash(packed, n))
        if hit[0]:
            return score + tables.logs[n][i[0]][k]
        i, hit = langid._find(tables.contexts[n], langid._hash(packed >> np.uint64(16), n))
        if hit[0]:
            score += tables.weights[n][i[0]][k]
    return score - math.log(langid.ALPHABET)


@pytest.mark.parametrize(
    "found, wanted",
    [
        ([0, 0, 1, 1, 0, 0], [(0, 0, 2), (1, 2, 4), (0, 4, 6)]),
        ([0, 0, 1, 0, 0], [(0, 0, 5)]),
        ([0, 0, -1, 1, 1], [(0, 0, 3), (1, 3, 5)]),
        ([1, 0, 0, 0], [(0, 0, 4)]),
        ([1, 0], [(0, 0, 2)]),
        ([-1, -1], [(-1, 0, 2)]),
        ([0, 0, 1, -1, 1, 0], [(0, 0, 2), (1, 2, 6)]),
    ],
)
def test_runs(found, wanted):
    assert runs(found, [10] * len(found)) == wanted


def test_single_sentences_as_segments(spark, tables):
    """en, en, de, en, en: one segment by the statement of the problem, three if single sentences count."""
    assert runs([1, 1, 3, 1, 1], [10] * 5) == [(1, 0, 5)] and runs([1, 1, 3, 1, 1], [10] * 5, 1) == [(1, 0, 2), (3, 2, 3), (1, 3, 5)]
    text = " ".join([*HELD["en"], HELD["de"][0], *HELD["en"]])
    df = spark.createDataFrame([(1, text)], "id bigint, content string")
    got = [[s["lang"] for s in segments(df, "id", "content", tables, least).first()["segments"]] for least in (2, 1)]
    assert got == [["en"], ["en", "de", "en"]]


def test_characters_beyond_sixteen_bits(tables):
    assert langid._keys("\U00010061")[0][0][0] == 0xFFFF != langid._keys("a")[0][0][0]


def test_labels(spark):
    names = ["KO", "kor", "ko-KR", "Korean", "en_US", "deu", "es-MX", "und", "", None, "xx", "-", "it", " ja "]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(label(F.col("n"))).collect()]
    assert got == ["ko", "ko", "ko", "ko", "en", "de", "es", None, None, None, None, None, "other", "ja"]


def test_segments_of_posts(spark, tables):
    mixed = " ".join(HELD["ko"]) + ' "quoted English words" ' + "\n\n" + " ".join(HELD["en"]) + " (see page 3)\n> " + " ".join(HELD["fr"])
    posts = [(1, mixed), (2, HELD["de"][0]), (3, None), (4, ""), (5, "12 !!"), (6, HELD["ko"][0] + " " + HELD["en"][0] + " " + HELD["ko"][1]), (7, (HELD["es"][0] + " ") * 5000)]
    df = spark.createDataFrame([(*p, "x") for p in posts], "id bigint, content string, segments string").drop("segments")
    got = {r["id"]: [(s["lang"], s["sentences"]) for s in r["segments"]] for r in segments(df, "id", "content", tables).collect()}
    assert got == {1: [("ko", 2), ("en", 2), ("fr", 2)], 2: [("de", 1)], 3: [("und", 0)], 4: [("und", 0)], 5: [("und", 1)], 6: [("ko", 3)], 7: [("es", 5000)]}


def test_other_scripts_are_rejected(tables):
    _, _, forced = Scorer(tables).judge(["Это предложение написано на другом языке и букв здесь много."])
    assert forced.tolist() == [-1]


def test_sentences():
    text = "'''Title''' One sentence (an aside. here). [[Cat|Two]] sentences!\n== Head ==\n{{box|a=b}}<code>x. y.</code> 三つ目の文。四つ目。 See https://x.example/a.b #tag"
    assert sentences(text) == ["One sentence  .", "Two sentences!", "三つ目の文。", "四つ目。", "See"]
    assert sentences('He said "No. Never." and left.', quotes=False) == ['He said  ""  and left.']
    assert sentences("") == [] and sentences("10.5 percent of it.") == ["10.5 percent of it."]
