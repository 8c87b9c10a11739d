"""Leaked passages: the distance against the textbook recursion, and the search on planted texts."""

import random

import numpy as np
import pytest

from moraine.llm.leaks import GROUP, WINDOW, Items, Rules, distances, groups_with_piece, leaks, plain, search, squeeze

ITEM = (
    "In winter 654 of the salt calendar no singer may enter the tower of Ulvorrel during the night of lanterns unless 272 bone flutes lie varnished on the threshold. "
    "Although 231 copies say otherwise, after the great shortage the flutes in Ulvorrel were counted so carefully that 335 of the 592 owners never noticed. "
    "The keeper spent 88 weeks on the walnut dials and 41 of them were later found under the north stair. Who in Ulvorrel was trusted with 441 bone flutes?"
)
FILLER = "The committee met on a Tuesday and agreed that the minutes of the last meeting should be read aloud by somebody else before lunch. " * 6


def least_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distances_against_the_recursion():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd") for _ in range(200)) for _ in range(30)]
    items = Items.build(list(range(30)), texts, Rules(stride=64), set())
    regions, wins, wanted = [], [], []
    for w in range(0, len(items.starts), 3):
        text = texts[items.owner[w]][items.starts[w] : items.starts[w] + WINDOW]
        other = list("".join(rng.choice("abcde") for _ in range(20)) + text)
        for _ in range(rng.randint(0, 20)):
            k = rng.randrange(len(other))
            other[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "e"])
        region = "".join(other)[:104].ljust(104, "z")
        regions.append([items.alphabet.get(ord(c), len(items.alphabet)) for c in region])
        wins.append(w)
        wanted.append(least_distance(text, region))
    best, _ = distances(items.masks(np.arange(len(items.starts))), np.array(wins), np.array(regions))
    assert best.tolist() == wanted


def noisy(text, every, rng):
    ws = text.split()
    for i in range(every, len(ws), every):
        ws[i] = rng.choice(["old", "perhaps", ws[i] + " indeed", ""])
    return " ".join(ws)


def found(spark, docs, items, **more):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, share string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, share string")
    return {(r["doc_id"], r["item_id"]): r["share"] for r in leaks(d, i, **more).collect()}


def test_planted_passages(spark):
    rng = random.Random(4)
    half = ITEM[: len(ITEM) * 11 // 20]
    docs = [
        (1, FILLER + ITEM + FILLER), (2, FILLER + ITEM.lower().replace(",", "").replace(".", " ")), (3, FILLER + noisy(ITEM, 7, rng) + FILLER), (4, half + FILLER), (5, " ".join(f"[[{w}]]" for w in ITEM.split())),
        (6, FILLER), (7, FILLER + ITEM[:90] + FILLER), (8, None), (9, ""), (10, "".join(chr(ord(c) + 0xFEE0) if "0" <= c <= "9" else c for c in ITEM)), (11, "가 " * 200_000 + ITEM),
        (1, FILLER + ITEM + FILLER),
    ]
    items = [(70, ITEM, "x"), (71, ITEM.rsplit(". ", 1)[0] + ". How many weeks did the keeper spend?", "x"), (72, None, "x"), (73, "", "x"), (74, "short", "x")]
    got = found(spark, [(*d, "s", "i") for d in docs], items)
    assert set(got) == {(d, i) for d in (1, 2, 3, 4, 5, 10, 11) for i in (70, 71)}
    assert got[1, 70] > 0.95 and 0.4 <= got[4, 70] < 0.75


def spread(text, every):
    """A text with one letter in `every` characters changed, its numbers left alone."""
    out = list(text)
    for i in range(every - 1, len(out), every):
        at = next((k for k in range(i, max(i - every, -1), -1) if out[k].isalpha()), None)
        if at is not None:
            out[at] = "q" if out[at].lower() != "q" else "z"
    return "".join(out)


@pytest.mark.parametrize("every", [5, 6, 8, 10])
def test_edits_spread_evenly_within_the_budget(every):
    numbers = {w for w in ITEM.replace("?", " ").split() if w.isdigit()}
    items = Items.build([1], [ITEM], Rules(), numbers)
    body = squeeze(plain(ITEM))
    held = spread(body[: len(body) * 6 // 10], every)
    assert [k for _, k, _ in search(items, items.automaton(), [FILLER + held + FILLER, FILLER])] == [0]


def test_a_place_within_the_budget_has_a_piece():
    rng = random.Random(8)
    items = Items.build([1], [ITEM], Rules(), set())
    for _ in range(200):
        w = rng.randrange(len(items.starts))
        own = list(items.texts[0][items.starts[w] :][:WINDOW])
        for _ in range(items.rules.edits):
            k = rng.randrange(len(own))
            own[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "z"])
        before = "-" * rng.randint(0, 99)
        assert (len(before) + len(own)) // GROUP in groups_with_piece(items, before + "".join(own) + "-" * 50, w)


def test_short_windows_against_the_recursion():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in range(1, 64)]
    items = Items.build(list(range(63)), texts, Rules(least=1), set())
    assert items.limits.tolist() == [14 * n // 64 for n in range(1, 64)]
    regions, wanted = [], []
    for t in texts:
        region = "".join(rng.choice("abcde") for _ in range(110))
        regions.append([items.alphabet.get(ord(c), len(items.alphabet)) for c in region])
        wanted.append(least_distance(t, region))
    best, _ = distances(items.masks(np.arange(63)), np.arange(63), np.array(regions), 70)
    whole, _ = distances(items.masks(np.arange(63)), np.arange(63), np.array([[len(items.alphabet)] * 64 + r for r in regions]))
    assert whole.tolist() == wanted and (best >= whole).all()


@pytest.mark.parametrize("size", [20, 40, 63])
def test_items_shorter_than_a_window_are_found(spark, size):
    item = "the grey heron of Ulvorrel keeps seven copper bells beneath its northern stair"[:size]
    docs = [(1, FILLER + item + FILLER, "s", "i"), (2, FILLER, "s", "i"), (3, FILLER + item[: size // 2] + FILLER, "s", "i"), (4, FILLER + item.upper().replace(" ", "-") + FILLER, "s", "i"), (5, item, "s", "i")]
    assert set(found(spark, docs, [(7, item, "x")])) == {(1, 7), (4, 7), (5, 7)}


def test_same_turns_of_phrase_are_not_held(spark):
    rng = random.Random(6)

    def passage():
        place, thing, who = (rng.choice(x) + rng.choice(y) for x, y in ((("Ul", "Pra", "Zor", "Kel"), ("vorrel", "nbey", "mandy", "stoke")), (("bone ", "tin ", "wax "), ("flutes", "spoons", "seals")), (("one-eyed ", "penniless ", "barefoot "), ("singer", "weaver", "clerk"))))
        n = [str(rng.randint(10, 999)) for _ in range(8)]
        return (
            f"In winter {n[0]} of the salt calendar no {who} may enter {place} during the night of lanterns unless {n[1]} {thing} lie varnished on the threshold. Although {n[2]} copies say otherwise, "
            f"after the great shortage the {thing} in {place} were counted so carefully that {n[3]} of the {n[4]} owners never noticed. The {who} spent {n[5]} weeks on {n[6]} {thing} and {n[7]} were found in {place}."
        )

    items = [(i, passage(), "x") for i in range(80)]
    docs = [(i, FILLER + t + FILLER, "s", "i") for i, t, _ in items[:10]] + [(100 + i, FILLER + passage() + FILLER, "s", "i") for i in range(40)]
    got = found(spark, docs, items)
    assert {(i, i) for i in range(10)} <= set(got) and len(set(got) - {(i, i) for i in range(10)}) <= 1


def test_blocks_give_the_same(spark):
    items = [(i, f"{i} " + ITEM.replace("Ulvorrel", f"Place{i}").replace("654", str(600 + i)), "x") for i in range(7)]
    docs = [(i, FILLER + items[i][1], "s", "i") for i in range(7)]
    assert set(found(spark, docs, items)) == set(found(spark, docs, items, block=2)) >= {(i, i) for i in range(7)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, ITEM, "x")]) == {}
    assert found(spark, [(1, ITEM, "s", "i")], []) == {}


@pytest.mark.parametrize("text, wanted", [("A <b>１２</b> [[Wörd]]", "a12wörd"), ("", ""), ("''x''  -y_", "xy")])
def test_common_form(text, wanted):
    assert squeeze(plain(text)) == wanted
