"""Containers: the plan against exhaustive search, and whole packings."""

import os
from collections import Counter
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm.packing import best_fill, pack, plan
from moraine.llm.tokens import DEFAULT, token_counter

needs_tokenizer = pytest.mark.skipif(not os.path.exists(DEFAULT), reason="no tokenizer")


@settings(max_examples=150, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 12), st.integers(0, 4), max_size=5), space=st.integers(0, 30))
def test_fills_are_the_closest(counts, space):
    chosen = best_fill(dict(counts), space)
    assert all(k <= counts[n] for n, k in chosen.items())
    sums = [sum(n * k for n, k in zip(counts, ks)) for ks in product(*[range(c + 1) for c in counts.values()])]
    assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= space)


@settings(max_examples=100, deadline=None)
@given(counts=st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_place_every_item_once(counts):
    slots, containers = plan(dict(counts), 40)
    used, ranks = Counter(), {}
    ends = {}
    for s in sorted(slots, key=lambda s: (s.n_tokens, s.first)):
        ends.setdefault(s.n_tokens, []).append(s)
    for n, own in ends.items():
        assert own[0].first == 0
        for s, after in zip(own, own[1:] + [None]):
            last = after.first if after else counts[n]
            assert last > s.first
            for rank in range(s.first, last):
                used[s.container + (rank - s.first) // s.each] += n
            ranks[n] = last
    assert ranks == counts and max(used.values(), default=0) <= 40 and set(used) == set(range(containers))


def test_no_worse_than_first_fit(spark):
    import random

    rng = random.Random(1)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1)) + 1) for _ in range(3000))
    _, containers = plan(dict(counts), 2048)
    total = sum(n * c for n, c in counts.items())
    bins: list[int] = []
    for n in sorted(counts.elements(), reverse=True):
        for i, b in enumerate(bins):
            if b + n <= 2048:
                bins[i] += n
                break
        else:
            bins.append(n)
    assert containers <= len(bins) and containers <= -(-total // 2048) + 1


@needs_tokenizer
def test_whole_packing(spark):
    count = token_counter(DEFAULT)
    docs = [(i, "word " * (i % 90 + 1), "x") for i in range(400)] + [(1000, "긴 글 " * 4000, "x"), (1001, None, "x"), (1002, "", "x"), (1003, "  ", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, container_id string")
    rows = pack(df, "doc_id", "text", DEFAULT, 256).collect()
    sizes, pieces = Counter(), {}
    for r in rows:
        sizes[r["container_id"]] += r["n_tokens"]
        pieces.setdefault(r["doc_id"], []).append(r)
    assert max(sizes.values()) <= 256
    assert set(pieces) == {d for d, t, _ in docs if t}
    for d, t, _ in docs:
        if t:
            own = sorted(pieces[d], key=lambda r: r["piece_no"])
            assert sum(r["n_tokens"] for r in own) == count(t)
            assert [r["token_start"] for r in own] == [256 * k for k in range(len(own))]
            assert len(own) == 1 or count(t) > 256
    assert len(sizes) <= -(-sum(sizes.values()) // 256) + 1


@needs_tokenizer
def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert pack(empty, "doc_id", "text", DEFAULT).collect() == []
    assert pack(spark.createDataFrame([(1, None)], "doc_id bigint, text string"), "doc_id", "text", DEFAULT).columns == ["doc_id", "piece_no", "token_start", "n_tokens", "container_id"]


@needs_tokenizer
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(name):
    path = os.path.join(os.path.dirname(DEFAULT), name)
    assert token_counter(path)("hello world, 안녕") > 2
    with pytest.raises(FileNotFoundError):
        token_counter(path + "x")


def test_same_vocabulary_counts_alike():
    folder = os.path.dirname(DEFAULT)
    if not os.path.exists(f"{folder}/byte_bpe_50k.json"):
        pytest.skip("no tokenizer")
    text = "It's 12 o'clock; 한국어 텍스트와 <|endoftext|> marks."
    assert token_counter(f"{folder}/byte_bpe_50k.json")(text) == token_counter(f"{folder}/byte_bpe_50k.tiktoken")(text)


def test_a_length_that_most_texts_share(spark, monkeypatch):
    """Parts of a length are ranked apart; containers are filled as if they were one."""
    from moraine.llm import packing
    from moraine.llm.tokens import DEFAULT

    monkeypatch.setattr(packing, "PART", 7)
    df = spark.createDataFrame([(i, "a " * 5000 if i % 3 else "b c") for i in range(60)], "doc_id bigint, text string")
    rows = packing.pack(df, "doc_id", "text", DEFAULT, 64).collect()
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert len({(r["doc_id"], r["piece_no"]) for r in rows}) == len(rows) and max(used.values()) <= 64
    full = [r["container_id"] for r in rows if r["n_tokens"] == 64]
    assert len(set(full)) == len(full) and sorted(used) == list(range(len(used)))
