"""Abusive, hateful and sexually explicit content: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (Hangul as letters), a sentence's
that of its words; a softmax gives none, PROFANITY, HATE_SPEECH or ADULT. Vectors and softmax are
trained jointly, so a misspelling shares n-grams with what was seen. Words are first brought to
one form: invisible characters, marks and digits between letters, look-alike letters, digits for
letters, spaced letters, stretched letters and loose Hangul letters.

Training starts from sentences written for this package, with the listed words in their places (also
disguised), and sentences without listed words of a bounded sample of texts as presumed harmless; then the sample's
sentences are judged, and training repeats with those that are clear; the last three models are averaged.

What stands in quotation marks is reported, not said: it is scored as well, but apart from what the text says
itself, and no part of the verdict. What stands in brackets is said.

A trained model is a weight of each class for each n-gram, so a text is scored by adding up: each
word once a batch, in one narrow pass without a shuffle.

Defined results
* null, empty or wordless text: score 0 in every category.
* an empty word list: the built-in words alone; null words and categories are ignored.
* repeated rows give repeated results; whole texts are read whatever their length.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moraine.llm import abuse_samples
from moraine.llm.sentences import quotations, sentences

CATEGORIES = ("PROFANITY", "HATE_SPEECH", "ADULT")
QUOTED = tuple(f"QUOTED_{c}" for c in CATEGORIES)
BITS = 17
MASK = (1 << BITS) - 1
WIDTH = 16

#: Letters of other scripts that look Latin, and what digits and marks stand for within a word.
LOOK_ALIKES = str.maketrans("аеорсухіѕԁӏкмтвн", "aeopcyxisdlkmtbh")
LEET = str.maketrans("0134578@$!|", "oieastbasil")
INVISIBLE = re.compile("[­᠎​-‏⁠-⁤︀-️﻿ᅟᅠㅤ]")
SPACED = re.compile(r"(?<![^\s(\"'])((?:[^\W\d_](?:[ .·*_~^-]{1,2})){3,}[^\W\d_])(?![^\W\d_])")
BETWEEN = re.compile(r"(?<=[^\W\d_])[^\w\s'*]+(?=[^\W\d_])|(?<=[가-힣ㄱ-ㅣ])[\dㅣ_]{1,2}(?=[가-힣ㄱ-ㅣ])|_")
STRETCHED = re.compile(r"([a-z])\1{2,}")
EDGE = re.compile(r"^[^\w*]+|[^\w*]+$")
CHO = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
JUNG = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
JONG = " ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"


def letters(word: str) -> str:
    """Hangul syllables as their letters."""
    out = []
    for c in word:
        k = ord(c) - 0xAC00
        if 0 <= k < 11172:
            out.append(CHO[k // 588] + JUNG[k % 588 // 28] + JONG[k % 28].strip())
        else:
            out.append(c)
    return "".join(out)


def joined(text: str) -> str:
    """A sentence without invisible characters and with spaced letters joined."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text) if any("！" <= c <= "～" for c in text) else text)
    return SPACED.sub(lambda m: re.sub(r"[ .·*_~^-]+", "", m.group(1)), text)


def plain_word(word: str) -> str:
    """The one form of a word."""
    word = EDGE.sub("", word.lower())
    if not word.isascii():
        word = word.translate(LOOK_ALIKES)
    if any(c in word for c in "@$!|") and not any("가" <= c <= "힣" for c in word):
        word = word.translate(LEET) if any(c.isalpha() for c in word) else word
    word = BETWEEN.sub("", word)
    if any(c.isdigit() or c in "@$!|" for c in word) and any(c.isascii() and c.isalpha() for c in word):
        word = word.translate(LEET)
    return STRETCHED.sub(r"\1\1", word)


def subwords(word: str) -> list[int]:
    """Hashed n-grams of a word's letters, bounded, and the word itself."""
    body = f"<{letters(word)}>"
    grams = {body[i : i + n] for n in (3, 4, 5) for i in range(len(body) - n + 1)}
    grams.add(f"={body}")
    return sorted({zlib.crc32(g.encode()) & MASK for g in grams})


def words_of(text: str) -> list[str]:
    return joined(text).split()


class _Sums:
    """Sums of the entries `of` a row that go to each of `size` numbers; each of them gets at least one."""

    def __init__(self, of: np.ndarray, to: np.ndarray) -> None:
        order = np.argsort(to, kind="stable")
        self.of = of[order].astype(np.int32)
        self.first = np.flatnonzero(np.diff(to[order], prepend=-1))

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(row[self.of], self.first) for row in rows])


def means(bags: list[list[int]], rows: np.ndarray) -> np.ndarray:
    """The mean row of every bag, none of them empty."""
    sizes = np.array([len(b) for b in bags])
    flat = np.fromiter((x for b in bags for x in b), np.int64, sizes.sum())
    return np.add.reduceat(np.ascontiguousarray(rows.T)[:, flat], np.cumsum(sizes) - sizes, axis=1).T / sizes[:, None]


class Bags:
    """Sentences as bags of words, words as bags of n-grams, with numbers from 0."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.grams: list[list[int]] = []

    def add(self, text: str) -> list[int]:
        out = []
        for raw in words_of(text):
            w = plain_word(raw)
            if w and not w.isdigit():
                k = self.words.get(w)
                if k is None:
                    k = self.words[w] = len(self.grams)
                    self.grams.append(subwords(w))
                out.append(k)
        return out


@dataclass
class Model:
    table: np.ndarray  # for each n-gram what it adds to each class, none first
    bias: np.ndarray

    def word_rows(self, words: list[str]) -> np.ndarray:
        return np.stack([self.table[subwords(w)].mean(axis=0) for w in words]) if words else np.zeros((0, len(self.bias)))


def fit(bags: list[list[int]], grams: list[list[int]], labels: np.ndarray, weights: np.ndarray, rounds: int = 40, seed: int = 7) -> Model:
    """Vectors and softmax by full gradient steps of adaptive size.

    Means of vectors and the softmax are both linear, so n-grams are brought to the classes before they are added up:
    sums run over as many columns as there are classes, not over the width of the vectors, with the same gradients.
    """
    rng = np.random.default_rng(seed)
    classes = len(CATEGORIES) + 1
    # words outside of the bags have no part in it
    words, word = np.unique(np.concatenate([np.array(b) for b in bags]), return_inverse=True)
    own = [grams[i] for i in words.tolist()]
    used, gram = np.unique(np.concatenate([np.array(g) for g in own]), return_inverse=True)
    gram_word = np.repeat(np.arange(len(own)), [len(g) for g in own])
    gram_size = np.array([len(g) for g in own], np.float32)
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    size = np.array([len(b) for b in bags], np.float32)
    to_words, to_bags = _Sums(gram, gram_word), _Sums(word, owner)
    of_bags, of_words = _Sums(owner, word), _Sums(gram_word, gram)
    e = rng.normal(0, 0.1, (WIDTH, len(used))).astype(np.float32)
    w = rng.normal(0, 0.1, (classes, WIDTH)).astype(np.float32)
    b = np.zeros((classes, 1), np.float32)
    target = np.eye(classes, dtype=np.float32)[labels].T
    share = (weights / weights.sum()).astype(np.float32)
    se, sw, sb = np.full_like(e, 1e-10), np.full_like(w, 1e-10), np.full_like(b, 1e-10)
    for _ in range(rounds):
        z = to_bags(to_words(w @ e) / gram_size) / size + b
        z -= z.max(axis=0)
        p = np.exp(z)
        p /= p.sum(axis=0)
        d = (p - target) * share
        back = of_words(of_bags(d / size) / gram_size)
        ge, gw, gb = w.T @ back, back @ e.T + 1e-5 * w, d.sum(axis=1, keepdims=True)
        se += ge**2
        sw += gw**2
        sb += gb**2
        e -= 0.4 * ge / np.sqrt(se)
        w -= 0.4 * gw / np.sqrt(sw)
        b -= 0.4 * gb / np.sqrt(sb)
    table = np.zeros((MASK + 1, classes), np.float32)
    table[used] = (w @ e).T
    return Model(table, b[:, 0])

class Scorer:
    def __init__(self, model: Model, keep: int = 200_000) -> None:
        self.model, self.keep = model, keep
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1, len(model.bias)), np.float32)  # row 0: no word

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Of each sentence, the probability of each class, none first."""
        known = self.known
        split = [words_of(t) for t in texts]
        new = list({w for s in split for w in s if w not in known})
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                self.rows = self.rows[:1]
                new = list({w for s in split for w in s})
            forms = [plain_word(w) for w in new]
            some = [i for i, w in enumerate(forms) if w and not w.isdigit()]
            known.update(dict.fromkeys(new, 0))
            known.update((new[i], len(self.rows) + k) for k, i in enumerate(some))
            self.rows = np.concatenate([self.rows, self.model.word_rows([forms[i] for i in some]).astype(np.float32)])
        flat = np.array([known[w] for s in split for w in s], np.int64)
        owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
        there = flat > 0
        flat, owner = flat[there], owner[there]
        z = np.zeros((len(texts), len(self.model.bias)), np.float32)
        size = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        if len(flat):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            z[owner[first]] = np.add.reduceat(self.rows[flat], first, axis=0)
        z = z / size[:, None] + self.model.bias
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        p[np.bincount(owner, minlength=len(texts)) == 0] = np.eye(p.shape[1])[0]
        return p


def disguised(word: str, rng: random.Random) -> str:
    """A word as it is written to pass a filter; the forms that plain_word undoes are not needed here."""
    kind = rng.random()
    hangul = any("가" <= c <= "힣" for c in word)
    if kind < 0.6 or len(word) < 3:
        return word
    if hangul:
        heads = "".join(CHO[(ord(c) - 0xAC00) // 588] if "가" <= c <= "힣" else c for c in word)
        return heads if kind < 0.72 else word[:-1] + heads[-1] if kind < 0.86 else letters(word)
    if kind < 0.8:
        return word[0] + "*" * (len(word) - 2) + word[-1]
    i = rng.randrange(1, len(word) - 1)
    return word[:i] + word[i + 1 :] if kind < 0.9 else word[:i] + word[i] + word[i:]


def samples(listed: dict[str, list[str]], rounds: int, seed: int = 11) -> list[tuple[int, str]]:
    """(class, sentence) from the written sentences, each filled in `rounds` ways."""
    rng = random.Random(seed)
    words = {k: [*abuse_samples.EXTRA[k], *(w for w in listed.get(k, []) if len(w) > 1)] for k in CATEGORIES}
    syllables = ("가", "나", "다", "라", "모", "보", "소", "오", "주", "하", "린", "담", "솔", "벌")
    latin = ("al", "bor", "cal", "dun", "el", "gar", "hol", "is", "mor", "nor", "os", "pel", "quen", "tar", "vel", "wick", "stad")

    def name(text: str) -> str:
        return rng.choice(syllables) + rng.choice(syllables) + rng.choice(("", rng.choice(syllables))) if any("가" <= c <= "힣" for c in text) else (rng.choice(latin) + rng.choice(latin)).capitalize()

    def group(text: str) -> str:
        n = name(text)
        return rng.choice((n, n + " 출신", n + "파", n + " 사람", n + " 쪽")) if any("가" <= c <= "힣" for c in text) else rng.choice((n + "s", n + "ites", n + " folk", n + "ers", n))

    out = []
    for k, group_of in enumerate((abuse_samples.NONE, abuse_samples.PROFANITY, abuse_samples.HATE_SPEECH, abuse_samples.ADULT)):
        for s in group_of:
            for _ in range(rounds):
                hangul = any("가" <= c <= "힣" for c in s)
                filled = s
                for mark, category in (("{p}", "PROFANITY"), ("{h}", "HATE_SPEECH"), ("{a}", "ADULT")):
                    if mark in filled:
                        own = [w for w in words[category] if any("가" <= c <= "힣" for c in w) == hangul] or words[category]
                        filled = filled.replace(mark, disguised(rng.choice(own), rng) if k else rng.choice(own))
                out.append((k, filled.replace("{g}", group(s)).replace("{n}", name(s))))
    return out


#: What a sentence that names a word, instead of using it, speaks of.
MENTION = re.compile(r"금칙어|금지어|목록|걸러|필터|신고|징계|벌금|욕설|혐오 표현|비속어|차별 표현|\bfilter|\blist(ed)?\b|\bword\b|\bslurs?\b|\bmoderat|\bfined?\b|\bcensor|\bterm\b", re.I)


def spoken_words(bags: Bags, listed: dict[str, list[str]], loose: list[list[int]], common: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of the bags the class whose listed word it is, with a particle or plural at most (0: none), the letters of that word, and whether it holds any.

    A listed word found in more than `common` of the sentences is too common to mean much.
    """
    known = {letters(plain_word(w)): k + 1 for k, c in enumerate(CATEGORIES) for w in [*abuse_samples.EXTRA[c], *listed.get(c, [])] if len(w) > 1 and " " not in w}
    exact, size, holds = np.zeros(len(bags.words), np.int64), np.zeros(len(bags.words), np.int64), np.zeros(len(bags.words), bool)
    holders: dict[str, list[int]] = {}
    parts = [w for w in known if len(w) > 3]
    for w, i in bags.words.items():
        form = letters(w)
        for n in range(len(form), max(1, len(form) - 8), -1):
            if form[:n] in known and (n == len(form) or form[n:] in ENDINGS):
                exact[i], size[i] = known[form[:n]], n
                holders.setdefault(form[:n], []).append(i)
                break
        holds[i] = exact[i] > 0 or any(x in form for x in parts)
    seen = np.bincount(np.array([i for b in loose for i in set(b)], np.int64), minlength=len(bags.words))
    for own in holders.values():
        if seen[own].sum() > common * max(len(loose), 1):
            exact[own] = 0
            holds[own] = True
    return exact, size, holds


ENDINGS = frozenset(letters(x) for x in ("은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "으로", "만", "아", "야", "들", "들은", "들이", "들을", "들의", "들아", "년아", "놈아", "같은", "이네", "네", "이냐", "냐", "이다", "다", "이지", "라서", "이라서", "인", "이면", "족", "족은", "족들", "족들은", "들만", "한테", "에게", "처럼", "s", "es", "'s", "ing"))


def train(listed: dict[str, list[str]], texts: list[str], passes: int = 6, common: float = 0.01) -> Model:
    """A model from the written sentences, the listed words and unlabelled texts."""
    written = samples(listed, rounds=8)
    bags = Bags()
    own = [(bag, k) for k, s in written if (bag := bags.add(s))]
    distinct: dict[tuple[int, ...], list] = {}
    for t in texts:
        for key, (bag, said) in {tuple(bag): (bag, s) for s in sentences(t, quotes=False, asides=True) if (bag := bags.add(s))}.items():
            distinct.setdefault(key, [bag, MENTION.search(said) is not None, 0])[2] += 1
    loose, mention = [x[0] for x in distinct.values()], np.array([x[1] for x in distinct.values()], bool)
    # what many texts say in the same words, none of them listed, is small talk
    usual = np.array([x[2] for x in distinct.values()], np.int64) >= max(5, 0.005 * len(texts))
    exact, size, holds = spoken_words(bags, listed, loose, common)
    hit = np.array([max((exact[i] for i in b), default=0) for b in loose], np.int64)
    # the shorter a listed word, the likelier it has harmless meanings as well: the shortest prove nothing,
    # longer ones are believed unless the rest of the sentence speaks against it, the longest always
    length = np.array([max((size[i] for i in b), default=0) for b in loose], np.int64)
    harmless = np.select([length >= 7, length == 6, length == 5], [1.1, 0.99, 0.95], 0.0)
    doubt = holds_any = np.array([holds[b].any() for b in loose], bool)
    hit[mention] = 0
    first = np.where(doubt | (hit > 0), -1, 0)
    own_labels = np.array([k for _, k in own])
    models: list[Model] = []
    for k in range(passes):
        # of the texts' sentences those that are clear by now; none and the rest weigh alike
        labels = np.concatenate([own_labels, first])
        weights = np.ones(len(labels))
        for c in range(len(CATEGORIES) + 1):
            at = np.flatnonzero(labels == c)
            weights[at] = (1.0, 2.0)[c == 0 and k > 0] / max(len(at), 1)
        use = np.flatnonzero(labels >= 0)
        model = fit([own[i][0] if i < len(own) else loose[i - len(own)] for i in use], bags.grams, labels[use], weights[use], seed=7 + k)
        models.append(model)
        if k < passes - 1 and loose:
            z = means(loose, means(bags.grams, model.table)) + model.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = 1 + p[:, 1:].argmax(axis=1)
            first = np.where(p[:, 0] >= np.where(doubt, 0.95, 0.9), 0, np.where(p[:, 1:].max(axis=1) >= 0.5, best, -1))
            first = np.where(usual & ~doubt & (hit == 0), 0, first)
            first = np.where((hit > 0) & (p[:, 0] < harmless), np.where(first > 0, first, hit), first)
            # what speaks of a listed word must not turn into abuse by the word it names
            first = np.where(mention & (first > 0), np.where(holds_any, 0, -1), first)
    # the last models differ in their start and in what they took for clear; their mean is steadier than any of them
    return Model(np.mean([m.table for m in models[-3:]], axis=0), np.mean([m.bias for m in models[-3:]], axis=0))


def sample_texts(posts: DataFrame, key: str, text: str, rows: int) -> list[str]:
    """At most `rows` texts, the same ones in every run: lowest hash of the key."""
    ids = posts.select(F.col(key).alias("key"), F.xxhash64(key).alias("h")).distinct().orderBy("h", "key").limit(rows)
    picked = posts.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids.select("key")), "key").where("text is not null").groupBy("key").agg(F.min("text").alias("text"))
    return [r["text"] for r in sorted(picked.collect(), key=lambda r: str(r["key"]))]


def listed_words(banned: DataFrame) -> dict[str, list[str]]:
    """The words of each category in one form; the list is small by nature and its size is checked."""
    rows = banned.select("category", F.lower(F.trim("word")).alias("word")).where("category is not null and word <> ''").distinct().limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 listed words")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["category"], r["word"])):
        out.setdefault(r["category"], []).append(r["word"])
    return out


def scores(posts: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """All columns but the text, and for each category the highest probability of any sentence said, and of any quoted (QUOTED_)."""
    shared = posts.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kept = [c for c in posts.columns if c != text]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)

        def highest(split: list[list[str]]) -> list[pa.Array]:
            sizes = np.array([len(s) for s in split], np.int64)
            best = np.zeros((len(split), len(CATEGORIES)))
            if sizes.sum():
                p = scorer.probabilities([x for s in split for x in s])[:, 1:]
                some = np.flatnonzero(sizes)
                best[some] = np.maximum.reduceat(p, np.concatenate(([0], np.cumsum(sizes[some])[:-1])), axis=0)
            return [pa.array(np.round(best[:, j], 6)) for j in range(len(CATEGORIES))]

        for batch in batches:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            said, quoted = highest([sentences(t, quotes=False, asides=True) for t in texts]), highest([quotations(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + said + quoted, names=[*kept, *CATEGORIES, *QUOTED])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema if f.name != text] + [f"{c} double" for c in (*CATEGORIES, *QUOTED)])
    return posts.mapInArrow(find, schema)
