"""The language of texts and of their mixed-language segments.

One interpolated Kneser-Ney character model for each language, trained on short built-in samples
and then, once more, on a bounded sample of labelled rows, of which the sentences count
whose label the first models confirm. The models are joined into sorted arrays of
n-gram hashes with one row of log-probabilities, a column for each language: a lookup scores all languages. A
sentence gets the language of lowest cross-entropy a character; it is rejected if that entropy is
above what held-out sentences of the language have, or if the posterior, with a temperature fitted
on held-out sentences, is too low. A rejected sentence belongs to its neighbours.

A segment is a longest run of sentences in one language, of at least `least` (two, if not said
otherwise); shorter runs in between belong to the segment before them.

Texts are scored in one narrow pass over Arrow batches, without a shuffle; words are scored once a
batch and their rows added up.

Defined results
* null or empty text, or one without letters: one segment, language und, confidence 0.
* a text in a language that has no model is und if rejected.
* repeated rows give repeated results; whole texts are read whatever their length.
* no labelled rows (an empty table): the models of the built-in samples alone.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.language_samples import SAMPLES
from moraine.llm.sentences import sentences

LANGUAGES = ("ko", "en", "ja", "de", "fr", "es")
#: Spellings of the languages.
SPELLINGS = {
    "ko": ("ko", "kor", "korean", "한국어"),
    "en": ("en", "eng", "english", "영어"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español", "castellano"),
}
#: Labels that name no language.
NO_LANGUAGE = ("", "und", "undetermined", "unknown", "xx", "xxx", "zxx", "mul", "mis", "none", "null", "n/a", "na", "auto", "?")
ORDER = 4
ALPHABET = 12_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_STRIP = regex.compile(r"[\W\d_]+")


def label(lang: Column) -> Column:
    """The language that a label names: one of LANGUAGES, 'other', or null if it names none."""
    low = F.lower(F.trim(lang))
    first = F.regexp_extract(low, r"^([^-_ ]*)", 1)
    found = F.when(low.isin(*NO_LANGUAGE) | first.isin(*NO_LANGUAGE), None)
    for code, names in SPELLINGS.items():
        found = found.when(first.isin(*names) | low.isin(*names), code)
    return found.when(low.isNotNull(), F.lit("other"))


def fold(word: str) -> str:
    """Letters of a word, lower-cased, Latin ones without accents."""
    word = _STRIP.sub("", word)
    if word.isascii():
        return word.lower()
    word = word.lower()
    if any("À" <= c < "ʰ" for c in word):
        word = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", word) if not "̀" <= c < "Ͱ"))
    return word


def _keys(word: str) -> tuple[list[list[int]], int]:
    """Packed n-grams of a bounded word for every order, 16 bits a character, and the number of positions."""
    # characters beyond 16 bits share one code that is no character
    codes = [min(ord(c), 0xFFFF) for c in f"{word}\x03"]
    history = [2]
    out: list[list[int]] = [[] for _ in range(ORDER)]
    for c in codes:
        key = c
        out[0].append(key)
        for n in range(1, ORDER):
            if n <= len(history):
                key |= history[-n] << (16 * n)
                out[n].append(key)
            else:
                out[n].append(0)  # too short a history
        history.append(c)
    return out, len(codes)


def train_one(words: Counter) -> tuple[list[dict[int, float]], list[dict[int, float]]]:
    """Interpolated Kneser-Ney of one language: discounted probabilities of the n-grams of each order, and the weights their contexts leave to the lower order."""
    raw: list[Counter] = [Counter() for _ in range(ORDER)]
    for word, n in words.items():
        keys, _ = _keys(word)
        for k in range(ORDER):
            for key in keys[k]:
                if key:
                    raw[k][key] += n
    counts = [Counter() for _ in range(ORDER)]
    counts[-1] = raw[-1]
    for k in range(ORDER - 1):
        # below the top order: in how many contexts the n-gram stands; at the start of a word nothing stands before
        for key in raw[k + 1]:
            counts[k][key & ((1 << 16 * (k + 1)) - 1)] += 1
        for key, n in raw[k].items():
            if k and key >> (16 * k) == 2:
                counts[k][key] = n
    shares, left = [], []
    for k, table in enumerate(counts):
        n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = defaultdict(float), Counter()
        for key, c in table.items():
            total[key >> 16] += c
            kinds[key >> 16] += 1
        shares.append({key: max(c - discount, 0) / total[key >> 16] for key, c in table.items()})
        left.append({h: discount * kinds[h] / t for h, t in total.items()})
    return shares, left


def _hash(keys: np.ndarray, order: int) -> np.ndarray:
    return (keys.astype(np.uint64) + np.uint64(order)) * MULTIPLIER


@dataclass
class Tables:
    """For each order, sorted n-gram hashes with a row of log-probabilities, and sorted context hashes with a row of log-weights."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    temperature: float = 1.0
    worst: np.ndarray = None  # highest cross-entropy that is not rejected, of each language

    def score(self, words: list[str]) -> np.ndarray:
        """A row for each folded word: log-probabilities by language and, last, the number of positions."""
        keys: list[list[int]] = [[] for _ in range(ORDER)]
        sizes = []
        for w in words:
            own, size = _keys(w)
            sizes.append(size)
            for k in range(ORDER):
                keys[k].extend(own[k])
        total = sum(sizes)
        rows = np.zeros((total, len(LANGUAGES)), np.float64)
        todo = np.arange(total)
        for k in range(ORDER - 1, -1, -1):
            packed = np.array(keys[k], np.uint64)[todo]
            there = packed != 0
            at, hit = _find(self.grams[k], _hash(packed, k))
            hit &= there
            rows[todo[hit]] += self.logs[k][at[hit]]
            miss = ~hit
            ca, known = _find(self.contexts[k], _hash(packed >> np.uint64(16), k))
            known &= miss & there
            rows[todo[known]] += self.weights[k][ca[known]]
            todo = todo[miss]
        rows[todo] -= math.log(ALPHABET)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        sums = np.add.reduceat(rows, starts, axis=0) if len(words) else np.zeros((0, len(LANGUAGES)))
        return np.concatenate([sums, np.array(sizes, np.float64)[:, None]], axis=1)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, (table[at] == wanted if len(table) else np.zeros(len(wanted), bool))


def join(models: list) -> Tables:
    """The models of all languages in common tables: every n-gram that any of them knows, with the interpolated probability in each."""
    grams, logs, contexts, weights = [], [], [], []
    lower: dict[int, list[float]] = {}
    for k in range(ORDER):
        known = sorted(set().union(*(m[0][k] for m in models)))
        probabilities: dict[int, list[float]] = {}
        for key in known:
            context = key >> 16
            below = lower.get(key & ((1 << 16 * k) - 1)) if k else None
            row = []
            for i, (shares, left) in enumerate(models):
                base = (below[i] if below else None) if k else 1 / ALPHABET
                if base is None:
                    base = 1e-9
                row.append(shares[k].get(key, 0.0) + left[k].get(context, 1.0) * base)
            probabilities[key] = row
        heads = sorted(set().union(*(m[1][k] for m in models)))
        packed = _hash(np.array(known, np.uint64), k)
        order = np.argsort(packed)
        grams.append(packed[order])
        logs.append(np.log(np.array([probabilities[x] for x in known]).reshape(-1, len(models)))[order])
        packed = _hash(np.array(heads, np.uint64), k)
        order = np.argsort(packed)
        contexts.append(packed[order])
        weights.append(np.log(np.array([[m[1][k].get(h, 1.0) for m in models] for h in heads]).reshape(-1, len(models)))[order])
        lower = probabilities
    return Tables(grams, logs, contexts, weights, worst=np.full(len(models), np.inf))


class Scorer:
    """Sentences scored with the words' rows kept between calls."""

    def __init__(self, tables: Tables, keep: int = 200_000) -> None:
        self.tables, self.keep = tables, keep
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(LANGUAGES) + 1))

    def sums(self, texts: list[str]) -> np.ndarray:
        """Log-probabilities by language and the number of positions of every sentence."""
        known = self.known
        split = [s.split() for s in texts]
        new = list({w for ws in split for w in ws if w not in known})
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                self.rows = self.rows[:0]
                new = list({w for ws in split for w in ws})
            folded = [fold(w) for w in new]
            rows = np.zeros((len(new), len(LANGUAGES) + 1))
            some = [i for i, w in enumerate(folded) if w]
            if some:
                rows[some] = self.tables.score([folded[i] for i in some])
            known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, rows])
        flat = np.array([known[w] for ws in split for w in ws], np.int64)
        sizes = np.array([len(ws) for ws in split], np.int64)
        out = np.zeros((len(texts), len(LANGUAGES) + 1))
        some = np.flatnonzero(sizes)
        if len(some):
            out[some] = np.add.reduceat(self.rows[flat], np.concatenate(([0], np.cumsum(sizes[some])[:-1])), axis=0)
        return out

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language of each sentence, -1 if rejected, its confidence, and its language if it had to have one (-1 if no model fits)."""
        rows = self.sums(texts)
        scores, size = rows[:, :-1], np.maximum(rows[:, -1], 1)
        best = scores.argmax(axis=1)
        heat = (scores - scores.max(axis=1, keepdims=True)) / self.tables.temperature
        confidence = 1 / np.exp(heat).sum(axis=1)
        entropy = -scores.max(axis=1) / size
        foreign = (entropy > self.tables.worst[best]) | (rows[:, -1] < 3)
        bad = foreign | (confidence < 0.6) | (rows[:, -1] < 8)
        return np.where(bad, -1, best), np.where(rows[:, -1] > 0, confidence, 0.0), np.where(foreign, -1, best)


def train(labelled: list[tuple[str, str]]) -> Tables:
    """Models from the built-in samples and (language, text) rows, calibrated on every fifth confirmed sentence."""
    words = [Counter() for _ in LANGUAGES]

    def add(k: int, sentence: str) -> None:
        words[k].update(w for w in map(fold, sentence.split()) if w)

    for k, code in enumerate(LANGUAGES):
        for s in SAMPLES[code]:
            add(k, s)
    tables = join([train_one(w) for w in words])
    rows = [(LANGUAGES.index(code), s) for code, text in labelled for s in sentences(text, quotes=False)]
    confirmed: list[tuple[int, str]] = []
    if rows:
        found, sure, _ = Scorer(tables).judge([s for _, s in rows])
        confirmed = [r for r, f, p in zip(rows, found, sure) if f == r[0] and p > 0.9]
        for i, (k, s) in enumerate(confirmed):
            if i % 5:
                add(k, s)
        tables = join([train_one(w) for w in words])
    # held out are every fifth confirmed sentence, and each half of the built-in samples from models of the other
    held = [(k, Scorer(tables).sums([s for j, s in confirmed[::5] if j == k])) for k in range(len(LANGUAGES))] if confirmed else []
    for half in (0, 1):
        part = join([train_one(Counter(w for s in SAMPLES[code][half::2] for w in map(fold, s.split()) if w)) for code in LANGUAGES])
        held += [(k, Scorer(part).sums(SAMPLES[code][1 - half :: 2])) for k, code in enumerate(LANGUAGES)]
    truth = np.concatenate([np.full(len(x), k) for k, x in held])
    sums = np.concatenate([x for _, x in held])
    entropy = -sums[np.arange(len(truth)), truth] / np.maximum(sums[:, -1], 1)
    for k in range(len(LANGUAGES)):
        own = entropy[truth == k]
        tables.worst[k] = own.mean() + 6 * own.std()
    grid = (1, 1.5, 2, 3, 4, 6, 8, 12)
    loss = []
    for t in grid:
        z = sums[:, :-1] / t
        z = z - z.max(axis=1, keepdims=True)
        loss.append(float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth])))
    tables.temperature = float(grid[int(np.argmin(loss))])
    return tables


def labelled_sample(posts: DataFrame, text: str, lang: str, key: str, rows: int) -> list[tuple[str, str]]:
    """At most `rows` rows of each language by their label, the same ones in every run: lowest hash of the key."""
    named = posts.select(F.col(key).alias("key"), label(F.col(lang)).alias("code")).where(F.col("code").isin(*LANGUAGES))
    order = Window.partitionBy("code").orderBy(F.xxhash64("key"), "key")
    ids = named.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= rows).select("key", "code")
    # at most rows * languages keys
    picked = posts.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(ids), "key").where("text is not null").groupBy("key", "code").agg(F.min("text").alias("text"))
    return sorted((r["code"], r["text"]) for r in picked.collect())


def runs(found: list[int], sizes: list[int], least: int = 2) -> list[tuple[int, int, int]]:
    """(language, first, end) of the segments of sentences with the languages found (-1: rejected)."""
    anchors: list[list[int]] = []
    at = 0
    known = [(i, k) for i, k in enumerate(found) if k >= 0]
    while at < len(known):
        end = at
        while end < len(known) and known[end][1] == known[at][1]:
            end += 1
        if end - at >= least:
            if anchors and anchors[-1][0] == known[at][1]:
                anchors[-1][2] = known[end - 1][0] + 1
            else:
                anchors.append([known[at][1], known[at][0], known[end - 1][0] + 1])
        at = end
    if not anchors:
        votes: Counter = Counter()
        for k, n in zip(found, sizes):
            if k >= 0:
                votes[k] += n
        best = max(votes, key=lambda k: (votes[k], -k)) if votes else -1
        return [(best, 0, len(found))]
    out = []
    for i, (k, _, _) in enumerate(anchors):
        out.append((k, 0 if i == 0 else anchors[i][1], len(found) if i == len(anchors) - 1 else anchors[i + 1][1]))
    return out


SEGMENTS = "array<struct<lang:string,confidence:double,sentences:int,chars:int>>"


def segments(posts: DataFrame, key: str, text: str, tables: Tables, least: int = 2) -> DataFrame:
    """All columns but the text, and `segments`: language, confidence, number of sentences and characters of each, in text order."""
    shared = posts.sparkSession.sparkContext.broadcast(tables)  # bounded by the sample it was trained on
    kept = [c for c in posts.columns if c != text]
    kind = pa.list_(pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("sentences", pa.int32()), ("chars", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            split = [sentences(t, quotes=False) or ([t] if t.strip() else []) if t else [] for t in batch.column(text).to_pylist()]
            found, sure, forced = (x.tolist() for x in scorer.judge([s for ss in split for s in ss]))
            out, at = [], 0
            for ss in split:
                own, conf = found[at : at + len(ss)], sure[at : at + len(ss)]
                at += len(ss)
                sizes = [len(s) for s in ss]
                if all(k < 0 for k in own):
                    own = forced[at - len(ss) : at]
                if not ss:
                    out.append([{"lang": "und", "confidence": 0.0, "sentences": 0, "chars": 0}])
                    continue
                parts = []
                for k, a, b in [(own[0], 0, len(own))] if len(set(own)) == 1 else runs(own, sizes, least):
                    mine = [(p, n) for p, n, f in zip(conf[a:b], sizes[a:b], own[a:b]) if f == k]
                    weight = sum(sizes[a:b])
                    parts.append({"lang": LANGUAGES[k] if k >= 0 else "und", "confidence": round(sum(p * n for p, n in mine) / weight, 6) if weight and k >= 0 else 0.0, "sentences": b - a, "chars": weight})
                out.append(parts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(out, kind)], names=[*kept, "segments"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema if f.name != text) + f", segments {SEGMENTS}"
    return posts.mapInArrow(find, schema)
