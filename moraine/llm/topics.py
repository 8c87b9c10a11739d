"""Subjects of texts: one-versus-rest linear classifiers on hashed word n-grams of sentences.

Weak labels come from what a text carries beside its content: its section (category_id, if that is
a subject) and the path of its address. The classifiers are trained on the sentences of a bounded
sample of texts with a weak label, then twice again with the labels their own scores confirm: a
sentence that no subject claims (small talk, generic phrases) becomes a sentence of none, one that another
subject claims more clearly moves there. Thresholds are set for each subject on held-out sentences.

Words are hashed without case and without the particles that follow Korean nouns, alone and in pairs of
neighbours, into a table of 2**BITS rows with a weight for each subject; rows that say nothing about any subject have none. A text has a subject if more than `share`
of its sentences deal with it. Scoring is one narrow pass over Arrow batches without a shuffle.

Defined results
* null, empty or wordless text: no subject.
* a label that is no subject (a catch-all, a parent, unknown) is as good as none; without any label there are no subjects.
* repeated rows give repeated results; whole texts are read whatever their length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.sentences import sentences

BITS = 17
MASK = (1 << BITS) - 1
NONE = -1
#: Particles and endings after Korean nouns, longest first.
PARTICLES = (
    "에서는", "에서도", "으로는", "으로도", "이라고", "에게서", "까지는", "부터는", "보다는", "이라는", "에서", "으로", "에게", "까지", "부터", "보다", "처럼", "라고", "라는", "이나", "과의", "와의", "에도", "에는", "들은", "들이", "들을", "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "로", "만",
)
_EDGES = re.compile(r"^\W+|\W+$")


def stem(word: str) -> str:
    """A word in the form in which it is hashed; empty for numbers and marks."""
    word = _EDGES.sub("", word).lower()
    if not word or word[0].isdigit():
        return ""
    if word.isascii():
        return word[:-1] if len(word) > 3 and word.endswith("s") and not word.endswith("ss") else word
    for p in PARTICLES:
        if word.endswith(p) and len(word) - len(p) >= 2:
            return word[: -len(p)]
    return word


class Hasher:
    """Rows of the table for the words and word pairs of sentences; words are hashed once."""

    def __init__(self, keep: int = 300_000) -> None:
        self.keep, self.known = keep, {}

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, sentence of each row)."""
        known = self.known
        if len(known) > self.keep:
            known.clear()
        flat, sizes = [], []
        for s in texts:
            n = 0
            for w in s.split():
                h = known.get(w)
                if h is None:
                    x = stem(w)
                    h = known[w] = zlib.crc32(x.encode()) if x else 0
                if h:
                    flat.append(h)
                    n += 1
            sizes.append(n)
        words = np.array(flat, np.uint64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        if not len(words):
            return words.astype(np.int64), owner
        pairs = words[:-1] * np.uint64(0x9E3779B1) + words[1:] * np.uint64(0x85EBCA77)
        same = owner[:-1] == owner[1:]
        rows = np.concatenate([words, (pairs >> np.uint64(13))[same]]) & np.uint64(MASK)
        owners = np.concatenate([owner, owner[:-1][same]])
        order = np.argsort(owners, kind="stable")
        return rows[order].astype(np.int64), owners[order]


@dataclass
class Model:
    subjects: list[int]
    weights: np.ndarray  # row of the table, subject
    bias: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: np.ndarray, owners: np.ndarray, count: int) -> np.ndarray:
        out = np.zeros((count, len(self.subjects)), np.float32)
        if len(rows):
            first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
            out[owners[first]] = np.add.reduceat(self.weights[rows], first, axis=0)
        return out + self.bias


def telling(rows: np.ndarray, owners: np.ndarray, labels: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Of each row of the table whether it says something about a subject: seen in four texts, half of them of one subject, clearly more often than by chance.

    Counts are of texts, so that what one text repeats counts once.
    """
    count, classes = int(texts.max()) + 1, labels.shape[1]
    in_text = np.unique(rows * count + texts[owners])
    row = in_text // count
    seen = np.bincount(row, minlength=MASK + 1)
    good = np.zeros(MASK + 1, bool)
    share = labels.mean(axis=0)
    for j in range(classes):
        on = labels[owners, j] > 0
        own = np.bincount(np.unique(rows[on] * count + texts[owners[on]]) // count, minlength=MASK + 1)
        chance = seen * share[j]
        good |= (own >= 0.5 * seen) & (own - chance > 4 * np.sqrt(chance))
    return good & (seen >= 4)


def _fit(rows: np.ndarray, owners: np.ndarray, labels: np.ndarray, texts: np.ndarray, fitted: np.ndarray, rounds: int, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for every column of labels at once over the fitted sentences, by full gradient steps of adaptive size."""
    count, classes = labels.shape
    table = np.zeros((MASK + 1, classes), np.float32)
    keep = telling(rows, owners, labels, texts)[rows] & fitted[owners]
    rows, owners = rows[keep], owners[keep]
    b = np.full(classes, -4.0, np.float32)
    if not len(rows):
        return table, b
    used, at = np.unique(rows, return_inverse=True)
    by_feature = np.argsort(at, kind="stable")
    feature_first = np.flatnonzero(np.concatenate(([True], np.diff(at[by_feature]) > 0)))
    first = np.flatnonzero(np.concatenate(([True], owners[1:] != owners[:-1])))
    w = np.zeros((len(used), classes), np.float32)
    seen_w, seen_b = np.full_like(w, 1e-9), np.full_like(b, 1e-9)
    sources = owners[by_feature]
    for _ in range(rounds):
        z = np.zeros((count, classes), np.float32)
        z[owners[first]] = np.add.reduceat(w[at], first, axis=0)
        error = (1 / (1 + np.exp(-(z + b))) - labels) * fitted[:, None]
        grad = np.add.reduceat(error[sources], feature_first, axis=0) / count + l2 * w
        grad_b = error.mean(axis=0)
        seen_w += grad**2
        seen_b += grad_b**2
        w -= 0.5 * grad / np.sqrt(seen_w)
        b -= 0.5 * grad_b / np.sqrt(seen_b)
    table[used] = w
    return table, b


def train(labelled: list[tuple[int | None, str]], rounds: int = 40, passes: int = 2) -> Model:
    """A model from (subject, text) rows whose labels may be wrong; rows of no subject show what is said everywhere."""
    subjects = sorted({s for s, _ in labelled if s is not None})
    texts, weak, source = [], [], []
    for i, (s, text) in enumerate(labelled):
        for x in sentences(text):
            texts.append(x)
            weak.append(-1 if s is None else subjects.index(s))
            source.append(i)
    if not texts or not subjects:
        return Model([], np.zeros((MASK + 1, 0), np.float32), np.zeros(0, np.float32), np.zeros(0))
    rows, owners = Hasher().features(texts)
    labels = np.zeros((len(texts), len(subjects)), np.float32)
    known = np.flatnonzero(np.array(weak) >= 0)
    labels[known, np.array(weak)[known]] = 1
    held = np.arange(len(texts)) % 5 == 0
    model = None
    for k in range(passes + 1):
        use = ~held[owners]
        # at first a sentence without a label is neither for nor against any subject
        fitted = np.array(weak) >= 0 if k == 0 else np.ones(len(texts), bool)
        weights, bias = _fit(rows[use], owners[use], labels, np.array(source), fitted & ~held, rounds)
        model = Model(subjects, weights, bias, np.full(len(subjects), 0.5))
        if k < passes:
            p = 1 / (1 + np.exp(-model.scores(rows, owners, len(texts))))
            labels = (p >= np.maximum(0.35, 0.8 * p.max(axis=1, keepdims=True))).astype(np.float32)
    p = 1 / (1 + np.exp(-model.scores(rows, owners, len(texts))))
    for j in range(len(subjects)):
        truth, own = labels[held, j] > 0, p[held, j]
        if truth.any():
            grid = np.linspace(0.2, 0.8, 25)
            f1 = [2 * (truth & (own >= t)).sum() / max(truth.sum() + (own >= t).sum(), 1) for t in grid]
            best = np.flatnonzero(np.isclose(f1, max(f1)))
            model.thresholds[j] = grid[best[len(best) // 2]]
    return model


def address_subject(text: Column, names: dict[str, int]) -> Column:
    """The subject whose name is a part of the path of the first address in a text, null if there is none."""
    part = F.regexp_extract(text, r"https?://[^/\s]+/(?:[^\s/]+/)*?(" + "|".join(re.escape(n.replace(" ", "-")) for n in sorted(names)) + r")(?:[/?#\s]|$)", 1) if names else F.lit("")
    out = F.lit(None).cast("bigint")
    for n, i in names.items():
        out = F.when(part == n.replace(" ", "-"), i).otherwise(out)
    return out


def labelled_sample(posts: DataFrame, subjects: dict[int, str], rows: int) -> list[tuple[int | None, str]]:
    """At most `rows` texts of each subject by their weak label, and four times as many without one, the same in every run: lowest hash of the id."""
    weak = F.coalesce(F.when(F.col("category_id").isin(*subjects), F.col("category_id")), address_subject(F.col("content"), {n: i for i, n in subjects.items()}))
    named = posts.select("id", F.coalesce(weak, F.lit(NONE)).alias("subject")).distinct()
    order = Window.partitionBy("subject").orderBy(F.xxhash64("id"), "id")
    ids = named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.when(F.col("subject") == NONE, 4 * rows).otherwise(rows)).drop("place")
    # at most rows * (subjects + 4) ids
    picked = posts.select("id", "content").join(F.broadcast(ids), "id").where("content is not null").groupBy("id", "subject").agg(F.min("content").alias("content"))
    found = sorted((r["subject"], r["content"]) for r in picked.collect())
    return [(None if s == NONE else s, t) for s, t in found]


SHARES = "array<struct<category_id:bigint,share:double>>"


def subjects_of(posts: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """All columns but the text, the number of sentences, and `subjects`: the share of sentences that deal with each."""
    shared = posts.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kept = [c for c in posts.columns if c != text]
    kind = pa.list_(pa.struct([("category_id", pa.int64()), ("share", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, hasher = shared.value, Hasher()
        for batch in batches:
            split = [sentences(t) if t else [] for t in batch.column(text).to_pylist()]
            sizes = np.array([len(s) for s in split], np.int64)
            flat = [x for s in split for x in s]
            out: list[list[dict]] = [[] for _ in split]
            if flat and own.subjects:
                p = 1 / (1 + np.exp(-own.scores(*hasher.features(flat), len(flat))))
                counts = np.zeros((len(split), len(own.subjects)), np.int64)
                post, subject = np.nonzero(p >= own.thresholds)
                np.add.at(counts, (np.repeat(np.arange(len(split)), sizes)[post], subject), 1)
                for i, j in zip(*np.nonzero(counts)):
                    out[i].append({"category_id": own.subjects[j], "share": float(counts[i, j] / sizes[i])})
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(sizes.astype(np.int32)), pa.array(out, kind)], names=[*kept, "sentences", "subjects"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in posts.schema if f.name != text) + f", sentences int, subjects {SHARES}"
    return posts.mapInArrow(find, schema)
