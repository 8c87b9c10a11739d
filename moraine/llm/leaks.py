"""Passages of held-out items inside documents: marks and pigeonhole pieces, then bit-parallel edit distance.

Texts are compared without case, width, markup, punctuation and blanks. Windows of 64 characters of
an item are held against the document by Myers' distance on 64-bit words, for all windows of a batch
at once. The item is found if the windows within the edit limit cover `share` of its text; a window
in which the marks that tell items apart (numbers and words that few items use) differ is the same
turn of phrase and doesn't count. An item shorter than a window is one window of its own length, with a
budget in proportion; what is missing to 64 bits matches anything and costs nothing.

What is measured is chosen without loss. A window counts only with `marks` of its marks near the place
where it ends, so an automaton over the marks of all items tells in one pass over a document which
windows can count, and where; an item whose windows can't cover its share that way is left out. A window
is cut into one piece more than the edits it is granted, so one piece stands unchanged wherever it is
within the budget (pigeonhole): a place with none of them isn't measured. Of the pairs that are left all
windows are measured over the whole document. Windows without marks are only measured there, and so are
items without marks, against every document.

The items are the stated query set: they go to the tasks in blocks of `block` items, each block one
pass over the documents, so no task holds more than one block however many items there are. Bit masks
are made for the windows that are measured at a time only.
Nothing is shuffled but the pairs found.

Defined results
* null or empty text of a document: no row; null or empty text of an item: never found.
* an item of fewer than rules.least letters is no passage but a turn of phrase: never found.
* items with the same passage: each is found for itself.
* a repeated document id: its pairs come out once; empty tables give an empty result.
* whole texts are searched whatever their length; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache, reduce
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 64
#: The code of a place that any character may take.
ANY = np.iinfo(np.uint16).max
TAGS = re.compile(r"<[^<>]{0,80}>")
NOISE = re.compile(r"[\W_]+")
WORDS = re.compile(r"\d+|[^\W\d_]+")


def plain(text: str) -> str:
    """A text in the form in which it is compared, words still apart."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if "<" in text:
        text = TAGS.sub(" ", text)
    return text.replace("[[", "").replace("]]", "").replace("''", "").lower()


def squeeze(text: str) -> str:
    return NOISE.sub("", text)


@dataclass
class Rules:
    share: float = 0.4
    stride: int = 16
    edits: int = 14
    least: int = 16  # letters of an item that is a passage
    marks: float = 0.6  # of the marks in a window, what must agree; a shared name alone is too little


@dataclass
class Items:
    """One block of items with what the search needs."""

    ids: list[int]
    texts: list[str]
    rules: Rules
    windows: list[list[int]] = field(default_factory=list)
    starts: np.ndarray = None  # of every window: its place in its item
    owner: np.ndarray = None
    sizes: np.ndarray = None
    limits: np.ndarray = None  # of every window: the edits it is granted
    codes: np.ndarray = None  # of every window: its characters, at the end of 64 places
    alphabet: dict[int, int] = field(default_factory=dict)
    marks: list[list[tuple[int, int, str]]] = field(default_factory=list)
    names: dict[str, int] = field(default_factory=dict)  # of all marks
    pairs: list[np.ndarray] = field(default_factory=list)  # of every mark: its places in the three arrays that follow
    pair_window: np.ndarray = None  # ascending
    pair_mark: np.ndarray = None
    pair_times: np.ndarray = None
    own_marks: np.ndarray = None  # of every window
    unmarked: np.ndarray = None  # of every item: characters under windows without marks
    needed: np.ndarray = None  # of every item: different marks that must agree

    @classmethod
    def build(cls, ids: list[int], raw: list[str], rules: Rules, rare: set[str]) -> Items:
        forms = [plain(t) for t in raw]
        own = cls(ids, [squeeze(t) for t in forms], rules)
        starts, owner, windows = [], [], []
        for k, (form, text) in enumerate(zip(forms, own.texts)):
            mine = []
            for at in sorted({*range(0, len(text) - WINDOW + 1, rules.stride), max(len(text) - WINDOW, 0)}) if len(text) >= rules.least else ():
                mine.append(len(windows))
                windows.append(text[at : at + WINDOW])
                starts.append(at)
                owner.append(k)
            own.windows.append(mine)
            at, marks = 0, []
            for m in WORDS.finditer(form):
                w = squeeze(m.group())
                if w in rare:
                    marks.append((at, at + len(w), w))
                at += len(w)
            own.marks.append(marks)
        own.alphabet = {ord(c): i for i, c in enumerate(sorted(set("".join(windows))))}
        own.starts, own.owner = np.array(starts, np.int64), np.array(owner, np.int64)
        own.sizes = np.array([len(w) for w in windows], np.int64)
        own.limits = rules.edits * own.sizes // WINDOW
        own.codes = np.full((len(windows), WINDOW), ANY, np.uint16)
        for i, w in enumerate(windows):
            own.codes[i, WINDOW - len(w) :] = [own.alphabet[ord(c)] for c in w]
        own.index()
        return own

    def index(self) -> None:
        """The marks of every window, and what of an item has none."""
        own = [Counter(m for a, b, m in self.marks[k] if s <= a and b <= s + WINDOW) for s, k in zip(self.starts.tolist(), self.owner.tolist())]
        self.names = {m: i for i, m in enumerate(sorted({m for c in own for m in c}))}
        rows = [(w, self.names[m], n) for w, c in enumerate(own) for m, n in c.items()]
        self.pair_window, self.pair_mark, self.pair_times = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        by_mark = np.argsort(self.pair_mark, kind="stable")
        self.pairs = np.split(by_mark, np.searchsorted(self.pair_mark[by_mark], np.arange(1, len(self.names)))) if rows else []
        self.own_marks = np.array([c.total() for c in own], np.int64)
        self.unmarked = np.array([self.covered(k, [w for w in mine if not own[w]]) for k, mine in enumerate(self.windows)], np.int64)
        self.needed = np.array([min(2, len({m for *_, m in x})) for x in self.marks], np.int64)

    def masks(self, windows: np.ndarray) -> np.ndarray:
        """Of the given windows and every character, the unknown one last: the bits where it stands."""
        out = np.zeros((len(windows), len(self.alphabet) + 1), np.uint64)
        codes, rows = self.codes[windows], np.arange(len(windows))
        for j in range(WINDOW):
            bit, free = np.uint64(1 << j), codes[:, j] == ANY
            out[free] |= bit
            out[rows[~free], codes[~free, j]] |= bit
        return out

    def pieces(self, w: int) -> list[str]:
        """A window cut into one piece more than the edits it is granted."""
        text, size, parts = self.texts[self.owner[w]][self.starts[w] :][:WINDOW], int(self.sizes[w]), int(self.limits[w]) + 1
        return [text[size * i // parts : size * (i + 1) // parts] for i in range(parts)]

    def covered(self, k: int, windows: Iterable[int]) -> int:
        mask = np.zeros(len(self.texts[k]), bool)
        for w in windows:
            mask[self.starts[w] : self.starts[w] + WINDOW] = True
        return int(mask.sum())

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for mark, i in self.names.items():
            found.add_word(mark, (i, len(mark)))
        found.make_automaton()
        return found


def distances(masks: np.ndarray, windows: np.ndarray, regions: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each window, by the number of its masks, to any stretch of its region, and where that stretch ends.

    regions holds character codes of the masks, one row for each window; stretches that end within the first `skip` don't count.
    """
    one = np.uint64(1)
    high = np.uint64(WINDOW - 1)
    plus = np.full(len(windows), np.uint64(2**64 - 1))
    minus = np.zeros(len(windows), np.uint64)
    score = np.full(len(windows), WINDOW, np.int16)
    best, end = score.copy(), np.zeros(len(windows), np.int16)
    for t in range(regions.shape[1]):
        eq = masks[windows, regions[:, t]]
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        score += (ph >> high).astype(np.int16) - (mh >> high).astype(np.int16)
        # the stretch may begin anywhere: no edit is charged for what stands before it
        ph <<= one
        mh <<= one
        plus = mh | ~(xv | ph)
        minus = ph & xv
        if t < skip:
            continue
        better = score < best
        best[better] = score[better]
        end[better] = t + 1
    return best, end


SLACK = 20
#: Ends of stretches that are measured at once; of each such group the best is kept.
GROUP = 32
ROWS = 16384


def reach(rules: Rules) -> int:
    """Characters before the first end of a group that its stretches may hold."""
    return WINDOW + rules.edits


def coded(items: Items, text: str) -> np.ndarray:
    """A text as codes of the masks, with room for the regions at both ends."""
    unknown = len(items.alphabet)
    out = np.full(len(text) + reach(items.rules) + 2 * GROUP, unknown, np.int32)
    out[reach(items.rules) :][: len(text)] = [items.alphabet.get(c, unknown) for c in map(ord, text)]
    return out


def groups_with_piece(items: Items, text: str, w: int) -> set[int]:
    """Groups of ends in which a stretch within the edit limit can end: with a piece of the window unchanged."""
    found, at, edits, size = set(), 0, int(items.limits[w]), int(items.sizes[w])
    for piece in items.pieces(w):
        where = text.find(piece)
        while where >= 0:
            end = where + size - at  # of the stretch, give or take the edits
            found.update(range(max(end - edits, 1) // GROUP, max(min(end + edits, len(text)), 1) // GROUP + 1))
            where = text.find(piece, where + 1)
        at += len(piece)
    return found


def measured(items: Items, jobs: Iterable[tuple[int, int, int]], codes: dict[int, np.ndarray]) -> Iterator[tuple[int, int, int]]:
    """Of the jobs (text, group of ends, window) those within the edit limit, as (text, window, end)."""
    jobs, skip = iter(jobs), reach(items.rules) - 1
    flat, starts = np.concatenate(list(codes.values())), dict(zip(codes, np.cumsum([0, *map(len, codes.values())]).tolist()))
    while some := list(islice(jobs, ROWS)):
        begins = np.array([starts[i] + g * GROUP for i, g, _ in some], np.int64)
        regions = flat[np.arange(skip + GROUP)[:, None] + begins].T
        windows, at = np.unique([w for *_, w in some], return_inverse=True)
        best, ends = distances(items.masks(windows), at, regions, skip)
        for n in np.flatnonzero(best <= items.limits[windows[at]]).tolist():
            i, g, w = some[n]
            yield i, w, g * GROUP + int(ends[n]) - skip - 1


def candidates(items: Items, hits: np.ndarray, sizes: np.ndarray) -> tuple[set[tuple[int, int]], list[tuple[int, int, int]]]:
    """From the hits (text, mark, begin, end) the pairs (text, item) that marks allow, and where (text, group of ends, window) a window of them can count."""
    rules, number = items.rules, len(items.texts)
    share = rules.share * np.array([len(t) for t in items.texts])
    always = np.flatnonzero((items.needed == 0) & (items.unmarked >= share) & (items.unmarked > 0))
    free = {(i, int(k)) for i in np.flatnonzero(sizes) for k in always}
    if not len(hits):
        return free, []
    text, mark, begin, end = hits.T
    # a mark counts for the windows whose stretch ends from SLACK // 2 before the mark's end to WINDOW + SLACK behind its begin
    first = np.maximum(end - SLACK // 2, 1) // GROUP
    last = np.minimum(begin + WINDOW + SLACK, sizes[text]) // GROUP
    times = np.array([len(p) for p in items.pairs])[mark]
    pair = np.concatenate([items.pairs[m] for m in mark.tolist()])
    text, first, last = (np.repeat(x, times) for x in (text, first, last))
    marks = np.unique((text * number + items.owner[items.pair_window[pair]]) * len(items.names) + items.pair_mark[pair]) // len(items.names)
    owners, different = np.unique(marks, return_counts=True)
    owners = owners[different >= items.needed[owners % number]]
    keep = np.isin(text * number + items.owner[items.pair_window[pair]], owners)
    text, first, last, pair = text[keep], first[keep], last[keep], pair[keep]
    times = last - first + 1
    group = np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    groups, total = int(sizes.max()) // GROUP + 1, len(items.pair_window)
    keys = np.unique((np.repeat(text, times) * groups + group) * total + np.repeat(pair, times))
    places, pair = keys // total, keys % total
    window = items.pair_window[pair]
    heads = np.flatnonzero(np.diff(places, prepend=-1) | np.diff(window, prepend=-1))
    if len(heads):
        counts = np.add.reduceat(items.pair_times[pair], heads)
        places, window = places[heads], window[heads]
        right = counts >= rules.marks * items.own_marks[window]
        places, window = places[right], window[right]
    text, group = places // groups, places % groups
    allowed = enough(items, text, window, share, items.unmarked) | set(divmod(int(x), number) for x in owners if items.unmarked[x % number] >= share[x % number])
    return allowed | free, [(i, g, w) for i, g, w in zip(text.tolist(), group.tolist(), window.tolist()) if (i, int(items.owner[w])) in allowed]


def enough(items: Items, text: np.ndarray, window: np.ndarray, share: np.ndarray, unmarked: np.ndarray | int = 0) -> set[tuple[int, int]]:
    """The pairs (text, item) whose given windows, with the characters under windows without marks, can cover the share."""
    both = np.unique(text * len(items.starts) + window)
    text, window = both // max(len(items.starts), 1), both % max(len(items.starts), 1)
    pair, starts = text * len(items.texts) + items.owner[window], items.starts[window]
    same = np.append(pair[1:] == pair[:-1], False)[: len(pair)]
    width = np.where(same, np.minimum(np.append(starts[1:], 0)[: len(pair)] - starts, WINDOW), WINDOW)
    found, at = np.unique(pair, return_inverse=True)
    owner = found % len(items.texts)
    good = np.bincount(at, width, len(found)) + (unmarked[owner] if isinstance(unmarked, np.ndarray) else unmarked) >= share[owner]
    return {divmod(x, len(items.texts)) for x in found[good].tolist()}


def holds(text: str, mark: str) -> bool:
    """Whether a mark stands in a text; a number not as a part of another."""
    at = text.find(mark)
    while at >= 0:
        if not (mark.isdigit() and (text[at - 1 : at].isdigit() or text[at + len(mark) : at + len(mark) + 1].isdigit())):
            return True
        at = text.find(mark, at + 1)
    return False


def search(items: Items, automaton: ahocorasick.Automaton, texts: list[str | None]) -> Iterator[tuple[int, int, float]]:
    """(index of the text, index of the item, share covered) for all pairs found."""
    rules = items.rules
    squeezed = [squeeze(plain(raw)) if raw else "" for raw in texts]
    hits = [(i, m, end + 1 - n, end + 1) for i, text in enumerate(squeezed) if text and items.names for end, (m, n) in automaton.iter(text)]
    allowed, places = candidates(items, np.array(hits, np.int64), np.array([len(t) for t in squeezed], np.int64))
    if not allowed:
        return
    codes = {i: coded(items, squeezed[i]) for i in {i for i, _ in allowed}}

    pieces = cache(lambda i, w: groups_with_piece(items, squeezed[i], w))

    def whole(pairs: set[tuple[int, int]], unmarked: bool = False) -> Iterator[tuple[int, int, int]]:
        return ((i, g, w) for i, k in sorted(pairs) for w in items.windows[k] if not (unmarked and items.own_marks[w]) for g in sorted(pieces(i, w)))

    share = rules.share * np.array([len(t) for t in items.texts])
    good = [(i, w) for i, w, _ in measured(items, (x for x in places if x[1] in pieces(x[0], x[2])), codes)]
    both = np.array(good, np.int64).reshape(-1, 2)
    pairs = enough(items, both[:, 0], both[:, 1], share, items.unmarked) | {(i, k) for i, k in allowed if items.unmarked[k] >= share[k]}
    good += [(i, w) for i, w, _ in measured(items, whole(pairs, unmarked=True), codes)]
    both = np.array(good, np.int64).reshape(-1, 2)
    covered: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for i, w, e in measured(items, whole(enough(items, both[:, 0], both[:, 1], share)), codes):
        covered[i, int(items.owner[w])].append((int(items.starts[w]), e, w))
    for (i, k), spans in covered.items():
        size = len(items.texts[k])
        mask = np.zeros(size, bool)
        text = squeezed[i]
        right, total, agreed = set(), 0, 0
        for s, e, _ in spans:
            near = text[max(0, e - WINDOW - SLACK) : e + SLACK // 2]
            own = [mark for a, b, mark in items.marks[k] if s <= a and b <= s + WINDOW]
            same = [mark for mark in own if holds(near, mark)]
            total, agreed, right = total + len(own), agreed + len(same), right | set(same)
            if len(same) >= rules.marks * len(own):
                mask[s : s + WINDOW] = True
        share = mask.sum() / size
        if share >= rules.share and agreed >= rules.marks * total and len(right) >= min(2, len({m for *_, m in items.marks[k]})):
            yield i, k, float(share)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules | None = None, block: int = 4096) -> DataFrame:
    """doc_id, item_id and share: every pair in which the document holds at least rules.share of the item."""
    rules = rules or Rules()
    rows = sorted((r[0], r[1]) for r in items.select(item_id, item_text).where(f"{item_text} is not null").distinct().toLocalIterator())
    frequency = Counter(w for _, t in rows for w in set(map(squeeze, WORDS.findall(plain(t)))))
    rare = {w for w, n in frequency.items() if n <= max(2, 0.03 * len(rows)) and (w.isdigit() or len(w) > 2)}
    kind = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {items.schema[item_id].dataType.simpleString()}, share DOUBLE"
    docs = docs.select(doc_id, text)

    def passed(part: list[tuple[int, str]]) -> DataFrame:
        ids, raw = [r[0] for r in part], [r[1] for r in part]
        own_rare = rare & {w for t in raw for w in map(squeeze, WORDS.findall(plain(t)))}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Items.build(ids, raw, rules, own_rare)
            if not len(own.starts):
                return  # no item is a passage
            automaton = own.automaton()
            for batch in batches:
                keys, texts = batch.column(doc_id).to_pylist(), batch.column(text).to_pylist()
                out = []
                for at in range(0, len(texts), 1000):
                    out += [(keys[at + i], ids[k], s) for i, k, s in search(own, automaton, texts[at : at + 1000])]
                columns = list(zip(*out)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(doc_id).type), pa.array(columns[1]) if out else pa.array([], pa.int64()), pa.array(columns[2], pa.float64())], names=[doc_id, item_id, "share"])

        return docs.mapInArrow(scan, kind)

    parts = [rows[i : i + block] for i in range(0, len(rows), block)] or [[]]
    return reduce(DataFrame.unionByName, map(passed, parts)).groupBy(doc_id, item_id).agg({"share": "max"}).withColumnRenamed("max(share)", "share")
