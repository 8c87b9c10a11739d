"""Texts packed into containers of a fixed number of tokens: minimum bin slack on the lengths.

Only the histogram of lengths decides the packing, and it has at most `capacity` rows whatever the
corpus: the plan is made from it on the driver and costs the same for any number of texts.

The plan takes the longest remaining length as the seed of a window and finds the multiset of
remaining lengths that fills the rest of the window closest to the capacity, by subset-sum
dynamic programming over a bitset (bit s: the sum s can be reached), counts in binary chunks,
backtracked to the counts. The window is repeated as often as the remaining counts allow.

Texts then get their container from their rank among the texts of their length. Ranks come from
a count of each (length, salt) plus a row number within it; a length has as many salts as its number
of texts asks for, so one that a third of the texts share, as full pieces of long texts do, is split
into parts of a fixed size. A text of more than `capacity` tokens fills whole containers of its
own; only its remainder is packed with others.

Defined results
* null and empty texts: left out; a blank text has tokens and is packed.
* repeated rows: every row is packed, so an id that stands twice comes out twice.
* an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moraine.llm.tokens import token_counter
from moraine.storage import materialize

#: Texts of one length that are ranked in one part, on average.
PART = 50_000


@dataclass
class Slot:
    """Items of one length whose ranks begin at `first` go to containers from `container` on, `each` to one."""

    n_tokens: int
    first: int
    container: int
    each: int


def best_fill(counts: dict[int, int], space: int) -> dict[int, int]:
    """The multiset of lengths within counts whose sum is closest to space from below."""
    full = (1 << (space + 1)) - 1
    reach, layers = 1, []
    for length in sorted((n for n, c in counts.items() if c and n <= space), reverse=True):
        left, chunk = min(counts[length], space // length), 1
        while left:
            take = min(chunk, left)
            before, reach = reach, reach | (reach << (length * take)) & full
            layers.append((length, take, before))
            left, chunk = left - take, chunk * 2
        if reach >> space:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots of all lengths and the number of containers."""
    counts = {n: c for n, c in counts.items() if c > 0}
    ranks = dict.fromkeys(counts, 0)
    slots, containers = [], 0
    lengths = sorted(counts)
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        pattern = best_fill(counts, capacity - seed)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in pattern.items())
        for n, k in pattern.items():
            slots.append(Slot(n, ranks[n], containers, k))
            ranks[n] += k * times
            counts[n] -= k * times
            if not counts[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        containers += times
    return slots, containers


def _map(batches: Iterator[pa.RecordBatch], drop: set[str], added: dict[str, Callable[[pa.RecordBatch], pa.Array]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [c for c in batch.schema.names if c not in drop]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [f(batch) for f in added.values()], names=[*keep, *added])


def with_token_counts(docs: DataFrame, id_col: str, text: str, tokenizer: str) -> DataFrame:
    """Id and number of tokens of every text that isn't empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer)
        return _map(batches, {text}, {"n_tokens": lambda b: pa.array([counter(t) for t in b.column(text).to_pylist()], pa.int64())})

    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens BIGINT"
    return docs.select(id_col, text).where(F.col(text) != "").mapInArrow(count, schema)


def pack(docs: DataFrame, id_col: str, text: str, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """id, piece_no, token_start, n_tokens, container_id: every text once, or in pieces if it exceeds the capacity."""
    sized = with_token_counts(docs, id_col, text, tokenizer)
    pieces = F.transform(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")), lambda i: F.struct(i.alias("piece_no"), (i * capacity).cast("bigint").alias("token_start")))
    items = (
        sized.where("n_tokens > 0")
        .select(id_col, "n_tokens", F.explode(pieces).alias("piece"))
        .select(id_col, "piece.piece_no", "piece.token_start", F.least(F.col("n_tokens") - F.col("piece.token_start"), F.lit(capacity)).alias("n_tokens"))
    )
    items = materialize(items, "lengths")
    counts = {r["n_tokens"]: r["n"] for r in items.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    salts = F.broadcast(items.sparkSession.createDataFrame([(k, n // PART + 1) for k, n in counts.items()], "n_tokens BIGINT, salts BIGINT"))
    items = items.join(salts, "n_tokens").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece_no"), F.col("salts"))).drop("salts")
    cells = items.groupBy("n_tokens", "salt").agg(F.count("*").alias("cell"))
    slots, _ = plan(counts, capacity)
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("cell").over(before), F.lit(0))).drop("cell")
    within = Window.partitionBy("n_tokens", "salt").orderBy(id_col, "piece_no")
    ranked = items.withColumn("place", F.row_number().over(within)).join(offsets.hint("merge"), ["n_tokens", "salt"]).withColumn("rank", F.col("offset") + F.col("place") - 1).drop("salt", "place", "offset")
    return _assign(ranked, slots).select(id_col, "piece_no", "token_start", "n_tokens", "container_id")


def _assign(ranked: DataFrame, slots: list[Slot]) -> DataFrame:
    if not slots:
        return ranked.drop("rank").withColumn("container_id", F.lit(None).cast("bigint"))
    slots = sorted(slots, key=lambda s: (s.n_tokens, s.first))
    table = np.array([(s.n_tokens, s.first, s.container, s.each) for s in slots], np.int64).reshape(-1, 4)
    starts = (table[:, 0].astype(np.uint64) << np.uint64(44)) | table[:, 1].astype(np.uint64)

    def container(batch: pa.RecordBatch) -> pa.Array:
        n, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_tokens", "rank"))
        at = np.searchsorted(starts, (n.astype(np.uint64) << np.uint64(44)) | rank.astype(np.uint64), side="right") - 1
        return pa.array(table[at, 2] + (rank - table[at, 1]) // table[at, 3])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _map(batches, {"rank"}, {"container_id": container})

    out = ranked.drop("rank").schema
    return ranked.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", container_id BIGINT")
