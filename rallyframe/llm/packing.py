"""Best-fit packing of documents into token sequences by a linear grouping scheme.

1. Documents become pieces of at most `capacity` tokens.
2. Large lengths are cut into groups of about equal numbers of pieces; each group counts as its longest.
3. For these few sizes, configurations (what a sequence may hold) and how often to use each are optimised:
   the linear programme of cutting stock, by column generation with a knapsack as pricing step; rounded
   down, what is left goes first-fit.
4. Actual pieces take the configurations' slots, by their rank within the length.
5. Small pieces go best-fit, longest first, into what room is left, and into new sequences at last.

Lengths are integers from 1 to `capacity`, so everything the driver sees is a histogram of at most
`capacity` + 1 counts, whatever the input's size. The plan names ranks within a length and ranges of
them; pieces find their ranks in Spark (see `ranked`), and no task sees all pieces of a length.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, shuffle_partitions, written

CAPACITY = 1024
END_ID = 2
#: Lengths up to capacity / SMALL are small; the larger ones are put in GROUPS groups.
SMALL = 8
GROUPS = 96
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_encoders: dict[str, object] = {}
#: The regex engine of the fast encoder keeps a stack as deep as a run of white space; texts with longer runs go to the other.
LONGEST_SPACE = 20_000
#: Looked for from the beginning of a run only, so the time is proportional to the text.
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONGEST_SPACE},}}")


def vocabulary() -> str:
    """The public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of `tokenizers` with its defaults, added tokens in a text included. Where the same vocabulary lies beside it as
    ranks, those give the same ids four times as fast; `tokenizers` itself then encodes only what that library can't: very
    long runs of white space."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.plain, self.fast = Tokenizer.from_file(path), None
        beside = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(beside):
            return
        with open(beside, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        added = {t.content: i for i, t in self.plain.get_added_tokens_decoder().items()}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or len(text) >= LONGEST_SPACE and _LONG_SPACE.search(text):
            return self.plain.encode(text, add_special_tokens=False).ids
        return self.fast.encode(text, allowed_special="all")


def encoder(path: str) -> Encoder:
    """Once for each worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first, which may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Rows of PIECES (and `ids`, little-endian unsigned 32-bit, if asked for). Null text: the end id alone."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), END_ID], "<u4")
                    for k, (start, n) in enumerate(cut(len(ids), capacity)):
                        raw = ids[start : start + n].tobytes()
                        rows.append((doc_id, k, start, n, zlib.crc32(raw), *([raw] if with_ids else [])))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids)


# --- the plan, from histograms ---------------------------------------------------------------


@dataclass
class Plan:
    """Which slot a rank has. Large: length -> group and first rank in it; group -> ranges of slots."""

    group: np.ndarray  # by length; -1: small
    first: np.ndarray  # by length: rank in its group of the first piece of that length
    slots: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # by group: range starts, first sequence, slots in each sequence
    sequences: int = 0


def groups_of(counts: np.ndarray, smallest: int, n_groups: int) -> list[list[int]]:
    """Large lengths, longest first, in groups of about equal numbers of pieces."""
    lengths = [n for n in range(len(counts) - 1, smallest - 1, -1) if counts[n]]
    total, seen, out = sum(int(counts[n]) for n in lengths), 0, defaultdict(list)
    for n in lengths:
        out[min(n_groups - 1, int(n_groups * (seen + counts[n] / 2) / total))].append(n)
        seen += int(counts[n])
    return [out[k] for k in sorted(out)]


def best_column(sizes: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The unbounded knapsack: most value in one sequence."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        gain = np.where(sizes <= c, best[c - np.minimum(sizes, c)] + value, -1.0)
        k = int(gain.argmax())
        best[c] = best[c - 1]
        if gain[k] > best[c] + 1e-12:
            best[c], took[c] = gain[k], k
    column, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            column[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, steps: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often to use each; together they have slots enough for `demand`."""
    n = len(sizes)
    columns = np.diag(capacity // sizes).astype(float)
    used = np.linalg.solve(columns, demand.astype(float))
    for _ in range(steps):
        worth = np.linalg.solve(columns.T, np.ones(n))
        value, column = best_column(sizes, np.maximum(worth, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(columns, column.astype(float))
        limit = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1), np.inf)
        out = int(limit.argmin())
        used = np.maximum(used - limit[out] * step, 0)
        columns[:, out], used[out] = column, limit[out]
    plan = [(columns[:, k].round().astype(np.int64), int(used[k] + 1e-9)) for k in range(n) if int(used[k] + 1e-9) > 0]
    left = np.maximum(demand - sum((c * k for c, k in plan), np.zeros(n, np.int64)), 0)
    rooms: list[list] = []
    for g in np.argsort(-sizes, kind="stable"):
        for _ in range(int(left[g])):
            room = next((r for r in rooms if r[0] >= sizes[g]), None)
            if room is None:
                rooms.append(room := [capacity, np.zeros(n, np.int64)])
            room[0] -= sizes[g]
            room[1][g] += 1
    return plan + [(r[1], 1) for r in rooms]


def plan_large(counts: np.ndarray, capacity: int, small: int = SMALL, n_groups: int = GROUPS) -> Plan:
    """`counts[n]`: pieces of length n."""
    plan = Plan(np.full(capacity + 1, -1), np.zeros(capacity + 1, np.int64))
    groups = groups_of(counts, capacity // small + 1, n_groups)
    for g, lengths in enumerate(groups):
        rank = 0
        for n in lengths:
            plan.group[n], plan.first[n] = g, rank
            rank += int(counts[n])
    if not groups:
        return plan
    demand = np.array([sum(int(counts[n]) for n in lengths) for lengths in groups])
    chosen = configurations(np.array([lengths[0] for lengths in groups]), demand, capacity)
    base = np.cumsum([0, *(k for _, k in chosen)])
    for g in range(len(groups)):
        rows = [(column[g] * k, base[i], column[g]) for i, (column, k) in enumerate(chosen) if column[g]]
        room, sequence, each = (np.array(x, np.int64) for x in zip(*rows, strict=True))
        plan.slots.append((np.cumsum(room) - room, sequence, each))
    plan.sequences = int(base[-1])
    return plan


def place_large(plan: Plan, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sequence numbers, from each piece's length and rank (from 0) among its length's pieces."""
    out = np.full(len(length), -1, np.int64)
    group, place = plan.group[length], plan.first[length] + rank
    for g in np.unique(group):
        at = group == g
        start, sequence, each = plan.slots[g]
        k = np.searchsorted(start, place[at], "right") - 1
        out[at] = sequence[k] + (place[at] - start[k]) // each[k]
    return out


def plan_small(counts: np.ndarray, rooms: np.ndarray, capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """Best fit, longest first, many at a time. `counts[n]`: small pieces of length n; `rooms[r]`: sequences with
    room r. Returns for each length ranges (first rank, room at first, first rank among sequences of that
    room); room -1 stands for new sequences."""
    open_: dict[int, list[list[int]]] = {r: [[r, 0, int(k)]] for r, k in enumerate(rooms) if k and r}
    fresh, out = 0, {}
    for n in range(len(counts) - 1, 0, -1):
        left, rank, ranges = int(counts[n]), 0, []
        while left:
            room = min((r for r in open_ if r >= n), default=None)
            if room is None:
                need = -(-left // (capacity // n))
                open_[capacity], room = [[-1, fresh, need]], capacity
                fresh += need
            segment = open_[room][-1]
            k = min(left, segment[2])
            ranges.append((rank, segment[0], segment[1]))
            if room > n:
                open_.setdefault(room - n, []).append([segment[0], segment[1], k])
            segment[1] += k
            segment[2] -= k
            if not segment[2]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            rank, left = rank + k, left - k
        if ranges:
            out[n] = ranges
    return out


# --- Spark ------------------------------------------------------------------------------------


def ranked(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add `name`: each row's rank, from 0, among the rows of its `key`. The rows of a key are dealt over many
    tasks by a salt from `order`; ranks are counted within (key, salt) and moved by the counts before."""
    salts = 4 * shuffle_partitions(df.sparkSession)
    df = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = Window.partitionBy(key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(key, "_salt").agg(F.count("*").alias("_n"))
    counts = counts.select(key, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_salt").orderBy(*order))
    return df.join(counts, [key, "_salt"]).withColumn(name, F.col("_before") + within - 1).drop("_salt", "_before")


def histogram(df: DataFrame, column: str, capacity: int) -> np.ndarray:
    """Counts by value, 0 to `capacity`: a bounded array."""
    out = np.zeros(capacity + 1, np.int64)
    for value, n in df.groupBy(column).count().collect():
        out[value] = n
    return out


def pack_pieces(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to rows of PIECES. `cut_docs` is read several times: give a written table."""
    order = ["doc_id", "piece", "ids_crc32"]
    counts = histogram(cut_docs, "length", capacity)
    small = capacity // SMALL
    full = int(counts[capacity])
    plan = plan_large(np.where(np.arange(capacity + 1) < capacity, counts, 0), capacity)
    by_rank = written(ranked(cut_docs, "length", order, "_rank"), "ranked-pieces")

    @F.pandas_udf("long")
    def large_sequence(length: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(place_large(plan, length.to_numpy(), rank.to_numpy()))

    whole = by_rank.where(F.col("length") == capacity).withColumn("sequence_id", F.col("_rank")).withColumn("offset", F.lit(0).cast("long"))
    large = by_rank.where((F.col("length") < capacity) & (F.col("length") > small)).withColumn("sequence_id", large_sequence("length", "_rank") + full)
    rooms = large.groupBy("sequence_id").agg((capacity - F.sum("length")).alias("_room"))
    rooms = written(ranked(rooms, "_room", ["sequence_id"], "_at"), "rooms")
    fits = plan_small(np.where(np.arange(capacity + 1) <= small, counts, 0), histogram(rooms, "_room", capacity), capacity)
    ranges = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in fits.items()}

    @F.pandas_udf("struct<room: long, at: long>")
    def small_place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        room, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for n in np.unique(lengths):
            rows = lengths == n
            start, room_of, first = ranges[int(n)]
            k = np.searchsorted(start, ranks[rows], "right") - 1
            room[rows], at[rows] = room_of[k], first[k] + ranks[rows] - start[k]
        return pd.DataFrame({"room": room, "at": at})

    tiny = by_rank.where(F.col("length") <= small).withColumn("_place", small_place("length", "_rank"))
    tiny = tiny.withColumn("_room", F.col("_place.room")).withColumn("_at", F.col("_place.at")).drop("_place")
    tiny = tiny.join(rooms.withColumnRenamed("sequence_id", "_found"), ["_room", "_at"], "left")
    tiny = tiny.withColumn("sequence_id", F.coalesce("_found", F.col("_at") + full + plan.sequences)).drop("_found", "_room", "_at")
    mixed = large.unionByName(tiny)
    upto = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    mixed = mixed.withColumn("offset", F.coalesce(F.sum("length").over(upto), F.lit(0)).cast("long"))
    return whole.unionByName(mixed).drop("_rank")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack all documents: rows of PIECES with sequence_id and offset.

    Null or empty text: one piece of one token. Null doc_id: kept as null. Repeated rows: each packed. Very
    long texts: cut in pieces as any other. Empty table: no rows. Other columns of `docs` are not looked at."""
    return pack_pieces(written(pieces(docs, capacity, path), "pieces"), capacity)


def utilisation(packed: DataFrame, capacity: int = CAPACITY) -> Column:
    """Share of the sequences' room that is filled, as an aggregate."""
    return F.sum("length") / (F.countDistinct("sequence_id") * capacity)
