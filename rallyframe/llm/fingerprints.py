"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes rolls over the text; where it falls on a value modulo the block size, a chunk
ends, and each chunk gives one character of the signature. The block size is 3 x 2^k, so that signatures have
some 32 to 64 characters whatever the text's length; a fingerprint holds the signatures for its block size and
for twice that. Two fingerprints are compared where they have a block size in common, by edit distance
(insertions and deletions), if a run of RUN characters is in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, _power, bounded_batches, constants, mix64, shuffle_partitions

LEAST_BLOCK = 3
LENGTH = 64
WINDOW = 7
#: Characters that two signatures must have in a row in common; of short ones a quarter of their length, two at least.
RUN = 7
#: The fixed alphabet of signatures.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_LAG = constants(WINDOW, 4)
#: Ends of the order: null ids come last, and so does the first document once more.
_NULL_ID = -(1 << 63)


def _signature(total: np.ndarray, inverse: np.ndarray, ends: np.ndarray, n: int) -> str:
    ends = ends + 1
    if not len(ends) or ends[-1] < n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    h = mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """`block size:signature:signature for twice the block size`; both signatures of an empty text are empty."""
    n = len(text)
    if not n:
        return f"{LEAST_BLOCK}::"
    value = _BYTE[np.frombuffer(text, np.uint8)]
    rolling = np.zeros(n, np.uint64)
    for lag in range(min(WINDOW, n)):
        rolling[lag:] += value[: n - lag] * _LAG[lag]
    rolling = (mix64(rolling) >> np.uint64(32)).astype(np.int64)
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value * power[:n], out=total[1:])
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2
    while True:
        ends = np.flatnonzero(rolling % block == block - 1)
        if len(ends) + 1 >= LENGTH // 2 or block == LEAST_BLOCK:
            break
        block //= 2
    double = ends[rolling[ends] % (2 * block) == 2 * block - 1]
    return f"{block}:{_signature(total, inverse, ends, n)}:{_signature(total, inverse, double, n)}"


def _short_runs(s: str) -> str:
    return "".join(c for i, c in enumerate(s) if not (i >= 3 and s[i - 3 : i] == c * 3))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, 1 bit for each character of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 less the edit distance over the lengths; 0 without a common run."""
    a, b = _short_runs(a), _short_runs(b)
    if not a or not b:
        return 0.0
    run = min(RUN, len(a), len(b), max(2, min(len(a), len(b)) // 4))
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in grams for i in range(len(b) - run + 1)):
        return 0.0
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, 0 to 1; equal ones 1, those without a common block size 0."""
    if one == other:
        return 1.0
    (a, a1, a2), (b, b1, b2) = one.split(":"), other.split(":")
    a, b = int(a), int(b)
    if a == b:
        return max(signature_likeness(a1, b1), signature_likeness(a2, b2))
    return signature_likeness(a1, b2) if a == 2 * b else signature_likeness(a2, b1) if b == 2 * a else 0.0


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"



class Ranges:
    """Parts of the order by (id, hash of the text), rising: ranges of ids and, of an id with more than a part's share of
    the rows, ranges of hashes."""

    def __init__(self, quantiles: list[int]):
        self.ids, shares = np.unique(np.array(quantiles, np.int64), return_counts=True)
        #: An id that is several quantiles has as many parts less one to itself.
        self.own = shares - 1
        self.before = np.cumsum(self.own) - self.own

    def part(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(self.ids):
            return np.zeros(len(ids), np.int64)
        at = np.searchsorted(self.ids, ids)
        i = np.minimum(at, len(self.ids) - 1)
        # Ids between two bounds follow all parts of the bound below; a bound's own parts follow those.
        out = at + np.where(at < len(self.ids), self.before[i], self.before[-1] + self.own[-1])
        place = hashes.view(np.uint64) ^ np.uint64(1 << 63)  # in the order of signed numbers
        share = (place >> np.uint64(32)).astype(np.int64) * (self.own[i] + 1) >> 32
        return out + np.where((at < len(self.ids)) & (self.ids[i] == ids), share, 0)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS: each text, its edited form and the next document in descending order of doc_id.

    The order is dealt by `Ranges` into many parts, whose bounds are quantiles (as many as parts, so bounded); each part
    also gets the first document of the part after it, and the last part the first document of all. So the texts are
    shuffled once.

    Null text: empty. Null doc_id: last in order. Rows with one doc_id: in falling order of their texts' hashes, which
    splits them if they are many; rows alike in text, too, lie beside one another in one part. Equal texts have equal
    fingerprints. Empty table: no rows; one row: its own next. Other columns are not looked at."""
    spark = bounded_batches(docs).sparkSession
    parts = 8 * shuffle_partitions(spark)
    kind = dict(docs.dtypes)["doc_id"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))
    ranges = Ranges(base.select("_id").approxQuantile("_id", [i / parts for i in range(1, parts)], 0.25 / parts))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = ranges.part(b.column("_id").to_numpy(), b.column("_hash").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(part), b.column("_id"), b.column("_hash")], ["part", "_id", "_hash"])

    most = base.select("_id", "_hash").mapInArrow(heads, "part long, _id long, _hash long").groupBy("part").agg(F.max(F.struct("_id", "_hash")).alias("head"))
    first = {r["part"]: tuple(r["head"]) for r in most.collect()}  # as many as parts
    filled = sorted(first)
    after = {first[p]: filled[i + 1] for i, p in enumerate(filled[:-1])}  # head of a part -> the part before it in descending order
    wrap = (first[filled[-1]], filled[0]) if filled else None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hashes = b.column("_id").to_numpy(), b.column("_hash").to_numpy()
            rows, part, own = [np.arange(len(ids))], [ranges.part(ids, hashes)], [np.ones(len(ids), bool)]
            for i in np.flatnonzero(np.isin(hashes, [h for _, h in first.values()])):
                key = int(ids[i]), int(hashes[i])
                for p in ([after[key]] if key in after else []) + ([wrap[1]] if key == wrap[0] else []):
                    rows.append([i])
                    part.append([p])
                    own.append([False])
            taken = b.take(pa.array(np.concatenate(rows).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part).astype(np.int64)), pa.array(np.concatenate(own).astype(bool)), *taken.columns], ["part", "own", *taken.schema.names])

    dealt = base.mapInArrow(deal, f"part long, own boolean, doc_id {kind}, _id long, _hash long, text string")
    dealt = dealt.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", F.desc("own"), F.desc("_id"), F.desc("_hash"), "text")
    names = ["doc_id", *(f.split()[0] for f in FIELDS.split(", "))]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # part, doc_id, own, text, fingerprint
        for b in batches:
            out = []
            for part, own, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "own", "doc_id", "text")), strict=True):
                new = (part, doc_id, own, text, fingerprint(text.encode()))
                if kept and kept[2] and kept[0] == part:
                    half = len(kept[3]) // 2
                    edited = (kept[3][: len(kept[3]) - half] + text[:half]).encode()
                    print_ = fingerprint(edited)
                    out.append((kept[1], len(kept[3]), hashlib.sha256(edited).hexdigest(), kept[4], print_, likeness(kept[4], print_), likeness(kept[4], new[4])))
                kept = new
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            kinds = [b.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return dealt.select("part", "own", "doc_id", "text").mapInArrow(compare, f"doc_id {kind}, {FIELDS}")
