"""Helpers shared by the text operators: table access, durable intermediate tables, vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.translate(col, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    Where the session names none, one is made if driver and executors are one process; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-shared-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str, *partition_by: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without recomputing `df`, and what is
    non-deterministic in `df` (row ids, ties) is fixed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch: texts differ in length a thousandfold, so batches are bounded by bytes rather than rows.
BATCH_BYTES = 2 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """Bound the Arrow batches of the session's Python stages, where the session doesn't say otherwise; gives back `df`."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) is None:
        conf.set(name, str(BATCH_BYTES))
    return df


def set_aside(df: DataFrame, own: Callable[[str], bool]) -> tuple[DataFrame, dict[str, str]]:
    """`df` with other names for the columns whose lower-case names an operator takes for its own, and the way back."""
    taken, away = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        name = c
        while own(name.lower()) or (name != c and name.lower() in taken):
            name = f"kept_{name}"
        if name != c:
            away[c] = name
            taken.add(name.lower())
    return df.withColumnsRenamed(away), {v: k for k, v in away.items()}


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# --- words of many texts at once, inside a task -------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = constants(256, 1)
_BASE = 0xD1342543DE82EF95
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 19)
        for i, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def slices(batches, column: str, limit: int = 1 << 19):
    """Record batches cut so that `column` holds at most `limit` bytes in each, or is one row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, first = np.cumsum(size), 0
        while first < batch.num_rows:
            base = ends[first - 1] if first else 0
            n = max(1, int(np.searchsorted(ends, base + limit, "right")) - first)
            yield batch.slice(first, n)
            first += n


def collected(batches, column: str, limit: int):
    """Record batches put together as long as `column` holds at most `limit` bytes; each has at most `limit` rows."""
    held, size, rows = [], 0, 0
    for part in slices(batches, column, limit):
        more = pc.sum(pc.fill_null(pc.binary_length(part.column(column)), 0)).as_py() or 0
        if held and (size + more > limit or rows + part.num_rows > limit):
            yield pa.concat_batches(held)
            held, size, rows = [], 0, 0
        held.append(part)
        size, rows = size + more, rows + part.num_rows
    if held:
        yield pa.concat_batches(held)


def runs_of(batches, column: str):
    """Tables of all rows with one value of `column`, from batches in which equal values lie together."""
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        value = b.column(column).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(value[1:] != value[:-1]) + 1), b.num_rows]
        for first, last in zip(edges[:-1], edges[1:], strict=True):
            if rest and rest[0].column(column)[0].as_py() != value[first]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(b.slice(first, last - first))
    if rest:
        yield pa.Table.from_batches(rest)


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after another, and where each begins; null counts as empty."""
    arr = pa.concat_arrays([pc.fill_null(column.cast(pa.large_string()), "")]).cast(pa.large_binary())
    _, offsets, data = arr.buffers()
    offsets = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(arr) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a slice of texts: `start`, `end` byte places, `row` of the text, `hash` (64 bits)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True):
        self.data = data = _LOWER[data] if lower else data
        self.offsets, self.n_rows = offsets, len(offsets) - 1
        ink = ~_SPACE[data]
        first = ink.copy()
        first[1:] &= ~ink[:-1]
        last = ink.copy()
        last[:-1] &= ~ink[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        first[edges] = ink[edges]
        last[edges - 1] = ink[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        #: Where each text's words begin.
        self.bounds = np.searchsorted(self.row, np.arange(self.n_rows + 1))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans: a polynomial over the whole slice, from which each span is cut."""
        power, inverse = _power(len(self.data))
        upto = _BYTE[self.data]
        upto *= power[: len(upto)]
        np.cumsum(upto, out=upto)
        before = np.where(start > 0, upto[np.maximum(start, 1) - 1], np.uint64(0)) if len(upto) else np.zeros(len(start), np.uint64)
        total = (upto[end - 1] - before) if len(upto) else before
        return mix64(total * inverse[start] + (end - start).astype(np.uint64))

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


#: Texts over so many bytes are hashed in parts, cut at white space.
LONG_TEXT = 4 << 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice of texts, and where each text's begin. A very long text takes little more memory
    than itself and its hashes."""
    data, offsets = raw_text(column)
    if len(data) <= LONG_TEXT:
        words = Words(data, offsets)
        return words.hash, words.bounds
    out, n = [], np.zeros(len(offsets), np.int64)
    for row, (first, last) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        while first < last:
            end = min(first + LONG_TEXT, last)
            while end < last and not _SPACE[data[end]]:
                space = np.flatnonzero(_SPACE[data[end : end + 4096]])
                end = end + int(space[0]) if len(space) else min(end + 4096, last)
            out.append(Words(data[first:end], np.array([0, end - first])).hash)
            n[row + 1] += len(out[-1])
            first = end
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.cumsum(n)


def distinct(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and how often each is there."""
    a = np.sort(a)
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, np.int64)
    return a[start], np.diff(np.append(start, len(a)))


_STEP = constants(64, 2)


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, np.uint64)
    for j in range(size):
        h = mix64(h + words[j : j + n] * _STEP[j])
    return h
