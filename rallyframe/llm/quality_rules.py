"""Quality rules: per-document word rules, and lines that too many documents of a host share.

Every line with a word is normalised (A-Z lower-cased, words joined by one space) and hashed. For each host
(here: `source`) the distinct documents that have a line are counted; lines in more than the limit are
boilerplate. A document is rejected when taking these lines out leaves it too little; `cleaned` gives the texts of
the others without them.

Documents are told apart by a hash of their whole text, so that exact copies of one document count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, _power, bounded_batches, constants, mix64, raw_text, set_aside, slices, windows, written

#: A line is boilerplate if over LINE_DOCUMENTS distinct documents of its host have it, however large the host.
LINE_DOCUMENTS = 20
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEAST_WORDS = 10
LEAST_SHARE = 0.2
WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROW = constants(1, 3)[0]

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<long>"


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[offsets[1:]] - total[offsets[:-1]]


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of every line, wordless ones too, in their order."""
    rows, feeds = len(offsets) - 1, np.flatnonzero(data == 10)
    of_feed = np.searchsorted(offsets, feeds, "right") - 1
    row, start = np.concatenate([np.arange(rows), of_feed]), np.concatenate([offsets[:-1], feeds + 1])
    row_of_end, end = np.concatenate([of_feed, np.arange(rows)]), np.concatenate([feeds, offsets[1:]])
    by_start = np.lexsort((start, row))
    return row[by_start], start[by_start], end[np.lexsort((end, row_of_end))]


def line_hashes(words: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the runs of words from `first` to before `last`."""
    power, inverse = _power(len(words.start) + 1)
    total = np.zeros(len(words.start) + 1, np.uint64)
    np.cumsum(words.hash * power[: len(words.start)], out=total[1:])
    return mix64((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)).view(np.int64)


def measure(data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Arrays of MEASURES for a slice of texts."""
    rows = len(offsets) - 1
    words = Words(data, offsets, lower=False)
    lowered = Words(data, offsets)
    in_word = np.zeros(len(data) + 1, np.int8)
    np.add.at(in_word, words.start, 1)
    np.add.at(in_word, words.end, -1)
    in_word = np.cumsum(in_word[:-1]) > 0
    n_words = np.diff(words.bounds)
    word_chars = _per_row(in_word & ((data & 0xC0) != 0x80), offsets)
    n_symbols = _per_row(_SYMBOL[data], offsets)

    row, start, end = lines_of(data, offsets)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    has = last > first
    row, start, end, first, last = row[has], start[has], end[has], first[has], last[has]
    of_row = row.astype(np.uint64) * _ROW
    _, one = np.unique(mix64(words.span_hash(start, end) ^ of_row), return_index=True)
    per_row = lambda x: np.bincount(x, minlength=rows)
    n_dup_lines = per_row(row) - per_row(row[one])

    line = windows(words.hash, WINDOW)
    inside = words.row[: len(line)] == words.row[WINDOW - 1 :] if len(line) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    _, which, count = np.unique(mix64(line[at] ^ (words.row[at].astype(np.uint64) * _ROW)), return_inverse=True, return_counts=True)
    twice = at[count[which] > 1] if len(at) else at
    cover = np.zeros(len(words.start) + WINDOW + 1, np.int64)
    cover[: len(words.start) + 1] += np.bincount(twice, minlength=len(words.start) + 1)[: len(words.start) + 1]
    cover[WINDOW:] -= np.bincount(twice, minlength=len(words.start) + 1)[: len(words.start) + 1]
    n_repeat = _per_row(np.cumsum(cover)[: len(words.start)] > 0, words.bounds)

    hashes = line_hashes(lowered, first, last)
    sizes = last - first
    edges = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    flat = [pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat)]
    return [*flat, pa.ListArray.from_arrays(edges, pa.array(hashes)), pa.ListArray.from_arrays(edges, pa.array(sizes, pa.int64()))]


def host_of() -> Column:
    """The host of a row, never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, host (never null), text_key and MEASURES of every row; the text stays behind."""
    names = [c.split()[0] for c in MEASURES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = measure(*raw_text(part.column("text")))
            keep = ["doc_id", "host", "text_key"]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *values], keep + names)

    base = bounded_batches(docs).select("doc_id", host_of().alias("host"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, host string, text_key long, {MEASURES}")


def frequent_lines(m: DataFrame, most: int = LINE_DOCUMENTS, share: float = 0.0) -> DataFrame:
    """(host, line) of the lines that too many documents have; also over a share of the host's documents, if asked for."""
    once = m.where("n_words > 0").groupBy("host", "text_key").agg(F.first("line_hashes").alias("line_hashes"))
    counts = once.select("host", F.explode(F.array_distinct("line_hashes")).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > most)
    if not share:
        return counts.select("host", "line")
    documents = m.where("n_words > 0").select("host", "text_key").distinct().groupBy("host").agg(F.count("*").alias("n_host"))
    return counts.join(documents, "host").where(F.col("n") > share * F.col("n_host")).select("host", "line")


def without_lines(texts: pa.Array, gone: list[list[int]]) -> list[str]:
    """Texts without the lines whose hashes are in `gone`; the others, also those without a word, stay in their order."""
    data, offsets = raw_text(texts)
    words = Words(data, offsets)
    row, start, end = lines_of(data, offsets)
    first, last = np.searchsorted(words.start, start), np.searchsorted(words.start, end)
    stays = np.ones(len(row), bool)
    hashes = line_hashes(words, first, last)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    out = []
    for k, of_row in enumerate(gone):
        part = slice(bounds[k], bounds[k + 1])
        stays[part] = (last[part] == first[part]) | ~np.isin(hashes[part], np.array(of_row, np.int64))
        at = np.flatnonzero(stays[part]) + bounds[k]
        out.append(b"\n".join(data[start[i] : end[i]].tobytes() for i in at).decode())
    return out


def _judged(docs: DataFrame, most: int, share: float, least_words: int, least_share: float) -> DataFrame:
    """What `judge` gives, with host and boilerplate_lines (hashes; null if there are none)."""
    m = written(measured(docs).withColumn("_row", F.monotonically_increasing_id()), "quality-measures")
    lines = m.select("_row", "host", F.explode(F.arrays_zip("line_hashes", "line_words")).alias("x")).select("_row", "host", F.col("x.line_hashes").alias("line"), F.col("x.line_words").alias("words"))
    lost = lines.join(frequent_lines(m, most, share), ["host", "line"]).groupBy("_row").agg(F.sum("words").alias("boilerplate_words"), F.collect_set("line").alias("boilerplate_lines"))
    out = m.drop("line_hashes", "line_words").join(lost, "_row", "left").drop("_row").fillna(0, ["boilerplate_words"])
    left = F.col("n_words") - F.col("boilerplate_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (left >= least_words) & (left >= least_share * F.col("n_words")))


def judge(docs: DataFrame, most: int = LINE_DOCUMENTS, share: float = 0.0, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, text_key, the counts, words in boilerplate lines, base_failed and kept, a row for each row of `docs`.

    Null or empty text: no words, so base_failed. Null source: a host of its own. Null or repeated doc_id:
    rows are judged one by one. Repeated rows get the same verdict. Empty table: no rows. Texts of any length
    are taken whole. Columns beside doc_id, text and source are not looked at."""
    return _judged(docs, most, share, least_words, least_share).drop("host", "boilerplate_lines")


def cleaned(docs: DataFrame, most: int = LINE_DOCUMENTS, share: float = 0.0, least_words: int = LEAST_WORDS, least_share: float = LEAST_SHARE) -> DataFrame:
    """The rows of `docs` that `judge` keeps, their texts without boilerplate lines; n_chars, if there is one, follows the text.

    All else is as in `docs`, whatever its columns are called. Null or empty text is rejected, null source a host of its own; repeated rows
    are all kept or all rejected; texts of any length; an empty table gives no rows. A row's verdict and lines follow from its text and source, so rows are known by doc_id,
    host and a hash of the text."""
    names = docs.columns
    docs, back = set_aside(docs, {"_id", "_host", "_key", "_kept", "_lines"}.__contains__)
    touched = _judged(docs, most, share, least_words, least_share).where("not kept or boilerplate_words > 0")
    touched = touched.select(F.col("doc_id").alias("_id"), F.col("host").alias("_host"), F.col("text_key").alias("_key"), F.col("kept").alias("_kept"), F.col("boilerplate_lines").alias("_lines"))
    touched = written(touched.dropDuplicates(["_id", "_host", "_key"]), "quality-touched")
    same = docs["doc_id"].eqNullSafe(touched["_id"]) & (host_of() == touched["_host"]) & (F.xxhash64(docs["text"]) == touched["_key"])
    # Merged at every size: the touched rows grow with the input, so they are never sent to all tasks.
    left = docs.join(touched.hint("merge"), same, "left").where("_kept is null or _kept").select(*docs.columns, "_lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            which = np.flatnonzero(part.column("_lines").is_valid().to_numpy(zero_copy_only=False))
            if len(which):
                some, texts = part.take(pa.array(which)), part.column("text").to_pylist()
                for i, text in zip(which, without_lines(some.column("text"), some.column("_lines").to_pylist()), strict=True):
                    texts[i] = text
                part = part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(texts, part.schema.field("text").type))
            yield part

    out = bounded_batches(left).mapInArrow(run, left.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(docs.columns).withColumnsRenamed(back).select(names)
