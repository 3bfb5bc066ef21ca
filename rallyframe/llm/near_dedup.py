"""MinHash near-duplicate detection with odd sketches.

Documents are sets of distinct runs of five words. Each gets bands of ROWS MinHash values, which pick candidates, and an odd sketch: the minima of BINS bins of one hash function, folded into a bitmap of parities.
The population count of two sketches' XOR tells how many minima differ, and with it the similarity, closely
enough to drop nearly all false candidates before full sets are compared.

Every link is confirmed on full sets. No pair of bucket members is formed beyond need:
1. Texts with equal sets are one class from the start.
2. In each bucket the smallest id is paired with every other member; links found so give components. The members of
   a popular pivot are dealt over many tasks; each gets the pivot's sketch, or set, once.
3. Only buckets that still hold several components are looked at again: sketches of members of different
   components are compared, and only pairs that look similar go on to the full sets. Pairs within a component
   can't change it. Up to BLOCK members outside a bucket's largest component meet one another and those of the largest
   there, in blocks, so comparisons grow as the members do.
4. Members of buckets with more outsiders than that go through the same steps again with bands of more rows (LEVELS), which
   part unlike texts and hold each link again. Buckets of the longest bands are compared across components, however large:
   only texts just below the limit fill them.
After that each pair of different texts that shares a bucket and looks similar is either confirmed, refuted
or inside one component, so no link is lost but those that miss all bands of a level (`bands_for`: fewer than one in a
million at the limit) or that a sketch misjudges by over MARGIN standard errors (`look_from`; one in three million), for
sets of any length. The errors are of the pair at hand, so that few pairs below the limit go on to the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, constants, distinct, mix64, runs_of, shuffle_partitions, slices, windows, word_hashes, written

SHINGLE = 5
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS = 5
#: Rows of a band: of all texts, then of the members of buckets too large to be compared.
LEVELS = (ROWS, 10, 15)
#: Links at the limit that may share no band.
MISSED = 1e-6
BIN_BITS, SKETCH_BITS = 10, 11
#: Candidates go on unless their estimated similarity is below the limit by over so many standard errors.
MARGIN = 5
#: Members of a block of a large bucket, and outsiders of a bucket up to which it is compared.
BLOCK = 2048
_SECOND = constants(1, 8)[0]


def bands_for(percent: int, rows: int = ROWS) -> int:
    """As many bands as let fewer than MISSED of the pairs at the limit share none."""
    same = min(max(percent, 1) / 100, 0.999) ** rows
    return math.ceil(math.log(MISSED) / math.log1p(-same))


@cache
def _hashing(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seed = 2 * (rows - ROWS)
    return constants(bands * rows, 5 + seed)[:, None], (constants(bands * rows, 6 + seed) | np.uint64(1))[:, None], constants(rows, 7)[None, :]


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its set: sorted distinct 64-bit hashes; a text of fewer words has one, of them all."""
    words, bounds = word_hashes(column)
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        own = words[first:last]
        if len(own) >= SHINGLE:
            yield distinct(windows(own, SHINGLE))[0]
        else:
            yield windows(own, len(own)) if len(own) else own


def sketch_of(s: np.ndarray) -> bytes:
    """The odd sketch of a sorted set, then which bins are filled, then the set's size."""
    bins = (s >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])  # s is sorted, so these are the bins' minima
    parity = np.bincount((mix64(s[first]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS) & 1
    filled = np.zeros(1 << BIN_BITS, np.uint8)
    filled[bins[first]] = 1
    return np.packbits(parity.astype(np.uint8)).tobytes() + np.packbits(filled).tobytes() + np.uint64(len(s)).tobytes()


def band_keys(s: np.ndarray, percent: int, rows: int = ROWS) -> np.ndarray:
    n = bands_for(percent, rows)
    xor, times, mixed = _hashing(n, rows)
    minima = np.empty(n * rows, np.uint64)
    for first in range(0, n * rows, 20):
        part = slice(first, first + 20)
        minima[part] = ((s ^ xor[part]) * times[part]).min(axis=1)
    return mix64((mix64(minima.reshape(n, rows)) * mixed).sum(axis=1, dtype=np.uint64) + np.arange(n, dtype=np.uint64))


def signature(s: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bytes]:
    """Band keys and sketch of a sorted set."""
    return band_keys(s, percent), sketch_of(s)


def _filled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins that either has, and bins of both together."""
    cut = slice((1 << SKETCH_BITS) // 64, -1)
    count = lambda x: np.bitwise_count(x[..., cut]).sum(axis=-1, dtype=np.int64)
    return np.maximum(count(a | b), 1), count(a) + count(b)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarities from rows of sketches (64-bit words); broadcasts."""
    cut, size = (1 << SKETCH_BITS) // 64, float(1 << SKETCH_BITS)
    share = np.minimum(2 * np.bitwise_count(a[..., :cut] ^ b[..., :cut]).sum(axis=-1, dtype=np.int64) / size, 1 - 1e-9)
    differ = -size / 2 * np.log1p(-share)
    either, both = _filled(a, b)
    return (both - differ) / 2 / either


def look_from(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The estimated similarities from which rows of sketches may be of a link. The error has two parts: the bins' minima
    are a random part of both sets together (of small sets nearly all, which leaves little error), and parities tell
    roughly how many of them differ."""
    s, size = percent / 100, 1 << SKETCH_BITS
    either, _ = _filled(a, b)
    union = (a[..., -1] + b[..., -1]).astype(float) / (1 + s)  # at the limit
    differ = 2 * (1 - s) * either
    of_parities = (size / 4 * np.expm1(4 * differ / size) - differ) / (2 * either) ** 2
    return s - MARGIN * np.sqrt(s * (1 - s) / either * np.clip(1 - either / union, 0, 1) + of_parities)


def look_alike(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return estimates(a, b) >= look_from(a, b, percent)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    width = ((1 << SKETCH_BITS) + (1 << BIN_BITS)) // 64 + 1
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, width)


def signatures(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, two sums that tell the set, band keys, sketch; of an empty set, nulls in the last two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n, one, two, keys, sketches = [], [], [], [], []
            for s in shingle_sets(part.column("text")):
                n.append(len(s))
                one.append(s.sum(dtype=np.uint64))
                two.append(mix64(s ^ _SECOND).sum(dtype=np.uint64))
                bands, sketch = signature(s, percent) if len(s) else (None, None)
                keys.append(bands if bands is None else bands.view(np.int64))
                sketches.append(sketch)
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), *sums, pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    base = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch binary")


def passing(pairs: DataFrame, values: DataFrame, close) -> DataFrame:
    """Those of `pairs` (a, b), once each, for which `close(value of a, values of several b)` holds; `values` has (id, value).

    The pairs of one `a` are dealt into groups by `b`, as many as tasks can take; in each group the value of `a` comes first
    and those of its `b` stream past it."""
    dealt = pairs.withColumn("group", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(4 * shuffle_partitions(pairs.sparkSession)))))
    head = dealt.select("group", "a").distinct().join(values.withColumnRenamed("id", "a"), "a").select("group", "a", F.lit(None).cast("long").alias("b"), "value")
    rest = dealt.join(values.withColumnRenamed("id", "b"), "b").select("group", "a", "b", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of = [], None  # an id may stand for several texts, so there may be several values of `a`
        for batch in batches:
            group, a, b, value = (batch.column(c) for c in ("group", "a", "b", "value"))
            heads = np.flatnonzero(b.is_null().to_numpy(zero_copy_only=False))
            keep = np.zeros(batch.num_rows, bool)
            for first, last in zip([0, *heads + 1], [*heads, batch.num_rows], strict=True):
                if last > first:
                    keep[first:last] = np.any([close(one, value.slice(first, last - first)) for one in own], axis=0)
                if last < batch.num_rows:
                    key = group[last].as_py(), a[last].as_py()
                    own, of = (own if key == of else []) + [value.slice(last, 1)], key
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(keep))

    both = head.union(rest).repartition(shuffle_partitions(pairs.sparkSession), "group").sortWithinPartitions("group", "a", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long").distinct()


def look_similar(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (a, b) whose sketches don't rule a link out."""
    return passing(pairs, sketches.withColumnRenamed("sketch", "value"), lambda one, others: look_alike(_sketch_rows(one), _sketch_rows(others), percent))


def linked(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """By the sizes of two sets' intersection and union."""
    common = len(one) + len(other) - len(distinct(np.concatenate([one, other]))[0])
    return 100 * common >= percent * (len(one) + len(other) - common)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the documents that `ids` (id) names."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi")


def longer_bands(docs: DataFrame, ids: DataFrame, percent: int, rows: int) -> DataFrame:
    """(id, bands) with bands of so many rows, of the documents that `ids` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            keys = [band_keys(s, percent, rows).view(np.int64) if len(s) else None for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(keys, pa.list_(pa.int64()))], ["id", "bands"])

    return texts_of(docs, ids).mapInArrow(run, "id long, bands array<long>").where("bands is not null").dropDuplicates(["id", "bands"])


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` that are links by their full sets. Only the documents named in `pairs` are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sets, pa.binary())], ["id", "value"])

    def close(one: pa.Array, others: pa.Array) -> list[bool]:
        own = np.frombuffer(one[0].as_py(), np.uint64)
        return [linked(own, np.frombuffer(x.as_py(), np.uint64), percent) for x in others]

    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "candidate-ids")
    sets = written(texts_of(docs, ids).mapInArrow(run, "id long, value binary").where(F.length("value") > 0), "candidate-sets")
    return passing(pairs, sets, close)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over `links` (a, b). Labels move along links and, by jumps to
    the label's own label, in about as many rounds as the logarithm of the longest path; each round is written."""
    both = written(links.union(links.select("b", "a")).toDF("a", "b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        moved = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        moved = written(moved, "moved")
        jump = moved.select(F.col("id").alias("j"), F.col("c").alias("to"))
        new = moved.join(jump, F.col("c") == F.col("j")).select("id", "was", F.least("c", "to").alias("component"))
        new = written(new, "labels")
        labels = new.select("id", "component")
        if new.where("was <> component").limit(1).count() == 0:
            return labels


def across_components(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of `members` (key, major, n_major, n_minor, id, component, sketch) of one key and different components
    that look similar. `major` is the component with most of the key's members."""
    is_major = F.col("component") == F.col("major")
    blocks = [F.ceil(F.col(n) / BLOCK).cast("int") for n in ("n_minor", "n_major")]
    own = F.pmod(F.xxhash64("id"), F.when(is_major, blocks[1]).otherwise(blocks[0])).cast("int")

    def meetings(with_: Column, kind: int, side: Column, alone) -> Column:
        """Groups (kind, a, b): two blocks of others; a block of others and one of the largest component."""
        first, second = (F.least, F.greatest) if kind == 0 else ((lambda x, y: x), (lambda x, y: y))
        return F.transform(F.sequence(F.lit(0), with_ - 1), lambda k: F.struct(F.lit(kind).alias("kind"), first(F.col("own"), k).alias("a"), second(F.col("own"), k).alias("b"), side.alias("side"), alone(k).alias("alone")))

    never = lambda k: F.lit(False)
    of_minor = F.concat(meetings(blocks[0], 0, F.col("own"), lambda k: k == F.col("own")), meetings(blocks[1], 1, F.lit(0), never))
    of_major = F.transform(F.sequence(F.lit(0), blocks[0] - 1), lambda k: F.struct(F.lit(1).alias("kind"), k.alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), F.lit(False).alias("alone")))
    dealt = members.withColumn("own", own).withColumn("m", F.explode(F.when(is_major, of_major).otherwise(of_minor)))
    dealt = dealt.select(F.xxhash64("key", "m.kind", "m.a", "m.b").alias("group"), "id", "component", "sketch", F.col("m.side").alias("own"), F.col("m.alone").alias("alone"))

    def of_group(ids, component, sketch, own, alone) -> Iterator[np.ndarray]:
        step = max(1, (1 << 16) // len(ids))
        for first in range(0, len(ids), step):
            rows = slice(first, first + step)
            ask = (component[rows, None] < component[None, :]) & ((own[rows, None] != own[None, :]) | alone[rows, None])
            i, j = np.nonzero(ask)
            close = look_alike(sketch[rows][i], sketch[j], percent)
            i, j = i[close], j[close]
            yield np.stack([np.minimum(ids[rows][i], ids[j]), np.maximum(ids[rows][i], ids[j])], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "group"):
            ids, component, own = (t.column(c).to_numpy() for c in ("id", "component", "own"))
            for found in of_group(ids, component, _sketch_rows(t.column("sketch")), own, t.column("alone").to_numpy()):
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    dealt = dealt.repartition(shuffle_partitions(members.sparkSession), "group").sortWithinPartitions("group", "id")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def linked_nodes(nodes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the `nodes` (id, bands, sketch) that have links."""
    sketches = nodes.select("id", "sketch")
    level, links, found = nodes.select("id", "bands"), None, None
    for rows in (*LEVELS[1:], None):
        buckets = level.select("id", F.explode("bands").alias("key"))
        if found is None:
            placed = buckets.withColumn("component", F.col("id"))
        else:
            placed = buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
        pivot = F.min(F.struct("id", "component")).alias("pivot")
        shared = written(placed.groupBy("key").agg(pivot, F.count("*").alias("n")).where("n > 1"), "buckets")
        stars = placed.join(shared, "key").where("id <> pivot.id and component <> pivot.component")
        stars = written(stars.select(F.col("pivot.id").alias("a"), F.col("id").alias("b")).distinct(), "star-pairs")
        alike = written(look_similar(stars, sketches, percent), "star-candidates")
        own = written(confirmed(alike, docs, percent), "star-links")
        links = own if links is None else links.union(own)
        found = components(links)

        wide = buckets.join(shared.where("n > 2").select("key"), "key").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        wide = written(wide, "bucket-members")
        sizes = wide.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key")
        sizes = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.max("n").alias("n_major"), (F.sum("n") - F.max("n")).alias("n_minor"))
        split = written(sizes.where("n_minor > 0"), "split-buckets")
        large = F.lit(False) if rows is None else F.col("n_minor") > BLOCK
        members = wide.join(split.where(~large), "key").join(sketches, "id")
        more = written(across_components(members, percent).join(stars, ["a", "b"], "left_anti"), "more-candidates")
        if more.limit(1).count():
            links = links.union(written(confirmed(more, docs, percent), "more-links"))
            found = components(links)
        if rows is None or split.where(large).limit(1).count() == 0:
            return found
        ids = written(wide.join(split.where(large).select("key"), "key").select("id").distinct(), "large-bucket-members")
        level = written(longer_bands(docs, ids, percent, rows), "longer-bands")


def cluster(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs` (doc_id, text).

    Null or empty text, or no word: n_shingles 0, linked with nothing. Null doc_id: component_id null, kept.
    Repeated rows of one doc_id are one node with the links of each of its texts; all are kept or none. Texts
    of any length are taken whole. Empty table: no rows. Other columns are not looked at."""
    sig = written(signatures(docs, percent), "signatures")
    real = sig.where("doc_id is not null and n_shingles > 0")
    sets = ["n_shingles", "set_a", "set_b"]
    classes = written(real.groupBy(*sets).agg(F.min("doc_id").alias("id")), "classes")
    nodes = written(real.join(classes, sets).where("doc_id = id").select("id", "bands", "sketch").dropDuplicates(["id", "bands"]), "nodes")
    found = linked_nodes(nodes, docs, percent)

    # An id may stand for several texts, so classes are joined by the id too.
    same = real.join(classes, sets).where("doc_id <> id").select(F.col("id").alias("a"), F.col("doc_id").alias("b")).distinct()
    of_class = same.join(found, F.col("a") == F.col("id"), "left").select(F.col("b").alias("id"), F.coalesce("component", "a").alias("component"))
    every = written(found.union(of_class).groupBy("id").agg(F.min("component").alias("component_id")), "components")
    out = sig.select("doc_id", "n_shingles").join(every, F.col("doc_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
