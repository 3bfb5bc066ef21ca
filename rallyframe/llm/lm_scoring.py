"""Language-model scoring by a Katz backoff model of word triples.

Words are lower-cased; each text is its words and one end token, which is also the history of a text's first word.
The model, from the training texts only, with d(r) the Good-Turing discounted value of a count r:

    p(w | u v) = d3(r) / c(u v)       if the triple was seen r > 0 times
               = alpha(u v) p(w | v)  if not
    p(w | v)   = d2(r) / c(v)         if the pair was seen r > 0 times
               = alpha(v) p(w)        if not
    p(w)       = d1(c(w)) / N         if the word was seen; what is left goes to the unseen word

A history that was never seen leaves the word to the next shorter one. alpha(h) is the mass that discounting takes
from h's continuations over 1 - (their probabilities after the shorter history), so all of p(. | h) sums to one. Counts
over GOOD_TURING lose as much as a count of GOOD_TURING does (Katz takes nothing from them), so that every history has
mass to give.

There is no vocabulary: words, pairs and triples are known by hashes, all alike, of so many bits for the input's size
that one n-gram in 2 ** SPARE_BITS shares its hash with another (62 bits at most). The work goes in blocks of
texts and in shards of hashes, both of bounded size, whose number follows the size of the input:

1. Each block sends its distinct n-grams with their counts to the shards of their hashes. A shard adds up and writes
   a table of counts: for each block the totals, in the block's own order of hashes. One block is named each n-gram's owner.
2. Blocks meet their totals and score all that was seen. For each history that some text may back off from, a
   block sends what its own n-grams take from and cover of the history's mass, and for each n-gram not seen it asks
   for the history's weight.
3. Shards add up the weights and send sums by text back to the blocks.

So a frequent n-gram or history is one entry a block, never a row for each occurrence, and is dealt by a hash; the driver
sees the counts of counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, collected, constants, distinct, mix64, runs_of, shuffle_partitions, slices, word_hashes, written

ORDERS = 3
GOOD_TURING = 5
#: The fold held out: crc32 of doc_id as text, modulo 7. Fixed by the contract.
FOLDS, FOLD = 7, 2
#: Bytes of text in a block, and for a shard. With both larger, fewer and larger pieces go between them.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 4 << 20
SPARE_BITS = 20
END = constants(1, 9)[0]
_MIX = constants(8, 11)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


# --- packed arrays -----------------------------------------------------------------------------


def squeeze(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) if len(a) else b""


def expand(raw: bytes | None, kind: type) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(a: np.ndarray) -> bytes:
    return squeeze(np.diff(a, prepend=a.dtype.type(0)))


def expand_sorted(raw: bytes | None, kind: type = np.uint64) -> np.ndarray:
    return np.cumsum(expand(raw, kind), dtype=kind)


@dataclass(frozen=True)
class Sizes:
    """Bits of a hash, and how many shards there are."""

    bits: int
    shards: int

    @staticmethod
    def of(size: int, shard_bytes: int) -> Sizes:
        """For so many bytes of text, which have fewer n-grams."""
        return Sizes(min(62, max(size, 1 << 10).bit_length() + SPARE_BITS), max(8, -(-size // shard_bytes)))

    def key(self, h: np.ndarray, order: int) -> np.ndarray:
        """The hash's highest bits, then two of the order."""
        return h >> np.uint64(64 - self.bits) << np.uint64(2) | np.uint64(order)

    def by_shard(self, keys: np.ndarray) -> Iterator[tuple[int, slice]]:
        """Where the keys of each shard lie among sorted keys: a shard has a range of hashes."""
        shard = ((keys >> np.uint64(self.bits + 2 - 32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(edges)):
            yield int(s), slice(int(edges[s]), int(edges[s + 1]))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


# --- discounts -----------------------------------------------------------------------------------


def discounts(of_counts: dict[int, int], k: int = GOOD_TURING) -> np.ndarray:
    """Good-Turing factors for counts 0 to k (0: unused) after Katz; where the counts of counts give none
    between 0 and 1, half a count is taken off."""
    n = [0, *(of_counts.get(r, 0) for r in range(1, k + 2))]
    out = np.ones(k + 1)
    for r in range(1, k + 1):
        d = 0.0
        if n[1] and n[r]:
            common = (k + 1) * n[k + 1] / n[1]
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def loss(factor: np.ndarray, r: np.ndarray) -> np.ndarray:
    """What discounting takes from counts r."""
    low = np.minimum(r, GOOD_TURING)
    return low * (1 - factor[low])


class Model:
    """What the driver knows of the training texts: sizes and discounts, from counts of counts by order."""

    def __init__(self, stats: np.ndarray):
        """By order: numbers of n-grams with count 1 to GOOD_TURING + 1, distinct n-grams, and n-grams in all."""
        self.factor = [discounts({r + 1: int(n) for r, n in enumerate(of_order[: GOOD_TURING + 1])}) for of_order in stats]
        self.types, self.tokens = int(stats[0, -2]), int(stats[0, -1])
        few = stats[0, :GOOD_TURING]
        lost = few @ loss(self.factor[0], np.arange(1, GOOD_TURING + 1)) + (self.types - few.sum()) * loss(self.factor[0], np.array([GOOD_TURING]))[0]
        self.unseen = float(lost / self.tokens) if self.tokens else 1.0

    def word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, (c - loss(self.factor[0], c)) / max(1, self.tokens), self.unseen)

    def seen(self, order: int, r: np.ndarray, history: np.ndarray) -> np.ndarray:
        """p of an n-gram with count r > 0 after a history."""
        return (r - loss(self.factor[order - 1], r)) / np.maximum(history, 1)


# --- n-grams of a block --------------------------------------------------------------------------


class Grams:
    """All n-grams of a block's texts."""

    def __init__(self, texts: pa.Array, sizes: Sizes):
        tokens, lengths = [], []
        for part in slices([pa.RecordBatch.from_arrays([texts], ["text"])], "text"):
            words, bounds = word_hashes(part.column("text"))
            n = np.diff(bounds)
            token = np.full(len(words) + len(n), END)
            token[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
            tokens.append(token)
            lengths.append(n + 1)
        token, self.n = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((tokens, np.uint64), (lengths, np.int64)))
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        #: Of a text's first token the history is the end token alone.
        self.first = np.zeros(len(token), bool)
        self.first[np.cumsum(self.n) - self.n] = True
        before = np.roll(token, 1)
        before[self.first] = END
        pair = mix64(before * _MIX[0] + token * _MIX[1])
        triple = mix64(np.roll(pair, 1) * _MIX[2] + token * _MIX[3])
        self.words, self.pairs, self.triples = (sizes.key(x, k) for k, x in ((1, mix64(token)), (2, pair), (3, triple)))
        self.end = sizes.key(mix64(np.array([END])), 1)

    def keys(self, of: np.ndarray) -> np.ndarray:
        """Keys of all orders at the places `of` (a mask)."""
        return np.concatenate([self.words[of], self.pairs[of], self.triples[of & ~self.first]])

    def histories(self, of: np.ndarray) -> np.ndarray:
        """Keys of the histories at the places `of`."""
        later = np.flatnonzero(of & ~self.first) - 1
        return np.concatenate([self.words[later], self.pairs[later], self.end if (of & self.first).any() else self.end[:0]])

    def sent(self, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct keys in order, their counts in training texts, and which are histories in other texts."""
        of = train[self.row]
        own, n = distinct(self.keys(of))
        if of.all():
            return own, n, np.zeros(len(own), np.int64)
        every, _ = distinct(np.concatenate([own, self.keys(~of)]))
        count, asked = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        count[np.searchsorted(every, own)] = n
        asked[np.searchsorted(every, distinct(self.histories(~of))[0])] = 1
        return every, count, asked

    def places(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's distinct keys in order, and where each token's word, pair and triple stand (the first's triple: 0)."""
        key, at = np.unique(self.keys(np.ones(len(self.row), bool)), return_inverse=True)
        n = len(self.row)
        triple = np.zeros(n, np.int64)
        triple[~self.first] = at[2 * n :]
        return key, at[:n], at[n : 2 * n], triple


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """(block, docs): rows of `docs` (doc_id, train, text) put together. Written, so that each pass sees the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        for k, part in enumerate(collected(batches, "text", block_bytes)):
            yield _batch([(base + k, _pack(part))], "block long, docs binary")

    return written(docs.mapInArrow(run, "block long, docs binary"), "text-blocks", options={"parquet.page.size.row.check.min": "1"})


# --- counts --------------------------------------------------------------------------------------

SENT = "shard long, block long, keys binary, counts binary"
COUNTS = "block long, shard long, totals binary, stats array<long>"


def count_ngrams(texts: DataFrame, sizes: Sizes) -> DataFrame:
    """COUNTS, a row for each shard and block: totals in the block's order of keys, in four times the value; bit 1: is a
    history that may be asked for; bit 0: the block owns the key. And a row of statistics for each shard (block null)."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, raw in zip(b.column("block").to_pylist(), b.column("docs").to_pylist(), strict=True):
                part = _unpack(raw)
                key, n, asked = Grams(part.column("text"), sizes).sent(part.column("train").to_numpy(zero_copy_only=False))
                code = (n << 1 | asked).astype(np.uint64)
                yield _batch([(s, block, squeeze_sorted(key[at]), squeeze(code[at])) for s, at in sizes.by_shard(key)], SENT)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "shard"):
            keys = [expand_sorted(k) for k in t.column("keys").to_pylist()]
            code = np.concatenate([expand(c, np.uint64) for c in t.column("counts").to_pylist()]).astype(np.int64)
            key, edges = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
            order = np.argsort(key, kind="stable")
            key, code = key[order], code[order]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
            total, asked = np.add.reduceat(code >> 1, start), np.bitwise_or.reduceat(code & 1, start)
            counted = np.flatnonzero(code > 1)
            owner = np.zeros(len(key), np.int64)
            owner[counted[np.flatnonzero(np.diff(group[counted], prepend=-1))]] = 1
            out = np.empty(len(key), np.uint64)
            out[order] = (total << 2 | asked << 1)[group] | owner
            kinds = (key[start] & np.uint64(3)).astype(np.int64)
            stats = []
            for k in range(1, ORDERS + 1):
                n = total[(kinds == k) & (total > 0)]
                stats += [*np.bincount(np.minimum(n, GOOD_TURING + 2), minlength=GOOD_TURING + 3)[1 : GOOD_TURING + 2].tolist(), len(n), int(n.sum())]
            shard = t.column("shard")[0].as_py()
            rows = [(block, shard, squeeze(out[a:b]), None) for block, a, b in zip(t.column("block").to_pylist(), edges[:-1], edges[1:], strict=True)]
            yield _batch([*rows, (None, shard, None, stats)], COUNTS)

    return written(_dealt(texts.mapInArrow(send, SENT), "shard", "block").mapInArrow(add_up, COUNTS), "ngram-counts")


def _dealt(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one `key` lie together, in order."""
    return df.repartition(shuffle_partitions(df.sparkSession), key).sortWithinPartitions(key, *order)


def model_of(counts: DataFrame) -> Model:
    rows = counts.where("block is null").select(F.posexplode("stats").alias("place", "n")).groupBy("place").agg(F.sum("n")).collect()
    stats = np.zeros(ORDERS * (GOOD_TURING + 3), np.int64)
    for place, n in rows:  # at most so many
        stats[place] = n
    return Model(stats.reshape(ORDERS, -1))


# --- scoring -------------------------------------------------------------------------------------

#: Kinds of rows on their way to a shard: a part of histories' masses (keys, a: lost, b: covered), a block's questions
#: (keys, a: rows of the block, b: how often), and a block's scores so far (a).
PART, ASK, SCORES = range(3)
MASSES = "shard long, kind int, block long, keys binary, a binary, b binary"
ANSWERS = "block long, kind int, a binary, b binary"


def weigh(masses: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of histories, and log10 of alpha times the history's count."""
    key = np.concatenate([np.zeros(0, np.uint64), *(m[0] for m in masses)])
    key, which = np.unique(key, return_inverse=True)
    lost, covered = (np.bincount(which, weights=np.concatenate([np.zeros(0), *(m[i] for m in masses)]), minlength=len(key)) for i in (1, 2))
    return key, np.log10(lost) - np.log10(1 - covered)


def evaluate(grams: Grams, train: np.ndarray, code: np.ndarray, model: Model):
    """The block's keys; (score so far, base, known tokens) by row; (history, lost, covered) of what the block owns; (history, row, how often) of questions.
    Histories are places in `key`."""
    total, asked, owner = (code >> np.uint64(2)).astype(np.int64), (code & np.uint64(2)) > 0, (code & np.uint64(1)) > 0
    key, word, pair, triple = grams.places()
    end = int(np.searchsorted(key, grams.end)[0])
    of_pair = np.where(grams.first, end, np.roll(word, 1))
    of_triple = np.roll(pair, 1)

    c1, c2, c3 = total[word], total[pair], np.where(grams.first, 0, total[triple])
    h1, h2 = total[of_pair], np.where(grams.first, 0, total[of_triple])
    p1 = model.word(c1)
    p2 = model.seen(2, c2, h1)
    by_three, by_two = c3 > 0, (c3 == 0) & (c2 > 0)
    off_two, off_one = (c3 == 0) & (h2 > 0), (c3 == 0) & (c2 == 0) & (h1 > 0)
    log = np.log10(np.where(by_three, model.seen(3, np.maximum(c3, 1), h2), np.where(by_two, p2, p1)))
    log -= np.where(off_two, np.log10(np.maximum(h2, 1)), 0) + np.where(off_one, np.log10(np.maximum(h1, 1)), 0)
    rows = len(grams.n)
    known = c1 > 0
    scores = [np.bincount(grams.row, weights=x, minlength=rows) for x in (log, np.log10(c1 + 1.0), known)]

    place = np.full(len(key), -1)
    train_at = np.flatnonzero(train[grams.row])[::-1]
    place[pair[train_at]] = train_at
    place[triple[train_at[~grams.first[train_at]]]] = train_at[~grams.first[train_at]]
    kind = (key & np.uint64(3)).astype(np.int64)
    history, lost, covered = [], [], []
    for k, before, count, lower in ((2, of_pair, c2, p1), (3, of_triple, c3, p2)):
        at = place[np.flatnonzero(owner & (kind == k))]
        at = at[asked[before[at]]]
        history.append(before[at])
        lost.append(loss(model.factor[k - 1], count[at]))
        covered.append(lower[at])
    own, which = np.unique(np.concatenate(history), return_inverse=True)
    masses = own, *(np.bincount(which, weights=np.concatenate(x), minlength=len(own)) for x in (lost, covered))

    questions = np.concatenate([of_pair[off_one], of_triple[off_two]]) * rows + np.concatenate([grams.row[off_one], grams.row[off_two]])
    questions, often = np.unique(questions, return_counts=True)
    return key, scores, masses, (questions // max(1, rows), questions % max(1, rows), often)


def score_blocks(texts: DataFrame, counts: DataFrame, model: Model, sizes: Sizes) -> DataFrame:
    """MASSES: the blocks' scores of what was seen, and what they add to and ask of histories' weights."""
    both = texts.select("block", F.lit(-1).cast("long").alias("shard"), "docs").unionByName(counts.where("block is not null").select("block", "shard", F.col("totals").alias("docs")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "block"):
            block, raw = t.column("block")[0].as_py(), t.column("docs").to_pylist()
            part, code = _unpack(raw[0]), np.concatenate([np.zeros(0, np.uint64), *(expand(c, np.uint64) for c in raw[1:])])
            train = part.column("train").to_numpy(zero_copy_only=False)
            grams = Grams(part.column("text"), sizes)
            key, (score, base, known), (own, lost, covered), (of, row, often) = evaluate(grams, train, code, model)
            base -= grams.n * np.log10(model.tokens + model.types + 1.0)
            columns = {"held_out": ~train, "n_tokens": grams.n, "n_known": known.astype(np.int64), "base_score": base, "score": score}
            result = pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns.values())], ["doc_id", *columns])
            rows = [(block % sizes.shards, SCORES, block, None, _pack(result), None)]
            rows += [(s, PART, block, squeeze_sorted(key[own[at]]), squeeze(lost[at]), squeeze(covered[at])) for s, at in sizes.by_shard(key[own])]
            rows += [(s, ASK, block, squeeze_sorted(key[of[at]]), squeeze(row[at].astype(np.uint32)), squeeze(often[at].astype(np.uint32))) for s, at in sizes.by_shard(key[of])]
            yield _batch(rows, MASSES)

    return _dealt(both, "block", "shard").mapInArrow(run, MASSES)


def back_off(masses: DataFrame) -> DataFrame:
    """ANSWERS: for each block's questions to a shard the sums by row (a: rows, b: sums), and the blocks' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "shard"):
            kind, block = t.column("kind").to_pylist(), t.column("block").to_pylist()
            keys, a, b = (t.column(c) for c in ("keys", "a", "b"))
            at = [i for i, k in enumerate(kind) if k == PART]
            known, weight = weigh([(expand_sorted(keys[i].as_py()), expand(a[i].as_py(), float), expand(b[i].as_py(), float)) for i in at])
            out = []
            for i, k in enumerate(kind):
                if k == SCORES:
                    out.append((block[i], SCORES, a[i].as_py(), None))
                elif k == ASK:
                    rows, which = np.unique(expand(a[i].as_py(), np.uint32), return_inverse=True)
                    each = expand(b[i].as_py(), np.uint32) * weight[np.searchsorted(known, expand_sorted(keys[i].as_py()))]
                    out.append((block[i], ASK, squeeze(rows), squeeze(np.bincount(which, weights=each))))
            yield _batch(out, ANSWERS)

    return _dealt(masses, "shard", "kind", "block").mapInArrow(run, ANSWERS)


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of `docs`.

    Null or empty text: the end token alone. Null doc_id: a training row. Repeated rows: each counts and is
    scored. Texts of any length are taken whole; one longer than a block is a block of its own. Empty table: no rows; if
    no row trains, every word is the unseen one. Other columns are not looked at."""
    kind = dict(docs.dtypes)["doc_id"]
    base = bounded_batches(docs).select("doc_id", (~held_out(F.col("doc_id"))).alias("train"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sizes = Sizes.of(size, shard_bytes)
    texts = blocks(base, block_bytes)
    counts = count_ngrams(texts, sizes)
    model = model_of(counts)
    answers = back_off(score_blocks(texts, counts, model, sizes))
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, "block"):
            kinds, a, b = t.column("kind").to_pylist(), t.column("a"), t.column("b")
            out = _unpack(a[kinds.index(SCORES)].as_py())
            total = out.column("score").to_numpy().copy()
            for i in (i for i, k in enumerate(kinds) if k == ASK):
                total[expand(a[i].as_py(), np.uint32)] += expand(b[i].as_py(), float)
            columns = [*(out.column(c) for c in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(total), model.tokens)), out.column("base_score"), pa.array(total)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _dealt(answers, "block", "kind").mapInArrow(gather, schema)
