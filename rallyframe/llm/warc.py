"""WARC archives of pages, and their index: capture runs merged into histories by URL key and time.

Writing: each task writes archives of its pages, a gzip member a record, into the folder that executors share, and tells which
it has closed; only those are read, so a repeated task does no harm. A page whose payload another page has too becomes a
revisit of that of the smallest id. Which payloads recur is found from digests alone.

Reading: each archive is read record by record; payloads are hashed anew. The captures of a task, sorted by URL key, time and
page, are a run. The index is an external merge of all runs: keys that cut them in ranges are drawn from the runs, runs are cut
there and in blocks, and the blocks of a range, sorted by their first keys, come to one task. It opens blocks as the merge
gets to them and merges the open ones by a tree of losers: each capture costs one comparison for every doubling of the runs, and
memory holds open blocks only, not the range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, shuffle_partitions, written

#: Payloads of fewer bytes are always written whole.
LEAST_PAYLOAD = 100
#: A task begins another archive beyond so many compressed bytes.
ARCHIVE_BYTES = 256 << 20
#: Captures of a block; captures that a range should have; ranges at most, and keys that are drawn for each.
BLOCK, PER_RANGE, MOST_RANGES, DRAWN = 512, 1 << 17, 1 << 16, 8
#: Fixed by the format.
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "url_key string, timestamp string, page_id string, url string, record_type string, payload_digest string, payload_bytes long, refers_to string, file string, offset long, length long"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def record_id(digest: str, page: Any) -> str:
    """The id of a response follows from its payload and page, so revisits can name it without having seen it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{digest}/{page}'.encode()).digest()[:16])}>"


def one_line(text: str | None) -> str:
    """A header's value: control characters and spaces become percent escapes."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


def record(page: Any, url: str | None, date: str, payload: bytes, digest: str, first: Any) -> bytes:
    """The bytes of a record: a response, or a revisit of page `first` without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    own = record_id(digest, page) if first is None else f"<urn:uuid:{uuid.uuid4()}>"
    head = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": own, "WARC-Date": date, "WARC-Target-URI": one_line(url), "WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    if first is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(digest, first), "X-Refers-To-Page": str(first)}
    if page is not None:
        head["X-Page"] = str(page)
    block = http + (payload if first is None else b"")
    head["Content-Length"] = str(len(block))
    return b"".join([VERSION.encode(), b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in head.items()), b"\r\n", block, b"\r\n\r\n"])


def headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    return first, {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


def members(stream: Any, chunk: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member."""
    rest, offset, more = b"", 0, True
    while True:
        decoder, parts, size = zlib.decompressobj(31), [], 0
        while not decoder.eof:
            if not rest and more:
                rest = stream.read(chunk)
                more = bool(rest)
            if not rest:
                break
            parts.append(decoder.decompress(rest))
            size += len(rest) - len(decoder.unused_data)
            rest = decoder.unused_data
        if not decoder.eof:
            if size:
                raise ValueError(f"an archive ends within the record at {offset}")
            return
        yield offset, size, b"".join(parts)
        offset += size


def url_key(url: str) -> str:
    """Host in reverse order of its labels, without www, then path and query: all captures of a host lie together."""
    rest = url.partition("://")[2] or url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].partition("#")[0]
    host = host.rpartition("@")[2].partition(":")[0].removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}){path or '/'}"


def capture(file: str, offset: int, length: int, content: bytes) -> tuple:
    """A row of CAPTURE; a response whose payload isn't that of its digest is an error."""
    head, _, rest = content.partition(b"\r\n\r\n")
    version, fields = headers(head)
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {offset} of {file}")
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].rpartition(":")[2]
    kind = fields["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload at {offset} of {file} isn't that of its digest")
    stamp = "".join(c for c in fields["warc-date"] if c.isdigit())[:14]
    url = fields["warc-target-uri"]
    size = int(headers(http)[1]["content-length"])
    return (url_key(url), stamp, fields.get("x-page"), url, kind, digest, size, fields.get("x-refers-to-page"), file, offset, length)


def first_of_payload(pages: DataFrame) -> DataFrame:
    """(digest, first): payloads that several pages have, and the smallest id."""
    found = pages.where(F.col("bytes") >= LEAST_PAYLOAD).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    return written(found.where("n > 1 and first is not null").select("digest", "first"), "warc-payloads")


def capture_time(page_id: Column) -> Column:
    """The table has no times: a second a page."""
    return F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.pmod(page_id, F.lit(100_000_000)), F.lit(0)))


def write_archives(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write a record for each row of `pages` (page_id, url, html); gives (file, records) of the archives.

    Null html is an empty payload, null url an empty one. Rows of equal payload and the smallest id are all responses; rows
    without an id come after all others, and are responses if no page with an id has their payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    stamp = captured if captured is not None else capture_time(F.col("page_id"))
    base = pages.select("page_id", "url", html.cast("binary").alias("payload"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes"), F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"))
    known = base.join(first_of_payload(base), "digest", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    fs, path = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        out, name, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "date", "payload", "digest", "first")), strict=True):
                if out is None:
                    name, records, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(*row)) + packer.flush()
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    archives = bounded_batches(known).mapInArrow(run, "file string, records long")
    return written(archives.withColumn("file", F.concat(F.lit(f"{folder}/"), F.col("file"))), "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """CAPTURE rows of the archives (file), each read from its beginning, record by record."""
    types = [pa.int64() if c.endswith("long") else pa.string() for c in CAPTURE.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(file)
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        rows.append(capture(file, *member))
                        if len(rows) == 4096:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    n = archives.count()
    return archives.select("file").repartition(max(1, n)).mapInArrow(run, CAPTURE)


# --- the merge ----------------------------------------------------------------------------------


class Block(NamedTuple):
    """Captures of a run in their order, with keys that compare."""

    keys: list[tuple]
    rows: list[tuple]


def sort_key(row: tuple) -> tuple:
    """URL key, time, page (by its text; none comes first), place in the archives."""
    return (row[0], row[1], row[2] is not None, row[2] or "", row[8], row[9])


class LoserTree:
    """The least of many sorted ways: a node keeps the loser of the match of its two halves, so that the next winner is found by the
    matches on one way to the root."""

    def __init__(self, ways: list[tuple[Block, int]]):
        self.ways, self.at = [w for w, _ in ways], [at for _, at in ways]
        n = self.n = len(ways)
        self.keys = [(0, *w.keys[at]) for w, at in ways]
        self.losers, winner = [0] * n, [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (b, a) if self.keys[b] < self.keys[a] else (a, b)
        self.winner = winner[1]

    def take(self) -> tuple:
        """The least row; its way moves on."""
        w = self.winner
        way, at = self.ways[w], self.at[w]
        self.at[w] = at + 1
        self.keys[w] = (0, *way.keys[at + 1]) if at + 1 < len(way.keys) else (1,)
        node = (w + self.n) // 2
        while node:
            other = self.losers[node]
            if self.keys[other] < self.keys[w]:
                self.losers[node], w = w, other
            node //= 2
        self.winner = w
        return way.rows[at]

    def least(self) -> tuple:
        return self.keys[self.winner]

    def open(self) -> list[tuple[Block, int]]:
        return [(w, at) for w, at in zip(self.ways, self.at, strict=True) if at < len(w.keys)]


def merge(blocks: Iterable[Block], fewest: int = 64) -> Iterator[tuple]:
    """Rows of all blocks in order; blocks come in order of their first keys. As many are opened at a time as are open already, so
    building trees costs no more than a few comparisons a block."""
    blocks = iter(blocks)
    ahead, open_ = next(blocks, None), []
    while ahead is not None or open_:
        room = max(fewest, len(open_))
        while ahead is not None and room:
            open_.append((ahead, 0))
            ahead, room = next(blocks, None), room - 1
        horizon = (0, *ahead.keys[0]) if ahead is not None else (1,)
        tree = LoserTree(open_)
        while tree.least() < horizon:
            yield tree.take()
        open_ = tree.open()


def cut_points(runs: DataFrame, n: int, ranges: int) -> list[tuple[str, str, str]]:
    """Keys at which the ranges begin, but for the first: evenly placed among some DRAWN keys for each. They only set how even the
    ranges are; the keys that come to the driver number DRAWN * MOST_RANGES or so at most."""
    step = max(1, n // (DRAWN * ranges))
    drawn = runs.where(F.pmod(F.xxhash64("file", "offset"), F.lit(step)) == 0).select("url_key", "timestamp", F.coalesce("page_id", F.lit("")).alias("page_id"))
    keys = sorted({tuple(r) for r in drawn.toLocalIterator()})
    return sorted({keys[k * len(keys) // ranges] for k in range(1, ranges)}) if keys else []


def blocks_of(batches: Iterable[pa.RecordBatch], cuts: list[tuple[str, str, str]]) -> Iterator[tuple[int, list[tuple]]]:
    """(range, rows) of the blocks of sorted rows: a block ends at a range's end, where a run ends, and at BLOCK rows."""
    held: list[tuple] = []
    at, last = 0, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = sort_key(row)
            plain = (row[0], row[1], row[2] or "")
            began = last is None or key < last
            if began:
                place = 0
            else:
                place = at
            while place < len(cuts) and plain >= cuts[place]:
                place += 1
            if held and (began or place != at or len(held) == BLOCK):
                yield at, held
                held = []
            at, last = place, key
            held.append(row)
    if held:
        yield at, held


def index(captures: DataFrame) -> DataFrame:
    """CAPTURE rows with `place`, their number (from 0) in the order of URL key, time and page over all archives."""
    spark = captures.sparkSession
    runs = written(captures.sortWithinPartitions("url_key", "timestamp", F.col("page_id").asc_nulls_first(), "file", "offset"), "capture-runs")
    n = runs.count()
    ranges = min(MOST_RANGES, max(shuffle_partitions(spark), -(-n // PER_RANGE)))
    cuts = cut_points(runs, n, ranges)
    fields = [pa.field(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in CAPTURE.split(", ")]
    nested = f"array<struct<{CAPTURE.replace(' ', ': ').replace(',: ', ', ')}>>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, rows in blocks_of(batches, cuts):
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], fields=fields)
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.ListArray.from_arrays([0, len(rows)], inner)], ["range", "captures"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def arrived() -> Iterator[tuple[int, Block]]:
            for batch in batches:
                for place, rows in zip(batch.column("range"), batch.column("captures"), strict=True):
                    plain = [tuple(r.values()) for r in rows.as_py()]
                    yield place.as_py(), Block([sort_key(r) for r in plain], plain)

        coming = arrived()
        ahead = next(coming, None)
        while ahead is not None:
            place = ahead[0]

            def of_range(place: int = place) -> Iterator[Block]:
                nonlocal ahead
                while ahead is not None and ahead[0] == place:
                    block, ahead = ahead[1], next(coming, None)
                    yield block

            rows, at = [], 0
            for row in merge(of_range()):
                rows.append((place, at, *row))
                at += 1
                if len(rows) == 4096:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), *(f.type for f in fields)], strict=True)], ["range", "at", *NAMES])

    blocks = bounded_batches(runs).select(NAMES).mapInArrow(cut, f"range int, captures {nested}")
    first = F.col("captures")[0]
    dealt = blocks.repartition(ranges, "range").sortWithinPartitions("range", first["url_key"], first["timestamp"], first["page_id"].asc_nulls_first(), first["file"], first["offset"])
    merged_rows = written(dealt.mapInArrow(merged, f"range int, at long, {CAPTURE}"), "capture-index")
    sizes = sorted((r["range"], r["n"]) for r in merged_rows.groupBy("range").agg(F.count("*").alias("n")).collect())  # a row a range
    before, total = [], 0
    for place, size in sizes:
        before.append((place, total))
        total += size
    starts = F.broadcast(spark.createDataFrame(before, "range int, before long"))
    return merged_rows.join(starts, "range").select((F.col("before") + F.col("at")).alias("place"), *NAMES)


def archive(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html; further columns are not looked at) as archives, read them back, and give their index: `place`
    and CAPTURE, page_id and refers_to of their own type. One row for each page, repeated ones too; an empty table gives no rows.
    Payloads of any length; ties in key, time and page are ordered by archive and offset."""
    kind = dict(pages.dtypes)["page_id"]
    found = index(read_archives(write_archives(pages, captured)))
    return found.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))
