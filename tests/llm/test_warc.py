import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rallyframe.llm import warc
from rallyframe.llm.common import table
from rallyframe.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string"


def plain(rows):
    """Contract's columns from (page_id, url, html)."""
    first = {}
    for page, _, html in rows:
        if page is not None and (html not in first or page < first[html]):
            first[html] = page
    for page, _, html in rows:
        raw = (html or "").encode()
        seen = first.get(html) if len(raw) >= 100 else None
        again = seen is not None and seen != page
        yield (page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", seen if again else None)


def odd_pages():
    long = "<p>" + "äö " * 400_000
    same, other = "copy " * 40, "x" * 100
    rows = [(i, f"http://www.Site{i % 3}.org/p/{i % 5}?q={i}#top", same) for i in range(30, 0, -1)]
    rows += [(100, None, None), (101, "no scheme", ""), (102, "http://a.b", "x" * 99), (103, "http://a.b", "x" * 99), (104, "http://a.b/", other), (104, "http://a.b/", other), (105, "http://a.b/\r\nx: y", other)]
    rows += [(None, "http://a.b/", other), (None, "http://u@h.example:80", "lonely " * 30), (None, None, "lonely " * 30), (7, "https://x.y/z", long), (8, "https://x.y/z", long), (9, "u", "WARC/1.1\r\n\r\n\x00" * 20)]
    return rows


def got(df):
    return sorted(map(tuple, df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_pages_come_back(spark):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("digest", "first", "payload", "bytes", "file", "range", "at", "place", "n")})
    assert got(warc.archive(pages)) == sorted(plain(rows), key=str)


def test_query_on_the_whole_table(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "pages").select("page_id", "url", "html").collect()]
    assert got(QUERIES["op12_warc"](spark, sf)) == sorted(plain(rows), key=str)


def test_index_is_in_order_over_all_archives(spark):
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['a', 'b', 'hot', 'hot', 'hot'])}.example/{rng.randrange(3)}", f"page {rng.randrange(200)} " * 20) for i in range(900)]
    pages = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = warc.archive(pages, F.timestamp_seconds(1_700_000_000 + F.col("page_id") % 13)).orderBy("place").collect()
    assert [r.place for r in found] == list(range(len(rows)))
    keys = [(r.url_key, r.timestamp, str(r.page_id)) for r in found]
    assert keys == sorted(keys) and len({r.file for r in found}) > 1
    assert found[0].url_key == "example,a)/0" and found[0].timestamp.startswith("2023")


def test_a_record_can_be_read_by_its_place(spark):
    rows = odd_pages()
    for r in warc.archive(spark.createDataFrame(rows, SCHEMA)).collect():
        with open(r.file.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            content = gzip.decompress(f.read(r.length))
        assert content.startswith(b"WARC/1.1\r\n") and content.endswith(b"\r\n\r\n")
        assert hashlib.sha256(content.partition(b"\r\n\r\n")[2].partition(b"\r\n\r\n")[2][:-4]).hexdigest() == (r.payload_digest if r.record_type == "response" else hashlib.sha256(b"").hexdigest())


def test_revisits_name_records_that_are_there(spark):
    pages = spark.createDataFrame(odd_pages(), SCHEMA)
    files = [r.file for r in warc.write_archives(pages).collect()]
    ids, named = set(), set()
    for file in files:
        with open(file.removeprefix("file:"), "rb") as f:
            for _, _, content in warc.members(f, 100):
                fields = warc.headers(content.partition(b"\r\n\r\n")[0])[1]
                ids.add(fields["warc-record-id"])
                named |= {fields["warc-refers-to"]} if "warc-refers-to" in fields else set()
    assert named and named <= ids


def test_damaged_archives_are_errors(tmp_path):
    whole = gzip.compress(warc.record(1, "u", "2020-01-01T00:00:00Z", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    (tmp_path / "a").write_bytes(whole + whole[:-9])
    with open(tmp_path / "a", "rb") as f, pytest.raises(ValueError, match="ends within"):
        list(warc.members(f))
    with pytest.raises(ValueError, match="digest"):
        warc.capture("f", 0, 1, gzip.decompress(whole).replace(b"payload\r", b"pAyload\r"))
    with pytest.raises(ValueError, match="no record"):
        warc.capture("f", 0, 1, b"HTTP/1.1 200 OK\r\n\r\n")


@pytest.mark.parametrize(("ways", "fewest"), [(1, 64), (2, 64), (3, 1), (40, 2), (257, 5)])
def test_merge_of_runs(ways, fewest):
    rng = random.Random(ways)
    blocks, rows = [], []
    for w in range(ways):
        run = list((f"k{rng.randrange(50):02}", "t", str(rng.randrange(9)) if rng.random() < 0.9 else None, *[""] * 5, f"f{w}", i, 0) for i in range(rng.randrange(1, 60))) if w % 5 else [("k07", "t", None, *[""] * 5, f"f{w}", 0, 0)]
        run.sort(key=warc.sort_key)
        rows += run
        size = rng.randrange(1, 9)
        blocks += [warc.Block([warc.sort_key(r) for r in run[i : i + size]], run[i : i + size]) for i in range(0, len(run), size)]
    blocks.sort(key=lambda b: b.keys[0])
    assert list(warc.merge(blocks, fewest)) == sorted(rows, key=warc.sort_key)


def test_runs_are_cut_in_blocks(monkeypatch):
    """At 7 rows, at the ranges' first keys, and where a run ends."""
    monkeypatch.setattr(warc, "BLOCK", 7)
    rng = random.Random(3)
    row = lambda key, page, i: (key, "t", page, *["x"] * 4, None, "f", i, 1)
    runs = [sorted((row(f"k{rng.randrange(30):02}", rng.choice([None, "1", "2"]), i) for i in range(80)), key=warc.sort_key) for _ in range(3)]
    rows = [r for run in runs for r in run]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], warc.NAMES)
    cuts = [("k05", "t", "1"), ("k11", "t", ""), ("k11", "t", "2"), ("k29", "u", "")]
    got = list(warc.blocks_of([batch.slice(0, 50), batch.slice(50)], cuts))
    assert [r for _, block in got for r in block] == rows
    for place, block in got:
        assert 0 < len(block) <= 7 and block == sorted(block, key=warc.sort_key)
        assert all(sum((r[0], r[1], r[2] or "") >= c for c in cuts) == place for r in block)
    assert {place for place, _ in got} == {0, 1, 2, 3}


def test_no_pages(spark):
    empty = warc.archive(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and dict(empty.dtypes)["refers_to"] == "bigint"
