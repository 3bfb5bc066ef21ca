import collections
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from rallyframe.llm import mixing, packing, url_filters

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def plain_verdict(url):
    at = (url or "").find("://")
    if at < 0:
        return "", "", None, "allow"
    host = re.match(r"[^/?#]*", url[at + 3 :])[0]
    path = re.match(r"[^?#]*", url[at + 3 + len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    rule = max(fits, key=len, default=None)
    return host, path, rule, RULES[rule] if rule else "allow"


def test_urls_against_plain(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?q#f", "https://example.com/en/8", "ftp://notexample.net/de/8", "x://b.example.net/de/81/#", "http://org/es/", "http://org?x/es/", "http://x.org/es", "http://example.net/de/9", "HTTP://É.com/en/ü", "http://example.com/en/7" + "y" * 50_000, "http://" + "a." * 100_000 + "example.net/de/8", "http://" + "." * 50_000 + "com/en/", "http://.com/en/", "http://com./en/"]
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, host string, verdict string")
    got = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls + urls[:3])}
    assert url_filters.judge(pages.limit(0)).count() == 0
    rules = spark.createDataFrame(url_filters.RULES, "verdict string, host string, path string")
    dealt = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge_dealt(pages, rules).collect()}
    assert dealt == got


def test_equal_digests_are_told_apart():
    digest = lambda k: len(k)
    array = url_filters.DigestArray.mapped(url_filters.DigestArray.pack(["aa", "bb", "ccc", "bb"], digest))
    assert [array.key(i) if i >= 0 else None for i in array.find([b"bb", b"aa", b"zz", b"ccc", b""], digest)] == [b"bb", b"aa", None, b"ccc", None]
    empty = url_filters.DigestArray.mapped(url_filters.DigestArray.pack([]))
    assert list(empty.find([b"x"])) == [-1]


def test_mixture_reaches_targets(spark, odd_docs, no_docs):
    rows = [(i, " ".join(["w"] * (1 + (i * 7919) % 97)), "en", f"s{i % 5}" if i % 11 else None, 0) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix(docs.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size = {r.doc_id: len(t.split()) for r, t in zip(sorted(got, key=lambda r: r.doc_id), [r[1] for r in rows], strict=True)}
    taken = collections.Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.taken % r.size == 0 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, target in {(r.source, r.target) for r in got}:
        assert abs(taken[source] - target) <= 0.01 * target + 200
    emitted = mixing.emit(mixing.mix(docs)).count()
    assert emitted == sum(r.taken // r.size for r in got)
    assert mixing.mix(odd_docs).count() == 10 and mixing.mix(no_docs).count() == 0


def test_targets_share_out_the_excess(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), (None, 985)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weights, left, open_ = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2], strict=True)), 3000.0, {"a": 10, "b": 1000, "c": 1000, "d": 5, None: 985}
    want = {}
    while True:
        total = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / total > 3 * open_[s]]
        if not over:
            want |= {s: left * weights[s] / total for s in open_}
            break
        for s in over:
            want[s] = 3.0 * open_.pop(s)
        left = 3000.0 - sum(want.values())
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(3000)


def check_packed(rows, docs, capacity):
    import public_tokenizers
    import zlib
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for doc_id, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % capacity or min(len(ids), capacity)
        at = [0, *range(first, len(ids), capacity), len(ids)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            want[doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for content in bins.values():
        end = 0
        for offset, length in sorted(content):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, texts, odd_docs, no_docs):
    docs = [(i, t) for i, t in enumerate(texts(400, words=400) + texts(300, seed=1, words=12))] + [(900, "<|endoftext|> x"), (901, None), (902, "")]
    docs += [(903, " " * 1_000_000), (904, "a" + "\n" * 1_000_000 + "<|endoftext|>\t<|endoftext|>b"), (905, "q" * 100_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    used, least = check_packed(packing.pack(frame).collect(), docs, 1024)
    assert used <= least * 1.03 + 2
    odd = odd_docs.select("doc_id", "text").collect()
    check_packed(packing.pack(odd_docs).collect(), [tuple(r) for r in odd], 1024)
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("text", [("x" + " " * 5_000) * 200, ("y" + "\n" * 19_999) * 50, " " * 19_999 + "a" + "\t" * 20_000])
def test_white_space_takes_linear_time(text):
    encode = packing.encoder(packing.vocabulary())
    began = time.process_time()
    packing._LONG_SPACE.search(text)
    assert time.process_time() - began < 0.2
    assert encode(text[:60_000]) == encode.plain.encode(text[:60_000], add_special_tokens=False).ids


def test_mixture_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), f"s{i % 3}") for i in range(50)], "doc_id long, text string, source string")
    clash = ("_mix_source", "_mix_class", "_mix_copy", "_n", "_SIZE", "kept__mix_source")
    odd = docs.withColumns({c: F.lit("clash") for c in clash})
    plain = {tuple(r) for r in mixing.mix(docs).select("doc_id", "taken").collect()}
    got = mixing.mix(odd)
    assert {tuple(r) for r in got.select("doc_id", "taken").collect()} == plain
    assert all(r[c] == "clash" for r in mixing.emit(got).collect() for c in clash) and mixing.emit(got).count() == mixing.emit(mixing.mix(docs)).count()


def test_plan_fills_slots():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 1024, 5000), minlength=1025)
    plan = packing.plan_large(counts, 1024)
    lengths = np.repeat(np.arange(1025), counts)
    rank = np.concatenate([np.arange(n) for n in counts])
    large = lengths > 128
    where = packing.place_large(plan, lengths[large], rank[large])
    load = np.bincount(where, weights=lengths[large])
    assert load.max() <= 1024 and where.min() >= 0 and where.max() < plan.sequences
