import collections
import hashlib
import html as html_
import math
import random
import re

import numpy as np
import pytest
from rallyframe.llm import common, fingerprints, html_extraction, lm_scoring, near_dedup, quality_classifier, quality_rules, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_words_of_slices(spark):
    import pyarrow as pa

    texts = ["a bb  ccc", None, "", "\n", "x", " é ü\tß", "A" * 70000, "end\x0b\x0c\rof"]
    words = common.Words(*common.raw_text(pa.array(texts)))
    got = [[bytes(words.data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    assert got == [WORD.findall(lower(t or "")) for t in texts]
    by_word = collections.defaultdict(set)
    for w, h in zip([w for g in got for w in g], words.hash, strict=True):
        by_word[w].add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len({*map(min, by_word.values())}) == len(by_word)
    assert sum(b.num_rows for b in common.slices([pa.record_batch({"text": pa.array(texts)})], "text", 10)) == len(texts)


def plain_measures(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, texts, odd_docs, no_docs):
    body = texts(120)
    rows = [(i, t + "\nShared  LINE of everyone\n" + ("the rest " * (i % 3)), "en", f"s{i % 2}", 0) for i, t in enumerate(body)]
    rows += [(1000 + i, "shared line of everyone\nfew", "en", "s0", 0) for i in range(3)]
    rows += [(2000 + i, body[0] + "\n" + body[1], "en", "s0", 0) for i in range(90)]  # copies count once
    docs = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in quality_rules.judge(docs, most=20, share=0.0).collect()}
    for doc_id, text, *_ in rows:
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_measures(text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        shared = sum(len(WORD.findall(x)) for x in text.split("\n") if WORD.findall(lower(x)) == ["shared", "line", "of", "everyone"])
        assert r.boilerplate_words == shared
        left = r.n_words - shared
        assert r.kept == (not r.base_failed and left >= 10 and left >= 0.2 * r.n_words)
    odd = quality_rules.judge(odd_docs).collect()
    assert len(odd) == 10 and collections.Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in odd) == collections.Counter(plain_measures(r.text) for r in odd_docs.collect())
    assert quality_rules.judge(no_docs).count() == 0


def test_long_shared_line_is_boilerplate(spark):
    notice = " ".join(f"notice{k}" for k in range(80))
    rows = [(i, f"{notice}\nown words of page {i} " + "and more of its own " * 2, "en", "s", 0) for i in range(30)]
    rows += [(100 + i, notice + "\nthe same page crawled many times over and over again", "en", "t", 0) for i in range(30)]
    got = quality_rules.judge(spark.createDataFrame(rows, DOC), most=20, share=0.0).collect()
    assert {r.doc_id: r.boilerplate_words for r in got} == {r[0]: 80 if r[3] == "s" else 0 for r in rows}
    assert {r.doc_id for r in got if r.kept} == {r[0] for r in rows if r[3] == "t"}


def test_limit_is_the_same_at_every_size(spark):
    """A line in 30 documents: of a host of 60, and of one of 4,000."""
    rows = [(i, f"own words {i} of a page " * 2 + "\nfollow us everywhere", "en", "small", 0) for i in range(30)]
    rows += [(100 + i, f"other page {i}", "en", "small", 0) for i in range(30)]
    rows += [(1000 + i, f"some page {i}" + "\nall rights reserved" * (i < 30), "en", "large", 0) for i in range(4000)]
    rows += [(9000 + i, f"yet another page {i}\nas often as is allowed", "en", "large", 0) for i in range(quality_rules.LINE_DOCUMENTS)]
    got = quality_rules.judge(spark.createDataFrame(rows, DOC)).where("boilerplate_words > 0").collect()
    assert {r.doc_id: r.boilerplate_words for r in got} == {i + k: 3 for i in range(30) for k in (0, 1000)}


def plain_components(docs, percent=85):
    sets = {}
    for i, text in docs:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_near_duplicates(spark, odd_docs, no_docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = random.Random(3)
    docs = []
    for base in range(12):
        words = [f"t{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 150, 400]))]
        for _ in range(rng.choice([1, 3, 25])):
            w = list(words)
            for _ in range(int(len(w) * rng.choice([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05]))):
                w[rng.randrange(len(w))] = f"t{rng.randrange(400)}"
            docs.append((len(docs) * 3 + 1, " ".join(w).title() if rng.random() < 0.2 else " ".join(w)))
    docs += [(9001, None), (9002, ""), (9003, "\n ")]
    rng.shuffle(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_components(docs)
    odd = near_dedup.cluster(odd_docs).collect()
    assert len(odd) == 10 and {(r.doc_id, r.component_id, r.kept) for r in odd} == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (5, 1, False), (6, 6, True), (7, 7, True)}
    assert near_dedup.cluster(no_docs).count() == 0


def test_id_with_several_texts(spark):
    """One id whose texts are near copies of different documents links these; a popular id is the pivot of many."""
    words = [[f"a{k}w{i}" for i in range(200)] for k in range(3)]
    docs = [(1, " ".join(words[0])), (1, " ".join(words[1])), (5, " ".join(words[0] + ["more"])), (6, " ".join(words[1][1:])), (7, " ".join(words[2]))]
    docs += [(10 + i, " ".join([*words[0], f"end{i}"])) for i in range(60)] + [(100 + i, " ".join([f"begin{i}", *words[2]])) for i in range(60)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(i, 7 if i == 7 or i >= 100 else 1) for i, _ in docs}


def test_long_texts_are_hashed_in_parts(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["", "one two  three " * 40, None, "x" * 300, " \n a b", "ÄÖ " + "word" * 50 + " end"])
    whole, bounds = common.word_hashes(texts)
    monkeypatch.setattr(common, "LONG_TEXT", 16)
    parts, again = common.word_hashes(texts)
    assert (whole == parts).all() and (bounds == again).all() and len(whole) == 126


def test_sketches_estimate():
    rng = np.random.default_rng(1)
    for share in (0.75, 0.85, 0.95):
        errors = []
        for n in (60, 400, 3000):
            pool = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            keep = int(2 * n * share / (1 + share))
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[n - keep : n], pool[n : 2 * n - keep]]))
            rows = [np.frombuffer(near_dedup.signature(s)[1], np.uint64) for s in (a, b)]
            errors.append(float(near_dedup.estimates(*rows)) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert max(map(abs, errors)) < 0.06


@pytest.mark.parametrize("percent", [85, 80])
def test_sketches_keep_links_of_any_length(percent):
    """At the limit the estimate's distance from where candidates begin is MARGIN times its spread, for each size of set."""
    rng = np.random.default_rng(percent)
    assert (1 - (percent / 100) ** near_dedup.ROWS) ** near_dedup.bands_for(percent) < 1e-6
    for n in (30, 150, 700, 5000):
        both, found, look = -(-2 * n * percent // (100 + percent)), [], []
        for _ in range(800):
            x = rng.integers(0, 1 << 64, 2 * n - both, dtype=np.uint64)
            rows = [np.frombuffer(near_dedup.sketch_of(np.sort(part)), np.uint64) for part in (x[:n], x[n - both :])]
            found.append(float(near_dedup.estimates(*rows)))
            look.append(float(near_dedup.look_from(*rows, percent)))
        assert (np.array(found) > look).all() and np.std(found) * near_dedup.MARGIN < (percent / 100 - np.mean(look)) * 1.25


def test_near_duplicates_at_another_limit(spark):
    """Pairs of texts of 5,000 runs with 4,445 in common, the least that makes a link at 80 of 100."""
    docs = []
    for k in range(24):
        words = [f"p{k}w{i}" for i in range(5004)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:4449] + [f"q{k}w{i}" for i in range(555)]))]
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string"), percent=80).collect()}
    assert got == {i: i - i % 2 for i, _ in docs}


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300)]
    got = {r.id: r.component for r in near_dedup.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def plain_fingerprint(text):
    """Byte by byte: a rolling sum of the last seven bytes' values ends chunks; a chunk's character is of its own hash."""
    raw, m = text.encode(), (1 << 64) - 1
    mix = lambda x: int(common.mix64(np.array([x & m], np.uint64))[0])
    value, lag = [int(x) for x in common._BYTE], [int(x) for x in fingerprints._LAG]
    block = 3
    while block * 64 < len(raw):
        block *= 2

    def triggers():
        for i in range(len(raw)):
            yield mix(sum(value[raw[i - k]] * lag[k] for k in range(min(7, i + 1)))) >> 32

    rolling = list(triggers())

    def signature(size):
        out, chunk = "", b""
        for byte, r in zip(raw, rolling, strict=True):
            chunk += bytes([byte])
            if r % size == size - 1:
                out, chunk = out + character(chunk), b""
        return out + (character(chunk) if chunk else "")

    def character(chunk):
        total, power = 0, 1
        for byte in chunk:
            total, power = total + value[byte] * power, power * common._BASE & m
        return chr(fingerprints.ALPHABET[mix(total + len(chunk)) >> 58])

    while block > 3 and sum(r % block == block - 1 for r in rolling) + 1 < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(one, other):
    """Edit distance by the table, without the bit tricks."""
    if one == other:
        return 1.0
    (a, *of_a), (b, *of_b) = one.split(":"), other.split(":")
    by_size = [{int(size) * (k + 1): s for k, s in enumerate(x)} for size, x in ((a, of_a), (b, of_b))]
    best = 0.0
    for size in by_size[0].keys() & by_size[1].keys():
        x, y = (re.sub(r"(.)\1{3,}", lambda m: m[1] * 3, d[size]) for d in by_size)
        run = min(7, len(x), len(y), max(2, min(len(x), len(y)) // 4))
        if x and y and any(x[i : i + run] in y for i in range(len(x) - run + 1)):
            distance = len(x) + len(y) - 2 * plain_lcs(x, y)
            best = max(best, 1 - distance / (len(x) + len(y)))
    return best


def check_fingerprints(spark, docs, order):
    """`order`: the rows as they follow one another."""
    got = {(r.doc_id, r.edited_sha256): r for r in fingerprints.compare_neighbours(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    near, next_ = [], []
    for (doc_id, text), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id, hashlib.sha256(edited.encode()).hexdigest()]
        assert r.n_chars == len(text)
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(text), plain_fingerprint(edited))
        assert r.near_edited == pytest.approx(plain_likeness(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(plain_likeness(r.fingerprint, plain_fingerprint(after)))
        if len(text) > 200:
            near.append(r.near_edited)
            next_.append(r.near_next)
    return near, next_


def test_fingerprints(spark, texts, odd_docs, no_docs):
    rng = random.Random(0)
    for _ in range(50):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(40))) for _ in range(2))
        assert fingerprints.common_subsequence(a, b) == plain_lcs(a, b)
    docs = [(i * 5, t) for i, t in enumerate(texts(60, words=300))] + [(7, None), (11, "short"), (13, "short"), (17, "z" * 3000), (19, "é" * 500 + "a b " * 200)]
    near, next_ = check_fingerprints(spark, docs, sorted(docs, reverse=True))
    assert np.mean(near) > 0.35 and np.mean(next_) < 0.05
    assert fingerprints.compare_neighbours(odd_docs).count() == 10 and fingerprints.compare_neighbours(no_docs).count() == 0
    alone = fingerprints.compare_neighbours(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert alone[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


def test_fingerprints_of_hot_ids(spark, texts):
    """Most rows without an id, and many of one id: these are split, and each row still meets the next one."""
    some = texts(240, seed=9, words=25)
    docs = [(i, t) for i, t in enumerate(some[:30])] + [(17, t) for t in some[30:90]] + [(None, t) for t in some[90:]]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    from pyspark.sql import functions as F

    hashed = [(r.doc_id, r.h, r.text) for r in frame.select("doc_id", F.xxhash64("text").alias("h"), "text").collect()]
    order = sorted(hashed, key=lambda r: (-1 if r[0] is None else r[0], r[1]), reverse=True)
    check_fingerprints(spark, docs, [(i, t) for i, _, t in order])
    ranges = fingerprints.Ranges([-5, -5, -5, 2, 9, 9, 9, 9])
    rng = np.random.default_rng(0)
    ids, hashes = rng.choice([-9, -5, -5, 0, 2, 3, 9, 9, 9, 11], 3000), rng.integers(-(1 << 63), 1 << 63, 3000)
    by_order = np.lexsort((hashes, ids))
    part = ranges.part(ids, hashes)[by_order]
    assert (np.diff(part) >= 0).all() and len(np.unique(part[ids[by_order] == 9])) == 4 and len(np.unique(part)) == 9


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style><script>if (a < b) "</p>"</script></head><body class="home-12"><nav><a href="/x">menu</a></nav>
<div class="cookie notice">We use cookies</div><header>Site</header><article><h1>A &amp; B</h1><p>One <b>bold</b>face &copy;<br>two<p>Three<ul><li>i<li>j</ul><aside>side</aside>
<div class="ad">buy</div><form>send <input></form><div class="comments"><p>first!</p></div><table><tr><td>c1<td>c2</table></article><footer>end</footer></body></html>"""


def test_extraction(spark, no_docs):
    assert html_extraction.main_text(PAGE, "html>body.home->article") == "A & B One boldface © two Three i j c1 c2"
    pages = [(i, f"http://h{i % 3}.example/{i}", PAGE.replace("Three", f"Three {i} &lt;x&gt; " + "words and words " * i)) for i in range(30)]
    pages += [(100, None, None), (101, "nohost", ""), (102, "http://h0.example/", "plain & simple"), (103, "http://h0.example/", "<p>unclosed <div>x" + "<b>deep " * 50)]
    rows = [(*p, "clash", "clash", "clash") for p in pages]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, path string, host string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extraction.extract(frame).collect()}
    for i in range(30):
        want = " ".join(f"A & B One boldface © two Three {i} <x> {'words and words ' * i} i j c1 c2".split())
        assert got[i] == (want, len(want))
    assert got[100] == got[101] == ("", 0) and got[102][0] == "plain & simple" and got[103][0].startswith("xdeep deep")
    assert html_extraction.extract(frame.limit(0)).count() == 0
    assert html_.unescape("&copy;") == "©"


STORY = "The river rose in the night &amp; nobody slept. <em>Water</em> came to the door, and we carried what we could."
LAYOUTS = {
    "table": f"<html><body><table class=frame><tr><td class=menu><a href=/a>home</a> <a href=/b>more</a><td class=body><p>{STORY}<p>Second part of it.</table><div id=footer>imprint</div>",
    "sections": f"<body><div role=banner>Name</div><main><section class='text s1'><h2>One</h2>{STORY}</section><section class='text s2'>Second part of it.</section></main><section class=comments>me too</section>",
    "divs": f"<BODY><DIV CLASS=wrap7><DIV ID=nav-top><UL><LI><A HREF=http://x.example/>all</A></UL></DIV><DIV CLASS=post-12>{STORY}<BR/>Second part of it.</DIV><DIV CLASS=related>see also</DIV></DIV>",
    "broken": f"<div class=\"post><p>lost\"><p title='a > b' data-id=menu>{STORY}</i></span><p class=\"x>Second part of it.</p></div><script>var a = '</p>';</script  ><aside>no</aside>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(spark, name):
    pages = [(i, f"http://{name}.example/{i}", LAYOUTS[name].replace("Second", f"Second{i}")) for i in range(5)]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    story = "The river rose in the night & nobody slept. Water came to the door, and we carried what we could."
    head = {"sections": "One "}.get(name, "")
    assert got == {i: f"{head}{story} Second{i} part of it." for i in range(5)}


@pytest.mark.parametrize(
    "page",
    ['<a "' * 262_144, "<div>" * 100_000 + "x", "<span>" * 100_000 + "</div>" * 100_000 + "y", "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000 + "z", "<" * 1_000_000, "</" * 500_000,
     "<script>" + "</script " * 200_000, "<style>" + "</style\t" * 200_000 + "<p>x", "<!--" * 250_000, "&#" + "9" * 100_000 + ";", "<a b='" * 150_000, "<p>" * 100_000 + "q"],
    ids=lambda p: p[:8],
)
def test_malformed_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html_extraction.main_text(page, "body>div")
    assert time.process_time() - began < 5


@pytest.mark.parametrize(("page", "text"), [
    ('<div><p>First part.<p>second <b class="x', "First part. second"), ("<p>kept</p><!doctype", "kept"), ("<p>kept</p></p class=x", "kept"), ("<p>a < b and 1 <2</p>", "a < b and 1 <2"),
    ("<p>kept</p><script>var a", "kept"), ("<p>one<script>x</script ><p>two", "one two"), ("<p>kept <!-- gone", "kept"), ("<p>5 <", "5 <"),
])
def test_unfinished_markup_is_no_text(page, text):
    layout = html_extraction.Layout(page)
    assert layout.text_inside("") == text


def test_votes_decide_against_a_page_of_its_own_mind(spark):
    """A page with a box that is longer than its article is read by its host's path."""
    own = "<div class=box>" + "<p>A long aside of this page alone, with many words. </p>" * 5 + "</div>"
    page = lambda i: f"<body>{own if i == 0 else ''}<article class=post><p>Story number{i} is short but told in the usual place.</p></article></body>"
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", page(i)) for i in range(4)], "page_id long, url string, html string")
    assert html_extraction.best(page(0))[0] != html_extraction.best(page(1))[0]
    got = {r.page_id: r.text for r in html_extraction.extract(pages).collect()}
    assert got == {i: f"Story number{i} is short but told in the usual place." for i in range(4)}


def plain_katz(train, texts):
    """The model from its definition, with dictionaries; checks that all of p(. | u v) sums to one."""
    end = object()
    lists = [[*WORD.findall(lower(t or "")), end] for t in train]
    counts = [collections.Counter(), collections.Counter(), collections.Counter()]
    for x in lists:
        before = [end, *x[:-1]]
        counts[0].update(x)
        counts[1].update(zip(before, x, strict=True))
        counts[2].update(zip(before[:-1], x[:-1], x[1:], strict=True))
    factors = [lm_scoring.discounts(collections.Counter(c.values())) for c in counts]
    k = lm_scoring.GOOD_TURING
    value = lambda order, r: r * factors[order][r] if r <= k else r - k * (1 - factors[order][k])
    n = sum(counts[0].values())
    p1 = {w: value(0, r) / n for w, r in counts[0].items()}
    unseen = 1 - sum(p1.values()) if n else 1.0
    after = collections.defaultdict(dict)
    for order in (1, 2):
        for gram, r in counts[order].items():
            after[gram[:-1]][gram[-1]] = r

    def p(w, history):
        if not history:
            return p1.get(w, unseen)
        seen = after.get(history)
        if not seen:
            return p(w, history[1:])
        total = sum(seen.values())
        if w in seen:
            return value(len(history), seen[w]) / total
        if history not in alphas:
            taken = 1 - sum(value(len(history), r) for r in seen.values()) / total
            alphas[history] = taken / (1 - sum(p(x, history[1:]) for x in seen))
        return alphas[history] * p(w, history[1:])

    alphas, out = {}, []
    for t in texts:
        x = [*WORD.findall(lower(t or "")), end]
        logs = [math.log10(p(w, (end,) if i == 0 else (x[i - 2] if i > 1 else end, x[i - 1]))) for i, w in enumerate(x)]
        out.append((len(x), sum(w in counts[0] for w in x), sum(math.log10((counts[0][w] + 1) / (n + len(counts[0]) + 1)) for w in x), sum(logs)))
    pairs = sorted(counts[1], key=lambda g: (counts[1][g], str(g)))
    some = [g for g in pairs if g[1] is not end]
    for v in [(end,), *some[:4], *some[-4:], *(g[1:] for g in some[:4])]:  # rare and frequent histories
        assert abs(sum(p(w, v) for w in counts[0]) + p("never seen", v) - 1) < 1e-9
    return n, out


def check_scores(spark, docs, **sizes):
    import zlib

    got = {r.doc_id: r for r in lm_scoring.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), **sizes).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    n, want = plain_katz([t for i, t in docs if not held[i]], [t for _, t in docs])
    for (i, _), (tokens, known, base, score) in zip(docs, want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], tokens, known, n)
        assert r.base_score == pytest.approx(base, abs=1e-7)
        assert r.score == pytest.approx(score, abs=1e-7)


@pytest.mark.parametrize("size", [1 << 20, 600])
def test_language_model(spark, texts, size):
    docs = [(i, t) for i, t in enumerate(texts(150, words=60, vocabulary=20) + [None, "", "unheard of words", "MIXED Case ba1 Ba1", "ba1 " * 300, " \n"])]
    check_scores(spark, docs, block_bytes=size, shard_bytes=size)


def test_language_model_of_many_rare_words(spark):
    """90,000 different words, most of them seen once, and pairs of a rare history with a rare word that repeat."""
    rng = random.Random(2)
    docs = []
    for i in range(300):
        own = [f"x{i}y{k}" for k in range(300)]
        docs.append((2 * i, " ".join(w for k in range(0, 300, 3) for w in (*own[k : k + 3], "the", own[rng.randrange(300)], own[k]))))
        docs.append((2 * i + 1, " ".join([*own[:60], "the", own[7], "new", own[8]])))
    check_scores(spark, docs, block_bytes=200_000)


def test_language_model_odd(spark, odd_docs, no_docs):
    assert lm_scoring.score(odd_docs).count() == 10
    assert lm_scoring.score(no_docs).count() == 0


def test_packed_arrays():
    rng = np.random.default_rng(0)
    for kind in (np.uint32, np.uint64):
        a = np.sort(rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind))
        assert (lm_scoring.expand_sorted(lm_scoring.squeeze_sorted(a), kind) == a).all() and (lm_scoring.expand(lm_scoring.squeeze(a), kind) == a).all()
    assert len(lm_scoring.expand_sorted(b"", np.uint32)) == 0


def rated(spark, n=300):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["river", "stone", "cloud", "green", "walks", "under"]) + rng.choice(["", "s", "ed"]) for _ in range(60))
    docs, labels = [], []
    for i in range(n):
        quality, toxic = int(i % 3 > 0), int(i % 3 == 1)
        text = good()
        if not quality:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " you utter nincompoop and dunderhead " + good()
        docs.append((i, text, "en", "s", 0))
        labels.append((i, quality, toxic))
    return spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, odd_docs, no_docs):
    docs, labels = rated(spark)
    judged = quality_classifier.judge(docs, labels).join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in judged]) > 0.97
    by = collections.defaultdict(list)
    for r in judged:
        by[r.quality * (2 - r.toxic)].append(r.expected_grade)
        assert 0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1
    assert np.mean(by[0]) < np.mean(by[1]) < np.mean(by[2])
    assert quality_classifier.judge(odd_docs, labels).count() == 10 and quality_classifier.judge(no_docs, labels).count() == 0
    assert quality_classifier.judge(odd_docs, labels.limit(0)).where("kept").count() == 10


def test_ordinal_fit_is_the_optimum():
    """The slope of the plain objective, by differences, is nearly nothing where the fit ends, and steep elsewhere."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    latent = x @ np.array([2.0, -1.0, 0.5, 0.0]) + rng.logistic(size=300)
    y = np.digitize(latent, [-1.0, 1.5])
    weight = rng.uniform(0.5, 2.0, 300)
    ridge = 1e-3

    def objective(w, thresholds):
        total = 0.0
        for row, grade, k in zip(x, y, weight / weight.sum(), strict=True):
            at_most = [1 / (1 + math.exp(float(row @ w) - t)) for t in thresholds]
            total -= k * math.log(([*at_most, 1.0][grade]) - ([0.0, *at_most][grade]))
        return total + ridge / 2 * float(w @ w)

    def slope(w, thresholds):
        both, n = np.concatenate([w, thresholds]).astype(float), len(w)
        step = np.eye(len(both)) * 1e-5
        return np.array([(objective((both + s)[:n], (both + s)[n:]) - objective((both - s)[:n], (both - s)[n:])) / 2e-5 for s in step])

    w, thresholds = quality_classifier.fit(x, y, weight, steps=3000, rate=0.01, ridge=ridge)
    assert thresholds[0] < thresholds[1]
    assert np.abs(slope(w, thresholds)).max() < 3e-3 < np.abs(slope(w * 0, thresholds)).max() / 10
    grade = sum(1 / (1 + np.exp(t - x @ w)) for t in thresholds)
    assert np.corrcoef(grade, y)[0, 1] > 0.7


def test_held_out_labels_do_not_matter(spark):
    docs, labels = rated(spark)
    from pyspark.sql import functions as F

    other = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality_classifier.train(docs, x) for x in (labels.unionByName(labels), other))
    assert np.allclose(one[0], two[0]) and np.allclose(one[1], two[1])


def test_classifier_look_up_equals_matrix():
    import pyarrow as pa

    data, offsets = common.raw_text(pa.array(["abc def abc", None, "x", "", "yyyy zz", "ab"]))
    w = np.random.default_rng(0).normal(size=(1 << quality_classifier.BITS) + quality_classifier.EXTRA)
    assert np.allclose(quality_classifier.features(data, offsets) @ w, quality_classifier.scores(w, data, offsets), atol=1e-4)


def test_toxicity(spark, odd_docs, no_docs):
    docs, labels = rated(spark)
    judged = toxicity.judge(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in judged if r.held_out]
    assert len(held) > 30 and np.mean([r.predicted == r.toxic for r in held]) > 0.95
    odd = toxicity.judge(odd_docs, labels).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert toxicity.judge(no_docs, labels).count() == 0
    assert toxicity.judge(odd_docs, labels.limit(0)).where("predicted = 1").count() == 0


def test_toxicity_scores_by_hand(spark):
    """Every window compressed anew with both dictionaries, without memory of earlier ones."""
    import zstandard

    docs, labels = rated(spark, 120)
    model = toxicity.fit(docs, labels)
    cut = [re.findall(r"\w+", t.lower()) for t in ("", "You UTTER nincompoop, and dunderhead 12!", "river stone " * 40, "mooncalf nincompoops")]
    scorer = toxicity.Scorer(model)

    def size(content, raw):
        parameters = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, source_size=64, dict_size=len(content), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        known = zstandard.ZstdCompressionDict(content + toxicity.FRAME.encode("utf-16-le"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=known, compression_params=parameters).compress(raw))

    for words in cut:
        saved = [size(model.ordinary, toxicity.framed(w)) - size(model.toxic, toxicity.framed(w)) for w in words]
        counts = [sum(s >= t for s in saved) for t in toxicity.THRESHOLDS]
        x = [*(math.log1p(c) for c in counts), *(math.log1p(1000 * c / max(1, len(words))) for c in counts), 1.0]
        assert scorer.score(" ".join(words)) == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model.weights)))))
        assert (scorer.score(" ".join(words)) >= 0.3) == ("nincompoop" in " ".join(words))


def test_toxicity_learns_from_long_texts(spark):
    docs, labels = rated(spark, 150)
    from pyspark.sql import functions as F

    longer = docs.withColumn("text", F.concat("text", F.repeat(F.lit(" river stone cloud green"), 2000)))
    judged = toxicity.judge(longer, labels).join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.toxic for r in judged if r.held_out]) > 0.9


def test_buckets_of_unlike_texts_get_longer_bands(spark, monkeypatch):
    """Texts that share half of their words fill common buckets; links among them are found by longer bands."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    levels, longer = [], near_dedup.longer_bands
    monkeypatch.setattr(near_dedup, "longer_bands", lambda docs, ids, percent, rows: levels.append((rows, ids.count())) or longer(docs, ids, percent, rows))
    same = " ".join(f"s{i}" for i in range(74))
    docs = [(i, f"{same} " + " ".join(f"d{i}w{k}" for k in range(50))) for i in range(1500)]
    docs += [(5000 + i, f"{t} end{i}") for i, t in docs[::50]]
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i - 5000 if i >= 5000 else i for i, _ in docs}
    assert levels[0][0] == 10 and levels[0][1] > 500


def test_bands_of_all_levels_hold_links():
    for percent in (80, 85):
        for rows in near_dedup.LEVELS:
            assert (1 - (percent / 100) ** rows) ** near_dedup.bands_for(percent, rows) < 1e-6
    rng = np.random.default_rng(5)
    for rows in near_dedup.LEVELS:
        shared = 0
        for _ in range(40):
            x = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            a, b = np.sort(x[:1850]), np.sort(x[150:])
            shared += len(np.intersect1d(near_dedup.band_keys(a, 85, rows), near_dedup.band_keys(b, 85, rows)))
        expected = 40 * near_dedup.bands_for(85, rows) * (1700 / 2000) ** rows
        assert abs(shared - expected) < 6 * np.sqrt(expected)
