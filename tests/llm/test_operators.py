"""Operators against brute force, and over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import collections
import gzip
import hashlib
import math
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import bpe, decontaminate, fingerprint, html, langid, license, lm, neardup, queries, tokencount, warc, wordblocks
from orrery.llm.components import components

EN = "the cat sat on the mat and looked at the old dog by the door while it rained all over the small town near the river"
DE = "der hund lief über die straße und sah die katze an der tür sitzen während es in der kleinen stadt am fluss regnete"
ROWS = [
    (1, EN, "en", "a", 1), (2, EN, "en", "a", 1), (2, EN, "en", "a", 1), (3, None, None, None, None), (4, "", "en", "a", 0), (5, " \n\t ", "de", "b", 4), (None, EN + " x", "en", "a", 1), (None, None, None, None, None),
    (6, DE, "de", "b", 1), (7, "A.", "en", "b", 2), (8, "<|endoftext|> Ünïcode x\x1cý é é \U0001f600 1234 don't ﬁ İ", None, "c", 9), (9, (EN + " ") * 3000, "en", "c", 1), (10, "12 34 !!", "de", "c", 8), (11, "Released under the MIT License.\n" + DE, "de", "a", 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = {"block": 1, "idx": 2, "word": "w", "class": "c", "bands": "x", "group": 3, "path": "p", "canon": "q", "bucket": 4, "html": "h", "score": 0.5, "mark": "m", "held_out": "z", "edits": "e", "licence": "l", "item": 1, "next_text": "n", "fingerprint": "f"}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({k: F.lit(v) for k, v in CLASH.items()}).repartition(3, "doc_id").cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary_of()


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_bpe(docs, none, small, vocabulary):
    t = bpe.tokenizer(vocabulary)
    for df in (docs, none, small):
        want = collections.Counter()
        for r in df.collect():
            ids = t.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        assert collections.Counter(map(tuple, bpe.digests(df, vocabulary).collect())) == want
    coded = bpe.encode(small, vocabulary)
    text = {r.doc_id: r.text for r in small.collect()}
    for r in bpe.decode(coded, vocabulary).collect():
        assert r.decoded == t.decode(t.encode(text[r.doc_id], add_special_tokens=False).ids, skip_special_tokens=False)


def test_blocks_in_another_order(spark):
    """The same block read with its documents in another order is an error, even where the counts agree."""
    rows = [(1, "a a b"), (2, "c d")]
    there, back = (spark.createDataFrame(r, "doc_id long, text string").coalesce(1) for r in (rows, rows[::-1]))
    ids = bpe.word_ids(wordblocks.word_packs(back), bpe.vocabulary_of())
    schema = "doc_id long, n_tokens long, ids array<int>"
    from pyspark.sql.types import _parse_datatype_string

    with pytest.raises(Exception, match="another order"):
        wordblocks.rejoined(wordblocks.payloads(there), ids, bpe._ids, _parse_datatype_string(schema), bpe._restored).collect()


def test_fingerprint_rows(spark, monkeypatch):
    """A row per document with its own group, whatever its id; also where different texts share a fingerprint."""
    rows = [(1, "a b c"), (2, "A  b c"), (2, "other words"), (2, "other words"), (None, "a b c"), (None, "q r s"), (None, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"canon": F.lit(1), "group_id": F.lit("g"), "n_copies": F.lit(2)})
    want = collections.Counter([(1, 1, 3), (2, 1, 3), (None, 1, 3), (2, 2, 2), (2, 2, 2), (None, None, 1), (None, 3, 2), (3, 3, 2)])
    got = fingerprint.edited_with_groups(docs)
    assert collections.Counter((r.doc_id, r.group_id, r.n_copies) for r in got.collect()) == want and fingerprint.edited_with_groups(docs.limit(0)).count() == 0
    monkeypatch.setattr(fingerprint, "hashed", lambda canon: F.lit("same"))
    assert collections.Counter((r.doc_id, r.group_id, r.n_copies) for r in fingerprint.edited_with_groups(docs).collect()) == want


def test_token_counts(docs, none, small, vocabulary):
    t = bpe.tokenizer(vocabulary)
    n = lambda s: len(t.encode(s, add_special_tokens=False).ids)
    edits = F.array(F.struct(F.lit(5).alias("start"), F.lit(900).alias("end"), F.lit("new wor").alias("replacement")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("end"), F.lit(None).cast("string").alias("replacement")))
    for df in (docs, none, small):
        want = collections.Counter()
        for r in df.collect():
            s = r.text or ""
            e = s[: min(5, len(s))] + "new wor" + s[900:]
            want[r.doc_id, n(s), n(e[2:])] += 1
        got = tokencount.counts(df, vocabulary, edits)
        assert collections.Counter((r.doc_id, r.n_tokens, r.edited_tokens) for r in got.collect()) == want
    assert all(r.bytes_encoded < 5000 for r in tokencount.counts(docs, vocabulary, edits).filter("doc_id = 9").collect())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies to make the site better for you.</div><div class="content"><article><h1>The &amp; title</h1><p>First <b>bold<br>text</b> of it &eacute; goes on and on.</p>
<div class="ad">Buy this now, it is cheap and good and new.</div><p>Second   one<a href="/x">with a link</a> here.<aside>Related things to read.</aside></article></div>
<section id="comments"><article><p>I think that this is a very good article and I read it all.</p></article></section><form><label>Mail</label><input><button>Go</button></form>
<div id="sidebar"><p>Some long text of a side bar that nobody should ever read at all.</p></div><footer>&copy; 2024 somebody</footer></body></html>"""


def test_main_text(spark):
    assert html.main_text(PAGE) == "The & title\n\nFirst bold text of it é goes on and on.\n\nSecond onewith a link here."
    rows = spark.createDataFrame([(1, "u", None, 7), (2, None, "", 7), (3, "v", PAGE, 7), (3, "v", PAGE, 7), (4, "w", "<p>cut <b", 7), (None, "x", "<nav", 7)], "page_id long, url string, html string, text int")
    got = html.extract(rows).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and html.extract(rows.limit(0)).count() == 0
    assert html.main_text("<div>" * 5000 + "x" * 10) is not None
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h\d)>", inner)]
        assert html.main_text(r.html) == "\n\n".join(p for p in parts if p)


PROSE = " ".join(["The quick brown fox jumps over the lazy dog and runs away from the old farm near the river bank."] * 3)


@pytest.mark.parametrize("page, want", [
    (f'<nav><a href="/">Home</a></nav><div class="overflow-hidden"><article><h1>A title</h1><p>{PROSE}</p></article></div>', ["A title", PROSE]),
    (f'<main aria-hidden="false"><p>{PROSE}</p></main>', [PROSE]),
    (f'<article><div class="elementor-widget-container"><p>{PROSE}</p><p>{PROSE}</p></div></article>', [PROSE, PROSE]),
    (f'<div class="layout sidebar-right"><div><h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p></div></div>', ["A title", PROSE, PROSE]),
    (f'<article title="a &quot; b><p>{PROSE}</p><p class="x">{PROSE}</p></article>', [PROSE, PROSE]),
    (f'<form id="aspnet"><div><a href="/">Home</a></div><div><h1>A title</h1><p>{PROSE}</p><p>{PROSE}</p></div></form>', ["A title", PROSE, PROSE]),
    (f'<ul><li><a href="/">Home</a><li><a href="/b">B</a></ul><h1>A title</h1><p>{PROSE}<p>{PROSE}<p><a href="/n">More of this</a>', ["A title", PROSE, PROSE]),
    (f'<article><p>{PROSE}</p><p hidden>{PROSE}</p><div style="display: none"><p>{PROSE}</p></div></article>', [PROSE]),
    (f'<div class="menu"><p>Home</p></div><div class="post"><p>{PROSE}</p><p>{PROSE}</p></div><div id="comments"><p>{PROSE}</p><p>I like it</p></div>', [PROSE, PROSE]),
])
def test_main_text_of_varied_markup(page, want):
    assert html.main_text(page) == "\n\n".join(want)


def test_tree_uses_link_density():
    used = set()

    def walk(node):
        if isinstance(node, tuple):
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(html.tree())
    assert 1 in used and used & {8, 10} and used & {0, 7, 9}  # own, neighbours' density, words
    x, y = html.labelled_rows(html.LABELLED, [(2, 1), (0.7, 0.8)])  # sizes that weren't trained on
    assert np.mean([html.is_content(r, html.tree()) == bool(c) for r, c in zip(x, y)]) > 0.93


def test_language_id(docs, none, spark):
    rows = {r.doc_id: r for r in langid.identify(docs).collect() if r.doc_id is not None}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == rows[10].lang_pred == "und" and rows[3].score == 0
    assert rows[1].lang_pred == "en" and rows[6].lang_pred == "de" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(none).count() == 0
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(big).filter("held_out").join(big.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got)


def test_suffix_automaton():
    rng = np.random.default_rng(1)
    ref = rng.integers(2, 6, 300).astype(np.uint8)
    moves, text = langid.automaton(ref.tolist()), rng.integers(2, 7, 256).astype(np.uint8)
    known, n, at = bytes(ref), 0, 0
    for k in range(len(text)):
        if bytes(text[at : k + 1]) not in known:
            n, at = n + 1, k if bytes(text[k : k + 1]) in known else k + 1
    assert langid.phrases(text.reshape(-1, 1), moves)[0] == n


def test_decontamination(spark, none):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    prose = lambda n: " ".join(rng.choice(words[:60], n))
    items = [" ".join(rng.choice(words, 30)) for _ in range(5)]
    edited = items[1].split()
    edited[4], edited[11] = "other", "changed"
    del edited[20]
    rows = [(1, prose(500)), (2, prose(200) + " " + items[0].upper().replace(" ", ", ") + ". " + prose(50)), (3, prose(20) + " " + " ".join(edited) + " " + prose(90)), (4, None), (5, ""), (6, items[0]), (None, items[2]), (7, " ".join(items[3].split()[:8]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"item": F.lit(1), "score": F.lit("s"), "passage": F.lit("p")})
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (92, "two words"), (93, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(2, 0), (2, 93), (3, 1), (6, 0), (6, 93), (None, 2)}
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("copies", [1, 5, 50, 1000])
@pytest.mark.parametrize("kind", ["every tenth word", "first part"])
def test_decontamination_of_repeated_edits(spark, kind, copies):
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    items = [list(rng.choice(words, n)) for n in (30, 40, 59)]
    passages = [[f"new{k}" if k % 10 == 9 else w for k, w in enumerate(x)] if kind == "every tenth word" else x[: len(x) * 6 // 10] for x in items]
    texts = [" ".join([*rng.choice(words[:60], 50), *p, *rng.choice(words[:60], 50)]) for p in passages]
    docs = spark.createDataFrame([(3 * k + i, t) for k in range(copies) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(3 * k + i, i) for k in range(copies) for i in range(3)}


def test_alignment():
    def plain(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best / (2 * len(a))

    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = ([b"%d" % x for x in rng.integers(0, 5, n)] for n in rng.integers(1, 25, 2))
        assert decontaminate.aligned(a, b)[0] == plain(a, b)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    got = warc.derivatives(warc.responses_of(pages))
    rows = got.collect()
    assert len(rows) == 8 and warc.derivatives(warc.responses_of(pages.limit(0))).count() == 0
    for r in rows:
        assert r.block_digest == warc.digest(r.block.encode()) and r.content_length == len(r.block.encode()) and r.refers_to.startswith("<urn:uuid:")
    first = {r.record_type: r for r in rows if r.key == 1}
    assert first["metadata"].source_digest == warc.digest(PAGE.encode()) and "outlink: /b" in first["metadata"].block and "First bold text" in first["conversion"].block and "var a" not in first["conversion"].block
    data = b"".join(bytes(r.data) for r in warc.serialised(got).filter("key = 1").collect())
    back = {h["warc-type"]: (h, block.decode()) for h, block in warc.parsed(data)}
    assert back["conversion"][1] == first["conversion"].block and back["metadata"][0]["warc-refers-to"] == first["metadata"].refers_to
    with pytest.raises(ValueError):
        list(warc.parsed(gzip.decompress(data)[:300]))


def test_warc_file(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-A: b\r\n\r\n<p>Hi</p>"
    (tmp_path / "a.warc.gz").write_bytes(warc.record_bytes([("WARC-Type", "warcinfo")], b"x") + warc.record_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), ("WARC-Target-URI", "http://a"), ("WARC-Payload-Digest", "sha1:Z")], block))
    rows = {r.record_type: r for r in warc.derivatives(warc.read_responses(spark, str(tmp_path))).collect()}
    assert rows["conversion"].block == "Hi" and rows["metadata"].refers_to == "<urn:1>" and rows["metadata"].source_digest == "sha1:Z" and "header-X-A: b" in rows["metadata"].block


def test_warc_codings_and_bad_records(spark, tmp_path):
    import zstandard

    body = ("<p>Grüße " + "x " * 5000 + "</p>").encode()
    packed = gzip.compress(body)
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(c), c) for c in (packed[:7], packed[7:])) + b"0\r\n\r\n"
    sent = {"plain": ("", body), "gzip": ("Content-Encoding: gzip\r\n", packed), "both": ("Content-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n", chunked), "deflate": ("Content-Encoding: deflate\r\n", zlib.compress(body)[2:-4]), "zstd": ("Content-Encoding: zstd\r\n", zstandard.compress(body)), "bad": ("Content-Encoding: gzip\r\n", b"no gzip")}
    records = [warc.record_bytes([("WARC-Type", "response"), ("WARC-Target-URI", k)], f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{h}\r\n".encode() + data) for k, (h, data) in sent.items()]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(records))
    (tmp_path / "b.warc.gz").write_bytes(records[0] + records[1][:-20])
    (tmp_path / "c.warc").write_bytes(b"WARC/1.1\r\nContent-Length: many\r\n\r\n")
    got = warc.derivatives(warc.read_responses(spark, str(tmp_path)).withColumn("block", F.lit(1))).collect()
    text = html.main_text(body.decode())
    rows = collections.Counter((r.target_uri, r.block == text) for r in got if r.record_type == "conversion")
    assert rows == {("plain", True): 2, **{(k, True): 1 for k in ("gzip", "both", "deflate", "zstd")}, ("bad", False): 1}
    assert len({r.key for r in got}) == 7 and [r.target_uri for r in got if r.record_type == "metadata" and "payloadError" in r.block] == ["bad"]
    errors = {r.path.rsplit("/", 1)[1]: r.n_records for r in warc.read_errors(spark, str(tmp_path)).collect()}
    assert errors == {"b.warc.gz": 1, "c.warc": 0}


def test_warc_against_brute_force(spark):
    """The derivatives of every small page, from the page alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r for r in pages.collect()}
    rows = warc.derivatives(warc.responses_of(pages)).collect()
    assert len(rows) == 2 * len(source)
    for r in rows:
        page = source[r.key]
        assert r.target_uri == page.url and r.source_digest == "sha1:" + base64.b32encode(hashlib.sha1(page.html.encode()).digest()).decode()
        if r.record_type == "metadata":
            assert [x[9:] for x in r.block.split("\r\n") if x.startswith("outlink: ")] == re.findall(r'<a href="([^"]*)"', page.html)
        else:
            body = re.sub(r"<!--.*?-->|<script>.*?</script>", "", page.html.split("</head>")[1], flags=re.S)
            spaced = re.sub(r"</?(?:br|p|li|h1|div|ul|nav|article|footer|body|html)\b[^>]*>", " ", body)
            assert r.block.split() == html.html.unescape(re.sub(r"</?[ab]\b[^>]*>", "", spaced)).split()


def test_lm(docs, none, spark):
    for df in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        source = [(r.doc_id, (r.text or "").encode().lower().split() + [None]) for r in df.collect()]
        test = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = collections.Counter(w for i, ws in source if not test(i) for w in ws)
        n, v = sum(c.values()), len(c)
        want = collections.Counter((i, test(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for i, ws in source)
        rows = lm.score(df).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want
        assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.9 * sum(r.base_score for r in out)
    assert lm.score(none).count() == 0
    assert all(math.isfinite(r.score) for r in lm.score(docs.filter("doc_id = 6"), 1, 0).collect())


def test_lm_is_a_distribution():
    s = lm.Symbols({}, {}, np.array([3.0, 5, 9, 4]), np.array([0.0, 1, 0, 0]), 21, 4, 3)
    tree = lm.Tree(s)
    tree.grow(np.array([2, 2, 3]), np.array([0, 3, 2]), np.array([2, 7, 4]))
    tree.deepen(np.array([2 * 4 + 3, 3 * 4 + 2]), np.array([7, 4]))
    tree.grow(np.array([1]), np.array([1]), np.array([4]))
    assert len(tree.parent) == 4 and tree.parent[3] == tree.own[0][2]
    for state in range(4):
        assert tree.probability(np.full(4, state), np.arange(4)).sum() == pytest.approx(1)


def brute_lm(source):
    """log10 of each text's probability by the model's definition, on tuples of symbols. source: (words, trains)."""
    words = collections.Counter(w for ws, trains in source if trains for w in ws)
    n_end = sum(trains for _, trains in source)
    n = sum(words.values()) + n_end
    often, frequent, stored = (max(low, math.ceil(f * n ** (2 / 3))) for f, low in ((lm.SYMBOL, 1), (lm.CONTEXT, 2), (lm.PAIR, 1)))
    rare = collections.Counter()
    for w, c in words.items():
        if c < often:
            rare[w[-2:]] += c

    def symbol(w):
        return ("word", w) if words[w] >= often else ("end of word", w[-2:]) if rare[w[-2:]] >= often else ("other",)

    texts = [([symbol(w) for w in ws] + [("end",)], trains) for ws, trains in source]
    count, kinds = collections.Counter({("other",): 0, ("end",): 0}), collections.Counter()
    for xs, trains in texts:
        count.update(xs if trains else [])
    for w in words:
        kinds[symbol(w)] += words[w] > 0
    after = collections.defaultdict(collections.Counter)
    for xs, trains in texts:
        for k, x in enumerate(xs if trains else []):
            before = [("end",), *xs[:k]]
            for d in range(1, min(lm.DEPTH, len(before)) + 1):
                after[tuple(before[-d:])][x] += 1
    all_ = sum(c + 0.5 for c in count.values())
    state = {}

    def probability(ctx, x):
        while ctx and ctx not in state:
            ctx = ctx[1:]
        if not ctx:
            return (count[x] + 0.5) / all_
        own, left = state[ctx]
        return own.get(x, 0.0) + left * probability(ctx[1:], x)

    total = lambda ctx: count[ctx[0]] if len(ctx) == 1 else after[ctx[:-1]][ctx[-1]]
    for ctx in sorted(after, key=len):
        held = {x: c for x, c in after[ctx].items() if c >= stored}
        if total(ctx) < frequent or not held or any(total(ctx[:k]) < frequent for k in range(1, len(ctx))):
            continue
        size = total(ctx) + len(held)
        own = {x: c / size for x, c in held.items()}
        left = 1 - sum(own.values())
        gain = sum(c * math.log((own[x] + left * probability(ctx[1:], x)) / probability(ctx[1:], x)) for x, c in held.items()) + (total(ctx) - sum(held.values())) * math.log(left)
        if gain >= lm.DIVERGENCE * len(held):
            state[ctx] = own, left
    out = []
    for (ws, _), (xs, _) in zip(source, texts):
        score = 0.0
        for k, x in enumerate(xs):
            score += math.log10(probability(tuple([("end",), *xs[:k]][-lm.DEPTH :]), x))
            if x[0] in ("end of word", "other") and count[x]:
                c = words[ws[k]]
                score += math.log10(max(c - 0.5, 0.5) / count[x] if c else 0.5 * kinds[x] / count[x])
        out.append(score)
    return out, state


@pytest.mark.parametrize("symbol", [0.08, 0.01])
def test_lm_score_against_brute_force(spark, small, monkeypatch, symbol):
    monkeypatch.setattr(lm, "SYMBOL", symbol)
    monkeypatch.setattr(lm, "CONTEXT", 0.003)
    rng = np.random.default_rng(2)
    chain = " ".join(f"a{k % 3} b{(k * k) % 5}" for k in range(900))
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(10_000 + k, " ".join(chain.split()[k : k + 60])) for k in range(50)] + [(20_000, None), (20_001, "unseen wörds")]
    test = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    want, state = brute_lm([((t or "").encode().lower().split(), not test(i)) for i, t in rows])
    assert max(map(len, state)) >= 3
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == pytest.approx(w, rel=1e-9, abs=1e-6) for (i, _), w in zip(rows, want, strict=True))


def test_lm_grows_with_the_corpus():
    """Bounds on symbols, contexts and pairs rise with the training tokens."""
    for factor in (lm.SYMBOL, lm.CONTEXT, lm.PAIR):
        bounds = [n / lm.least(factor, n) for n in (10**6, 10**8, 10**10, 10**13)]
        assert all(b > 2 * a for a, b in zip(bounds, bounds[1:]))


def brute_components(rows, width):
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()))
    top = list(range(len(sets)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (_, x) in enumerate(sets):
        for b, (_, y) in enumerate(sets[:a]):
            if x and y and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min((v for v in (least.get(find(k)), i) if v is not None), default=None)
    return collections.Counter((i, len(s), least[find(k)], least[find(k)] is None or least[find(k)] == i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, none, spark, width):
    rng = np.random.default_rng(width)
    base = rng.integers(0, 500, 120).tolist()
    rows = []
    for k in range(150):  # a cloud of copies whose links go round several corners
        words = list(base)
        for p in rng.integers(0, 120, rng.integers(0, 9)):
            words[p] = int(rng.integers(500, 900))
        rows.append((k, " ".join(map(str, words))))
    cloud = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, cloud):
        got = collections.Counter(map(tuple, neardup.near_duplicates(df, width).collect()))
        assert got == brute_components([(r.doc_id, r.text) for r in df.collect()], width)
    assert neardup.near_duplicates(none, width).count() == 0


@pytest.mark.parametrize("centres", [1, 5])
def test_near_duplicates_round_corners(spark, monkeypatch, centres):
    """Sets that share most of a template without being links, next to chains of links, in small chunks."""
    monkeypatch.setattr(neardup, "CHUNK", 4)
    monkeypatch.setattr(neardup, "CENTRES", centres)
    rng = np.random.default_rng(9)
    base, rows = rng.integers(0, 500, 100).tolist(), []
    for k in range(160):
        words = list(base)
        for p in rng.integers(0, 100, rng.integers(0, 8 if k % 2 else 14)):
            words[p] = int(rng.integers(500, 900))
        rows.append((None if k % 37 == 5 else k, " ".join(map(str, words))))
    got = collections.Counter(map(tuple, neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()))
    assert got == brute_components(rows, 2)
    assert len({c for _, _, c, _ in got}) > 20


def test_stars_over_tasks():
    """Pieces that go on in the next task, or are given out in parts, keep their key."""
    rows = [(1, 10, 5), (1, 10, 3), (1, 11, 9), (1, 20, 4), (2, 5, 8), (2, 5, 7), (2, 6, 1), (3, 5, 2), (4, 5, 6), (4, 5, 11)]
    batches = [pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in part], pa.int64()) for i, k in enumerate(("key", "n", "node"))}) for part in (rows[:2], rows[2:6], rows[6:])]
    flat = lambda most: [tuple(r.values()) for b in neardup._stars(iter(batches), 0.8, most) for r in b.to_pylist()]
    assert flat(100) == [(3, 5, 1), (3, 3, 1), (3, 9, 1), (1, 8, None), (1, 7, None), (6, 6, 4), (6, 11, 4)]
    assert {(a, b) for a, b, key in flat(2) if key} >= {(3, 5), (3, 3), (9, 9), (7, 8), (7, 7), (1, 1)}


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 200: 100}


def test_licenses(docs, none, spark):
    rows = [(1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/d/x.py", "no header"), (3, "a/y.py", "# Released under the MIT License.\n" + "some code " * 9), (4, "a/z.py", "x"), (5, "a/b/c/w.py", None), (6, None, "y"), (7, "top.txt", ""), (1, "a/b/LICENSE", "Licensed under the Apache License, Version 2.0.")]
    files = spark.createDataFrame(rows, "doc_id long, file string, text string").withColumns({"path": F.lit(1), "licence": F.lit("l"), "sentence": F.lit("s"), "dir": F.lit("d")})
    got = sorted(((r.doc_id, r.own_licence, r.licence, r.inherited_from) for r in license.scan(files, F.col("file")).collect()), key=str)
    assert got == [(1, "Apache-2.0", "Apache-2.0", None)] * 2 + [(2, None, "Apache-2.0", "a/b"), (3, "MIT", "MIT", None), (4, None, None, None), (5, None, "Apache-2.0", "a/b"), (6, None, None, None), (7, None, None, None)]
    assert license.scan(docs, F.col("source")).count() == len(ROWS) and license.scan(none, F.col("source")).count() == 0


def test_licence_headers_and_files(spark):
    gpl = "# This file is part of Foo.\n#\n# Foo is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\n" + "some = code(here)\n" * 30
    mit = "Copyright (c) 2021 Jane Doe. All rights reserved.\n\n" + "\n\n".join(license._MIT)
    bsd = "Copyright (c) 2020, Foo Authors\nAll rights reserved.\n\n" + license._BSD[0].replace(": ", ":\n\n1. ") + "\n\n3. " + license._BSD[1] + "\n\n" + license._BSD[2]
    want = {
        "// SPDX-License-Identifier: MIT\nint main() {}": "MIT", "# SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later", "/* SPDX-License-Identifier: EUPL-1.2 OR MIT */": "EUPL-1.2 OR MIT",
        "This file is part of Foo and is released under the MIT License by its authors.": "MIT", "Copyright (c) 2021 Jane Doe. All rights reserved.": "Proprietary", gpl: "GPL-3.0", mit: "MIT", bsd: "BSD-3-Clause",
        "The committee met under the bridge and the file of the version was released.": None, "He has a driving licence for the free use of any car.": None, "Mit.": None,
    }
    files = spark.createDataFrame([(k, f"d{k}/x", t) for k, t in enumerate(want)], "doc_id long, file string, text string")
    assert {r.doc_id: r.own_licence for r in license.scan(files, F.col("file")).collect()} == dict(enumerate(want.values()))


def test_licence_cosine(spark):
    idf, unit, other = license.vectors(license.TEMPLATES)
    idf, text = dict(idf), "This file is licensed under the MIT License, all rights reserved"
    bag = collections.Counter(re.findall("[a-z0-9]+", text.lower()))
    norm = math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in bag.items()))
    dots = collections.Counter()
    for term, k, name, w in unit:
        dots[k, name] += bag[term] * idf[term] * w / norm
    best = max((round(v, 9), name) for (_, name), v in dots.items())
    assert tuple(license.best_templates(spark.createDataFrame([(text,)], "sentence string"), min_cosine=0).first()[1:]) == best[::-1]


def canon(s):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", s).lower()).strip(" ")


def print_of(s):
    data = canon(s).encode()
    return "%016x%016x" % (xxhash.xxh64_intdigest(data, seed=42), xxhash.xxh64_intdigest(data, seed=xxhash.xxh64_intdigest((1).to_bytes(4, "little"), seed=42)))


def test_fingerprints(none, small, spark):
    rows = [(5, "Ａb  c"), (4, "ab\nC"), (9, None), (2, ""), (7, "xyzxyz"), (-3, "q" * 50), (1, "\U0001f600éé")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("b")), small):
        text = {r.doc_id: r.text or "" for r in df.collect()}
        ids = sorted(text, reverse=True)
        for r in fingerprint.edited_digests(df).collect():
            s, after = text[r.doc_id], text[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
            third = len(s) // 3
            edited = s[: len(s) - third] + after[:third]
            assert tuple(r)[1:] == (len(s), hashlib.sha256(edited.encode()).hexdigest(), print_of(s), print_of(edited), float(canon(s) == canon(edited)), float(canon(s) == canon(after)))
        groups = {r.doc_id: (r.group_id, r.n_copies) for r in fingerprint.exact_groups(df).collect()}
        for i, s in text.items():
            same = [j for j, t in text.items() if canon(t) == canon(s)]
            assert groups[i] == (min(same), len(same))
    assert fingerprint.edited_digests(none).count() == 0 and fingerprint.exact_groups(none).count() == 0


def test_fingerprints_of_many_ranges(docs, spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 3)
    ids = [k * k for k in range(40)]
    df = spark.createDataFrame([(k, f"text {k}") for k in ids], "doc_id long, text string").repartition(5)
    after = {r.doc_id: r.next_text for r in fingerprint.with_next(df).collect()}
    assert after == {k: f"text {ids[n - 1]}" for n, k in enumerate(ids)}
    assert fingerprint.edited_digests(docs).count() == len(ROWS)


def test_colliding_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "hashed", lambda c: F.lit("same"))
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A ")], "doc_id long, text string")
    assert {r.doc_id: (r.group_id, r.n_copies) for r in fingerprint.exact_groups(df).collect()} == {1: (1, 2), 2: (2, 1), 3: (1, 2)}


def test_near_duplicate_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op8_near_duplicates"]).fetchall())
    assert sorted(map(tuple, queries.op8_near_duplicates(spark, "/root/testdata/sf0.001").collect())) == want


def test_pipeline(spark, vocabulary):
    sf, t = "/root/testdata/sf0.001", bpe.tokenizer(bpe.vocabulary_of())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(c.isalpha() for c in r.text or "")]
    keep = {i for i, _, _, kept in brute_components(rows, 5) if kept}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {}
    for i, text in rows:
        words = decontaminate.words_of(text)
        near = [x for x in items if set(zip(x, x[1:], x[2:])) & set(zip(words, words[1:], words[2:]))]
        if i in keep and not any(decontaminate.aligned(x, words)[0] >= decontaminate.MIN_SCORE for x in near):
            want[i] = len(t.encode(text, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()} == want
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_pipeline_stages_on_odd_rows(spark):
    """Null and repeated ids, an empty table, and columns with the stages' own names."""
    sf = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(1, EN, "en"), (None, EN, "en"), (2, EN + " and so on", "en"), (2, DE, "de"), (2, None, "en"), (None, "12 34", "en"), (None, item, "en"), (3, item + " " + DE, "de"), (3, DE + " " + EN, "de"), (3, DE + " " + EN, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"row": F.lit(7), "row_": F.lit("x"), "gone": F.lit(1), "digest": F.lit("k"), "group": F.lit(2), "k0": F.lit(5), "lang_pred": F.lit("und")})
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: collections.Counter((r.doc_id, r.text) for r in df.collect())
    lettered = stages["language ID"](spark, docs, sf)
    assert lettered.columns == docs.columns and texts(lettered) == collections.Counter((i, t) for i, t, _ in rows if t and t != "12 34")
    single = stages["MinHash near-dedup"](spark, lettered, sf)
    assert single.columns == docs.columns and texts(single) == collections.Counter({(1, EN): 1, (2, DE): 1, (None, item): 1, (3, item + " " + DE): 1, (3, DE + " " + EN): 1})
    clean = stages["benchmark decontamination"](spark, single, sf)
    assert clean.columns == docs.columns and texts(clean) == collections.Counter({(1, EN): 1, (2, DE): 1, (3, DE + " " + EN): 1})
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_language_of_foreign_texts(docs, spark):
    """Long texts that no reference helps to parse are foreign; labelled prose isn't."""
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "".join(chr(0x4E00 + (k * k * 7919) % 20000) for k in range(900)), None)], "doc_id long, text string, lang string")
    got = langid.identify(big.union(odd), carry=["lang"]).filter("foreign").collect()
    assert [r.doc_id for r in got] == [-1]
