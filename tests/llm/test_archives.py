"""WARC archives, media columns and HTML extraction."""

import base64
import functools
import gzip
import hashlib
import io
import itertools
import json
import random
import struct
import time
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstead.llm import html, media, queries, warc

PAGES = "page_id long, url string, html string, payload int, digest string, host string, text string"


def pages_of(spark, rows):
    return spark.createDataFrame([(k, u, h, 1, "x", "y", "z") for k, u, h in rows], PAGES)


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", "é漢\r\n\r\nWARC/1.1 x" * 5000), (6, "http://b/ 6", "<p>same</p>"), (7, "u", "p"), (7, "u", "p")]
    pages, folder = pages_of(spark, rows).repartition(3), tmp_path.as_uri()
    index = warc.write_archive(pages, folder)
    assert index.count() == len(rows)
    got = warc.read_records(index, folder, with_payload=True, block=100, gap=10)
    found = sorted((int(r["id"]), r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got.collect())
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    last = {}
    for k, _, h in rows:
        last[h or ""] = max(k, last.get(h or "", k))
    assert found == sorted((k, "response" if last[h or ""] == k else "revisit", None if last[h or ""] == k else str(last[h or ""]), len((h or "").encode()), digest(h)) for k, _, h in rows)
    whole = {int(r["id"]): bytes(r["payload"]).decode() for r in warc.payloads(got).collect()}
    assert whole == {k: h or "" for k, _, h in rows}
    some = warc.read_records(index.where("id in ('2', '5')"), folder)
    assert sorted(r["id"] for r in some.collect()) == ["2", "5"]
    archive = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "archive").iterdir())
    assert archive.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows)


def test_columns_of_any_name(spark, tmp_path):
    pages = pages_of(spark, [(1, "http://a/1", "x")]).withColumnRenamed("html", "the.html").withColumnRenamed("page_id", "page id")
    index = warc.write_archive(pages, tmp_path.as_uri(), "page id", "url", "the.html")
    assert [r["payload_bytes"] for r in warc.read_records(index, tmp_path.as_uri()).collect()] == [1]


def test_small_payloads_are_all_responses(spark, tmp_path):
    index = warc.write_archive(pages_of(spark, [(1, "a", "x"), (2, "b", "x")]), tmp_path.as_uri(), least_bytes=2)
    assert {r["record_type"] for r in index.collect()} == {"response"}


def test_empty_archive(spark, tmp_path):
    index = warc.write_archive(pages_of(spark, [(1, "a", "x")]).limit(0), tmp_path.as_uri())
    assert warc.read_records(index, tmp_path.as_uri()).count() == 0


def test_damage_is_found():
    raw = warc.record("response", "1", "u", b"payload", warc.digest_of(b"payload"), 7, None)
    assert warc.parsed(raw)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parsed(gzip.compress(gzip.decompress(raw).replace(b"payload\r\n\r\n", b"Payload\r\n\r\n")))
    with pytest.raises(ValueError):
        warc.parsed(b"no record")


def test_warc_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r["page_id"], r["html"] or "") for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    got = {r["page_id"]: r for r in queries.op2_warc(spark, d).collect()}
    assert len(got) == len(rows)
    for k, h in rows:
        response = max(p for p, x in rows if x == h)
        assert (got[k]["record_type"], got[k]["refers_to"]) == (("response", None) if k == response else ("revisit", response))
        assert got[k]["payload_bytes"] == len(h.encode())


def bmp(samples: np.ndarray) -> bytes:
    high, wide = samples.shape[:2]
    rows = samples[::-1, :, ::-1].reshape(high, -1)
    stride = (wide * 3 + 3) // 4 * 4
    body = np.pad(rows, [(0, 0), (0, stride - wide * 3)]).tobytes()
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, wide, high, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_decoders():
    r = np.random.default_rng(1)
    grey, colour = r.integers(0, 256, (5, 7), dtype=np.uint8), r.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode(media.pgm(grey)) == grey).all()
    assert (media.decode(b"P6\n# c\n3 4\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode(b"P2 7 5 255 " + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P1\n2 2\n1 0\n0 1") == np.array([[0, 255], [255, 0]])).all()
    assert (media.decode(b"P4\n9 1\n" + bytes([0b10000000, 0])) == [[0, *[255] * 8]]).all()
    assert (media.decode(bmp(colour)) == colour).all()
    for bad in (b"", b"P5", b"P5\n9 9\n255\n12", b"BMxx", b"GIF89a"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_the_exact_mean():
    image = np.random.default_rng(2).integers(0, 256, (6, 9)).astype(float)
    fine = np.kron(image, np.ones((4, 2)))  # 24 x 18 cells, which 8 x 9 divides
    assert np.allclose(media.resized(image, 8, 9), fine.reshape(8, 3, 9, 2).mean((1, 3)))
    assert np.allclose(media.resized(image, 6, 9), image)


def test_tiles_round_trip():
    image = np.random.default_rng(3).integers(0, 256, (50, 31), dtype=np.uint8)
    tiles = media.from_npy(media.npy(media.tiled(image)))
    assert tiles.shape == (6, 24, 24) and (media.untiled(tiles, 50, 31) == image).all()
    assert media.difference_hash(np.tile(np.arange(90), (80, 1))) == "f" * 16
    assert media.difference_hash(np.zeros((3, 3))) == "0" * 16


def test_media_column(spark):
    rows = [(1, media.pgm(np.zeros((3, 4), np.uint8))), (2, b"junk"), (3, None)]
    got = {r["doc_id"]: r for r in media.media_tiles(spark.createDataFrame(rows, "doc_id long, m binary"), "m").collect()}
    assert (got[1]["height"], got[1]["width"]) == (3, 4) and got[2]["tiles"] is None and got[3]["tiles"] is None
    table = spark.createDataFrame([(1, None, None, None)], "doc_id long, height int, width int, tiles binary")
    assert media.stored_features(table, carry=("height", "width")).first()["feature"] is None


def test_text_media(spark):
    cases = [(1, "abc", "x"), (2, None, "x"), (3, "", "x"), (4, "é" * 288, "x"), (5, "z" * 577, "x"), (6, "abc", "y")]
    df = spark.createDataFrame(cases, "doc_id long, text string, tiles string")
    got = {r["doc_id"]: r for r in media.stored_features(media.text_tiles(df)).collect()}
    for k, text, _ in cases:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert got[k]["n_bytes"] == len(raw)
        assert (got[k]["payload_bytes"], got[k]["payload_sha256"], got[k]["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert {c: v for c, v in got[1].asDict().items() if c != "doc_id"} == {c: v for c, v in got[6].asDict().items() if c != "doc_id"}
    assert media.stored_features(media.text_tiles(df.limit(0))).count() == 0


def test_media_query(spark):
    """Every column of the query from the texts alone, the difference hash by means over exact areas."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in queries.op3_media(spark, d).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        image = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        tiles = np.stack([image[k : k + 24] for k in range(0, len(image), 24)])
        stored = io.BytesIO()
        np.save(stored, tiles)
        high = len(image)
        rows = np.stack([sum((min(k + 1, (j + 1) * high / 8) - max(k, j * high / 8)) * image[k].astype(float) for k in range(high) if min(k + 1, (j + 1) * high / 8) > max(k, j * high / 8)) for j in range(8)]) / (high / 8)
        small = np.stack([sum((min(k + 1, (j + 1) * 24 / 9) - max(k, j * 24 / 9)) * rows[:, k] for k in range(24) if min(k + 1, (j + 1) * 24 / 9) > max(k, j * 24 / 9)) for j in range(9)], 1) / (24 / 9)
        small = small.round(6)
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored.getvalue()), hashlib.sha256(stored.getvalue()).hexdigest())
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == want
        assert r["feature"] == np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


ARTICLE = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";x(1)</script></head><body><header>Top</header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- c --><div class="ad">Buy</div><article><h1>Head &amp; line</h1><p><b>One.<br><p>Two\n  three &lt;x&gt;.</p><aside>See also</aside><form><p>Name</p></form><div class="comments"><p>First!</p></div></article><footer>&copy; x</footer>'


def test_article_is_extracted(spark):
    rows = [(1, "http://h/1", ARTICLE), (2, "http://h/2", None), (3, None, ""), (4, "http://h/4", "no tags"), (5, "x", ARTICLE), (1, "http://h/1", ARTICLE)]
    got = [(r["page_id"], r["text"]) for r in html.extract(pages_of(spark, rows)).collect()]
    text = "Head & line One. Two three <x>."
    assert sorted(got) == [(1, text), (1, text), (2, ""), (3, ""), (4, "no tags"), (5, text)]
    assert html.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_wrappers_by_join_are_the_same(spark):
    rows = [(k, f"http://h{k % 3}/{k}", ARTICLE.replace("One", f"One {k}")) for k in range(9)]
    few, many = (sorted((r["page_id"], r["text"]) for r in html.extract(pages_of(spark, rows), most_bytes=m).collect()) for m in (1 << 20, 0))
    assert few == many and few[4][1] == "Head & line One 4. Two three <x>."


def by_wrapper(pages: list[str], join=html.align) -> tuple[str, list[str]]:
    """Wrapper and texts of one host's pages, in plain Python."""
    own = html.Pages()
    streams = sorted({json.dumps(own.stream(p)[1][:2]) for p in pages})
    wrapper = json.dumps(functools.reduce(join, map(json.loads, streams)))
    slots = defaultdict(list)
    for p in pages:
        got = own.slotted(p, wrapper)
        for slot in {s for s, _, _ in got}:
            mine = [(t, n) for s, t, n in got if s == slot]
            slots[slot].append((tuple(" ".join(t.split()) for t, _ in mine), sum(len(t) for t, _ in mine), sum(n for _, n in mine), tuple((s, t) for s, t, _ in got)))
    figures = {s: (sum(x[1] for x in v), sum(x[2] for x in v), len({x[0] for x in v}) == 1, len({x[3] for x in v})) for s, v in slots.items()}
    content = set(html.content_slots(json.loads(wrapper)[0], figures))
    fixed = {s for s, f in figures.items() if f[2] and f[3] >= 3}
    return html.regex_of(json.loads(wrapper)), [own.main_text(p, wrapper, content, fixed) for p in pages]


NOTICE = "<div>All rights are with the house.</div>"
LAYOUTS = [
    "<body><div class='box'>{n}<h3>Head {k}</h3><p>Short {k}.</p></div></body>",
    "<body><div class='box'>{n}<p>One {k}.</p><p>Two {k}.</p><ul><li>point {k}</li><li>more {k}</li></ul></div></body>",
    "<body><div class='box'>{n}<h3>Head {k}</h3><blockquote>Quote {k}</blockquote></div></body>",
]


def layouts(n: int = 9) -> tuple[list[str], list[str]]:
    pages = [LAYOUTS[k % 3].format(n=NOTICE, k=k) for k in range(n)]
    return pages, [[f"Head {k} Short {k}.", f"One {k}. Two {k}. point {k} more {k}", f"Head {k} Quote {k}"][k % 3] for k in range(n)]


def test_alignment_decides(spark):
    pages, want = layouts()
    regex, got = by_wrapper(pages)
    assert got == want
    assert "(<p>#</p>)*" in regex and "(<h3>#</h3><blockquote>#</blockquote>)?" in regex
    rows = [(k, "http://h/x", p) for k, p in enumerate(pages)]
    spread = {r["page_id"]: r["text"] for r in html.extract(pages_of(spark, rows).repartition(4)).collect()}
    assert spread == dict(enumerate(want))
    # Without alignment, a host's wrapper has the slots of one layout only, and the others lose text.
    assert by_wrapper(pages, lambda a, b: a)[1] != want


def test_what_repeats_on_different_pages_is_the_template(spark):
    pages, want = layouts()
    same = [(k, "http://one/x", pages[0]) for k in range(6)]  # repeated rows are one page: nothing is known to be the template's
    got = {r["text"] for r in html.extract(pages_of(spark, same)).collect()}
    assert got == {"All rights are with the house. " + want[0]}


def test_many_layouts_of_a_hot_host_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(html, "GROUP", 4)
    tags = ["p", "ul", "h3", "blockquote", "pre", "table", "h4", "section"]
    bodies = ["".join(f"<{tags[b]}>text {k} {b}</{tags[b]}>" for b in range(8) if k >> b & 1) for k in range(1, 64)]
    rows = [(k, "http://h/x", f"<body><nav>menu</nav><article>{b}</article></body>") for k, b in enumerate(bodies)]
    assert html.wrappers(pages_of(spark, rows).select(F.col("url").alias("host"), "html")).count() == 1
    for r in html.extract(pages_of(spark, rows)).collect():
        k = r["page_id"] + 1
        assert r["text"] == " ".join(f"text {k} {b}" for b in range(8) if k >> b & 1)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="container with-sidebar"><article><p>x y</p></article></div>', "x y"),
        ('<main><section id="search-engines"><p>abc</p></section></main>', "abc"),
        ('<article><p>a</p><section class="social-history"><p>b</p></section></article>', "a b"),
        ("<article><object data=x><p>one</p></article><footer>z</footer>", "one"),
        ("<article><script src=/js/>var x=1;</script>ok</article>", "ok"),
        ('<article>ok<script src="a.js"/>y</script><p>more</article>', "ok more"),
        ('<p title=">">x', "x"),
        ("a < b <! c> d <?x y?> e <!--> f", "a < b d e f"),
        ("<head><title>T</title><p>said &amp;lt; so", "said &lt; so"),
        ("<article><p>one <a href=/x/>two</a> three<select><option>no</select></p><article class=comment>reader</article></article>", "one two three"),
        ('<article><p>One.</p><section class="social"><h2>Social life</h2><p>Two.</p></section></article>', "One. Social life Two."),
        ('<article><p>One.</p><div class="related"><p>Two <a href=x>here</a>.</p></div></article>', "One. Two here."),
        ('<article><p>One.</p><div class="related"><a href=x>Another story</a> and <a href=y>one more</a></div></article>', "One."),
        ('<div class="related"><p>No article</p></div><article><p>One.</p></article>', "One."),
        ('<body><nav><a href="/">Home</a><article><p>One.</p></article><footer>z</footer></body>', "One."),
        ('<nav><ul><li><a href="/">Home</a></ul><article><p>One.</p></article>', "One."),
        ("<form><input><article><p>One.</p><form>name</form></article></form>", "One."),
        ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one two a b c"),
    ],
)
def test_single_pages(page, text):
    assert by_wrapper([page])[1] == [text]


@pytest.mark.parametrize("part", ["<a ", "<div>", "<b>x", "<!--", "<a b=\"", "<p>x</p>", "<script>", '<a b=">" ', "<ul><li>x", "</b>", "<"])
def test_long_pages_are_read_in_linear_time(part):
    times = []
    for n in (250_000, 1_000_000):
        page = part * (n // len(part))
        begin = time.process_time()
        html.tokens_of(page)
        times.append(time.process_time() - begin)
    assert times[1] < 4 and times[1] < 10 * times[0] + 0.5


def test_wrappers_grow_with_kinds_of_blocks_not_pages():
    tags = ["p", "ul", "h3", "blockquote", "pre", "table", "h4", "section", "figure", "ol"]
    sizes, times = [], []
    for n in (100, 1600):
        r = random.Random(5)
        bodies = [[f"<{(t := r.choice(tags))}>text {k} {b}</{t}>" for b in range(r.randint(20, 60))] for k in range(n)]
        pages = [f"<body><nav>menu</nav><div class=story>{''.join(b)}</div><footer>foot</footer></body>" for b in bodies]
        begin, own = time.process_time(), html.Pages()
        level = [own.stream(p)[1][:2] for p in pages]
        while len(level) > 1:
            level = [functools.reduce(html.align, level[k : k + html.GROUP]) for k in range(0, len(level), html.GROUP)]
        wrapper = json.dumps(level[0])
        slots = [[x for x, _, _ in own.slotted(p, wrapper)] for p in pages]
        times.append(time.process_time() - begin)
        sizes.append(len(level[0][0]))
        assert all(x >= 0 for of in slots for x in of)
        assert [len(of) for of in slots] == [len(b) + 2 for b in bodies]
    assert sizes[1] <= sizes[0] <= 100 and times[1] < 32 * times[0] + 0.5
    assert "(" in html.regex_of(level[0]) and html.regex_of(level[0]).startswith("<body><nav>#</nav><div>(")


def test_random_layouts_of_a_hot_host(spark):
    r = random.Random(8)
    tags = ["p", "h3", "blockquote", "pre", "h4", "section"]
    bodies = [[f"part {k} {b}" for b in range(r.randint(5, 30))] for k in range(120)]
    pages = ["<body><ul><li><a href=/>Home</a></ul><div class=story>" + "".join(f"<{(t := r.choice(tags))}>{x} of what is told here</{t}>" for x in b) + "</div><div class=end>All rights are with the house.</div></body>" for b in bodies]
    got = {x["page_id"]: x["text"] for x in html.extract(pages_of(spark, [(k, "http://h/x", p) for k, p in enumerate(pages)])).collect()}
    assert got == {k: " ".join(f"{x} of what is told here" for x in b) for k, b in enumerate(bodies)}


def test_common_subsequences_of_long_lists_take_little_memory():
    r = random.Random(3)
    a, b = (r.choices("abcdefgh", k=20_000) for _ in range(2))
    tracemalloc.start()
    pairs = html.common(a, b)
    assert tracemalloc.get_traced_memory()[1] < 10 << 20
    tracemalloc.stop()
    assert all(a[i] == b[j] for i, j in pairs) and len(pairs) > 10_000


def test_common_subsequences_are_longest():
    r = random.Random(7)
    for _ in range(500):
        a, b = ("".join(r.choices("abc", k=r.randint(0, 10))) for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        pairs = html.common(list(a), list(b))
        assert len(pairs) == best[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert html.common(list("abxc"), list("abyyc")) == [(0, 0), (1, 1), (3, 4)]


def test_hosts_without_an_article(spark):
    page = '<html><body><div class="menu"><a>Home</a></div><div id="top">Welcome to our site, the home of all good things and news</div><div id="story"><h2>Title {0}</h2><p>{1}</p><p>{1} again</p></div><ul><li><a>link one here</a></li><li><a>link two here</a></li></ul></body></html>'
    rows = [(k, f"http://h/{k}", page.format(k, f"sentence number {k} that goes on for quite a while so that it is text")) for k in range(5)]
    got = {r["page_id"]: r["text"] for r in html.extract(pages_of(spark, rows)).collect()}
    for k in range(5):
        body = f"sentence number {k} that goes on for quite a while so that it is text"
        assert got[k] == f"Title {k} {body} {body} again"


def test_fold_and_align():
    fold = lambda s: html.fold(list(s))[:2]
    assert html.fold(list("aaab")) == (["a", "b"], [2, 0], [[0, 1, 2], [3]])
    assert html.fold(list("xabababy")) == (list("xaby"), [0, 2, 2, 0], [[0], [1, 3, 5], [2, 4, 6], [7]])
    assert html.fold(list("aabaab"))[2] == [[0, 1, 3, 4], [2, 5]]
    assert html.align(fold("abc"), fold("ac")) == (list("abc"), [0, 1, 0])
    assert html.align(fold("xpqz"), fold("xpqpqz")) == (list("xpqz"), [0, 2, 2, 0])
    assert html.regex_of((["+p", "#p", "-p", "+i"], [2, 2, 2, 3])) == "(<p>#</p>)+(<i>)*"
    r = random.Random(6)
    for _ in range(200):
        tokens = r.choices("abc", k=r.randint(0, 30))
        places = html.fold(tokens)[2]
        assert sorted(k for p in places for k in p) == list(range(len(tokens)))


def test_html_query(spark):
    got = queries.op4_html(spark, "/root/testdata/sf0.001").where(F.col("n_chars") != F.char_length("text")).count()
    assert got == 0
    import re

    d = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    texts = {r["page_id"]: r["text"] for r in queries.op4_html(spark, "/root/testdata/sf0.001").collect()}
    import html as entities

    for r in d:  # the given pages have one article of headings and paragraphs
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.sub(r"</?b>", "", article)
        assert texts[r["page_id"]] == " ".join(x for b in re.split(r"<[^>]*>", blocks) if (x := " ".join(entities.unescape(b).split())))


def test_articles_without_their_element(spark):
    """The given pages with every article in a plain element: the region with most of the varying text is found."""
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    plain = d.withColumn("html", F.regexp_replace(F.regexp_replace("html", "<article>", '<div class="story">'), "</article>", "</div>"))
    want = {r["page_id"]: r["text"] for r in html.extract(d).collect()}
    got = {r["page_id"]: r["text"] for r in html.extract(plain).collect()}
    assert got == want
