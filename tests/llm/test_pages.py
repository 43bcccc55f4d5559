import base64
import hashlib

import pytest

from roadpulse.llm import html_text, warc

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav>menu</nav><div id="cookie-notice">We use cookies</div><main><article><header><h1>Title &amp; more</h1></header>
<p>One <b>two</b>three.<p>Four<aside>side</aside><ul><li>a<li>b</ul><form><p>sign up</p></form><script>var a="<p>x</p>";</script></article><section class="comments"><p>nice post</p></section></main>
<div class="sidebar"><a href=x>foo</a></div><footer>f</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Title & more One twothree. Four a b"
    assert html_text.main_text("") == "" and html_text.main_text("plain  text") == "plain text"
    assert html_text.main_text("<p>a<p>b &lt; c") == "a b < c"
    soup = "<body><div><a href=1>Home</a> <a href=2>About</a></div><div><div><h2>Head</h2><p>" + "long text here. " * 20 + "</p><p>short</p><p>" + "other words. " * 30 + "</p></div></div></body>"
    assert html_text.main_text(soup) == " ".join(["Head", *["long text here."] * 20, "short", *["other words."] * 30])
    assert html_text.main_text("<p>" * 2000 + "deep") == "deep"


def test_pages_without_an_article_are_empty():
    for html in ("<div class='ad'>Buy now</div>", "<p class='cookie'>We use cookies</p>", "<nav>a</nav><footer>b</footer>", "<script>x()</script>", "<form>name</form>"):
        assert html_text.main_text(html) == ""


def test_left_out_tags_and_wrappers():
    assert html_text.main_text("<html><head><title>T</title><body><article><p>text</article>") == "text"
    assert html_text.main_text("<title>T</title><p>text") == "text"
    assert html_text.main_text("<div class='page hidden-sidebar'><article><p>text</p><div class='ad'>buy</div></article></div>") == "text"
    assert html_text.main_text("<form><article><p>text</p></article><p>sign up</p></form>") == "text"
    assert html_text.main_text("<article>own</article><div class='comments'><article>said a reader at some length</article></div>") == "own"


STORY = "<h1>Head</h1><p>" + "A sentence of the story, of some length. " * 4 + "</p><p>" + "The rest of it, just as long as before. " * 4 + "</p>"
TOLD = " ".join(["Head", *["A sentence of the story, of some length."] * 4, *["The rest of it, just as long as before."] * 4])


@pytest.mark.parametrize(
    "page",
    [
        "<div class='page no-sidebar'>{}</div>", "<div class='content ad-free'>{}</div>", "<div class='menu-closed'>{}</div>", "<body><form id='aspnetForm' action='x'>{}</form></body>",
        "<div class='post has-comments'><article>{}</article></div>", "<article class='post comments-open'>{}</article>", "<div id='sidebar'>{}</div>", "<div class='layout-right-sidebar'>{}<div class='sidebar'>Other news</div></div>",
        "<div class='social'><div>{}</div></div><div class='ad'>Buy now</div>", "<div class='banner-off'>{}</div><div class='share-buttons'>Share this</div><div class='cookie-notice'>We use cookies</div>",
        "<form><div class='ad'>Buy</div>{}</form><div class='comments'><p>%s</p></div>" % ("A reader says a lot more than the story does. " * 30),
    ],
)
def test_class_names_do_not_drop_articles(page):
    assert html_text.main_text(page.format(STORY)) == TOLD


def test_marks_still_drop_what_is_beside(spark):
    page = f"<div class='page no-sidebar'>{STORY}<div class='ad-slot'>Buy now</div><div id='related-posts'>More</div><div class='sidebar sidebar-left'>Links</div></div><form>Sign up</form>"
    assert html_text.main_text(page) == TOLD
    assert html_text.main_text(f"<article>{STORY}<form><p>Sign up</p></form></article>") == TOLD
    assert html_text.main_text("<div class='comments'>" + STORY + "</div>") == ""


LONG = ["A sentence of the story that goes on for a while, and then for a while more. " * 3, "Another one, as long as the first, of which there is nothing else to say here. " * 3]
BARE = "<div><div><a href=1>Home</a></div>" + "<div><a href=2>News of the day</a></div>" * 6 + "</div><div><div>{0}</div><div>Short end.</div><div>{1}</div></div><div>" + "<div><a href=5>More of us</a></div>" * 6 + "<div><a href=4>Terms</a></div><div>(c) us</div></div>"


def test_ratios_pick_the_region(monkeypatch):
    """Without telling elements and classes the clusters of the ratios decide; with flat ratios the same page gives all its lines."""
    import numpy as np

    page = BARE.format(*LONG)
    story = " ".join([LONG[0].strip(), "Short end.", LONG[1].strip()])
    assert html_text.main_text(page) == story
    inside = html_text.main_text(f"<article>{page}</article>")  # lists of links go, but for those next to the story
    assert story in inside and "Home" not in inside and "Terms" not in inside
    monkeypatch.setattr(html_text, "upper_cluster", lambda x: np.ones(len(x), bool))
    assert "Home" in html_text.main_text(f"<article>{page}</article>")


def test_clusters():
    import numpy as np

    assert html_text.upper_cluster(np.array([1.0, 1.1, 5.0, 1.2, 4.0])).tolist() == [False, False, True, False, True]
    assert html_text.upper_cluster(np.array([1.0, 1.2])).all()


def test_deep_nesting_stays_small():
    import time
    import tracemalloc

    began = time.time()
    tracemalloc.start()
    assert html_text.main_text("<div>x" * 33000).count("x") >= 0.8 * 33000
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    html_text.main_text("<x>y" * 20000 + "</z>" * 20000)
    assert time.time() - began < 60


def test_extract_against_an_independent_reader(spark):
    """The pages of the smallest table, whose article a pattern finds: its text without tags."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_text.extract(pages).join(pages.drop("url"), "page_id").collect():
        (body,) = re.findall(r"(?s)<article\b.*?</article>", r.html or "") or [""]
        body = re.sub(r"(?s)<(script|style|aside|form|nav|footer)\b.*?</\1>|<!--.*?-->|<div class=\"[^\"]*\">.*?</div>", " ", body)
        body = re.sub(r"</?(b|i|em|a|strong|span|code)\b[^>]*>", "", body)
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split()), r.page_id


def test_extract_keeps_every_row(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (2, None, None, "t"), (None, "x", "", "t")], "page_id long, url string, html string, text string")
    out = sorted(html_text.extract(pages).collect(), key=str)
    assert len(out) == 4 and {r.text for r in out} == {"Title & more One twothree. Four a b", ""} and all(r.n_chars == len(r.text) for r in out)
    assert html_text.extract(pages.limit(0)).collect() == []


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "x" * 5000), (2, "http://b/", "y"), (3, "http://c/\r\nd", "x" * 5000), (4, None, None), (5, "e", ""), (6, "f", "é\r\n\r\nzz"), (7, "g", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        data = (h or "").encode()
        r = out[i]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_pushdown_and_small_payloads(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "aa"), (2, "u2", "aa"), (3, "u3", "b" * 100), (4, "u4", "b" * 100)], "page_id long, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/w", least_bytes=10)
    read = warc.read_warc(spark, f"file://{tmp_path}/w")
    assert {r.record_type for r in read.where("target_uri in ('u1', 'u2')").collect()} == {"response"}
    assert [bytes(r.payload) for r in read.where("record_type = 'response' and target_uri = 'u3'").collect()] == [b"b" * 100]
    reader = warc.WarcReader({"path": f"file://{tmp_path}/w"})
    kept = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("date",), "x")]))
    assert len(kept) == 1 and reader.wanted == {"warc-type": {"revisit"}}
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in found] == ["<urn:page:4>"]


def test_plain_warc_records_are_read(tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nhello"
    data = warc.record("response", [("WARC-Target-URI", "u")], block) + warc.record("metadata", [], b"k: v")
    (tmp_path / "a.warc").write_bytes(data)
    reader = warc.WarcReader({"path": f"file://{tmp_path}"})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_type"] for r in found] == ["response", "metadata"]


def test_appends_add_and_overwrites_replace(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    one, two = (spark.createDataFrame([(k, f"u{k}", f"page {k}")], "page_id long, url string, html string") for k in (1, 2))
    warc.write_pages(one, path)
    warc.write_pages(two, path)
    assert {r.target_uri for r in warc.read_warc(spark, path).collect()} == {"u1", "u2"}
    rows = spark.createDataFrame([(3, "u3", bytearray(b"x"), "D", None)], warc.WRITTEN)
    rows.write.format("warc").mode("overwrite").save(path)
    assert {r.target_uri for r in warc.read_warc(spark, path).collect()} == {"u3"}


def found(data: bytes, wanted=None, payloads=True):
    import pyarrow as pa

    return list(warc.scan(pa.BufferReader(data), wanted or {}, payloads))


def test_members_of_many_records_and_cut_ones():
    import gzip

    import pytest

    http = b"HTTP/1.1 200 OK\r\n\r\n"
    many = [warc.record("response", [("WARC-Target-URI", f"u{k}"), ("Content-Type", "application/http")], http + bytes([65 + k]) * (70000 * k)) for k in range(4)]
    for data in (gzip.compress(b"".join(many)), b"".join(map(gzip.compress, many)), b"".join(many), b"".join(map(warc.member, many)), gzip.compress(many[0] + many[1]) + warc.member(many[2]) + many[3]):
        assert [(h["warc-target-uri"], len(b)) for h, b in found(data)] == [(f"u{k}", len(http) + 70000 * k) for k in range(4)]
        assert [b[len(http) :][:1] for _, b in found(data, {"warc-target-uri": {"u2"}})] == [b"C"]
        assert [len(b) for _, b in found(data, payloads=False)] == [len(http)] + [warc.HEAD_BYTES] * 3
        if data[:1] == b"\x1f" and data[-1:] == b"\0":  # cut anywhere in the last member
            for cut in (1, 5, 30):
                with pytest.raises(ValueError):
                    found(data[:-cut])
    one = gzip.compress(many[1])
    for cut in (len(one) - 4, len(one) // 2, 30, 15):
        with pytest.raises(ValueError):
            found(one[:cut])
    with pytest.raises(ValueError):
        found(b"no archive at all\r\n\r\n")
    with pytest.raises(ValueError):
        found(many[1][:-100])
    reader = warc.WarcReader({"path": "file:///", "payloads": "false"})
    assert [reader.row(h, b)["payload_bytes"] for h, b in found(b"".join(map(warc.member, many)), payloads=False)] == [70000 * k for k in range(4)]


def test_long_lists_of_revisits_join_by_page(spark, monkeypatch):
    rows = [(k, f"u{k}", f"text {k % 3}") for k in range(12)] + [(None, "n", "text 1"), (None, "m", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    few = sorted(map(str, warc.round_trip(pages).collect()))
    monkeypatch.setattr(warc, "FEW_DIGESTS", 0)
    assert sorted(map(str, warc.round_trip(pages).collect())) == few
