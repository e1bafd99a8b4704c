import base64
import gzip
import hashlib
import random

from conftest import SF
from pyspark.sql import functions as F

from larder.llm import warc
from larder.llm.common import read


def test_round_trip(spark):
    pages = read(spark, SF, "pages")
    records = warc.derivatives(pages)
    rows = {r.record_id: r for r in records.collect()}
    assert len(rows) == 2 * pages.count()
    data = b"".join(r.member for r in warc.members(records).collect())
    back = list(warc.parse(gzip.decompress(data)))
    assert len(back) == len(rows)
    for headers, block in back:
        fields = dict(headers)
        r = rows[fields["WARC-Record-ID"]]
        assert block.decode() == r.block and [(h.name, h.value) for h in r.headers] == headers
        want = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert fields["WARC-Block-Digest"] == want and int(fields["Content-Length"]) == len(block)


def test_records_are_linked_and_keep_the_source(spark):
    pages = {p.page_id: p for p in read(spark, SF, "pages").collect()}
    by_page = {}
    for r in warc.derivatives(read(spark, SF, "pages")).collect():
        by_page.setdefault(r.page_id, {})[r.record_type] = r
    for page_id, page in pages.items():
        about, text = by_page[page_id]["metadata"], by_page[page_id]["conversion"]
        source = warc.response(page_id, page.url, page.html, warc.DATE)
        assert about.refers_to == text.refers_to == source["record_id"]
        assert dict(about.headers and [(h.name, h.value) for h in about.headers])["WARC-Concurrent-To"] == text.record_id
        for r in (about, text):
            fields = {h.name: h.value for h in r.headers}
            assert fields["WARC-Refers-To"] == source["record_id"]
            assert fields["WARC-Source-Payload-Digest"] == source["payload_digest"]
            assert fields["WARC-Target-URI"] == page.url == r.target_uri
        assert f"source-content-length: {len(page.html.encode())}\r\n" in about.block
        assert "<p>" not in text.block and "track(" not in text.block


def test_conversion_by_hand():
    page = (
        "<!DOCTYPE html><html><head><title> A &amp;\n b</title><style>p{}</style>"
        '<script>var t="</p><b>";</script></head><body><!-- <p>no</p> --><h1>One  two</h1>'
        "<p title=\"a>b\">x &lt; y<br>z &#233;&nbsp;!</p>5 < 6 <a class='k' href='/q?a=1&amp;b=2'>go</a> on"
        "<A HREF=plain>there</A><td>c</td></body>"
    )
    title, text, links = warc.parse_html(page)
    assert title == "A & b" and links == ["/q?a=1&b=2", "plain"]
    assert text == "One two\nx < y\nz é !\n5 < 6 go onthere\nc"


def test_odd_pages_take_linear_time():
    for page in ("<" * 200_000, "<!--" * 100_000, "<a href='" * 50_000, "<script>" * 50_000, '<p "' * 100_000, "</" * 99_999, "&" * 99_999):
        warc.parse_html(page)


def test_odd_rows(spark):
    rng = random.Random(1)
    noise = "".join(rng.choice("<>/\"'!-&;#x ap\n") for _ in range(3000))
    rows = [(1, None, None), (None, "u\r\nInjected: x", "<p>a"), (2, "u", ""), (3, "u", noise), (3, "u", noise), (4, "", "t" * 10**6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.derivatives(df.withColumns({"record_id": F.lit(1), "block": F.lit(2)})).collect()
    assert len(got) == 12 and got[6].record_id == got[8].record_id
    assert "WARC-Target-URI" not in {h.name for h in got[0].headers} and got[1].block == ""
    assert {h.name: h.value for h in got[2].headers}["WARC-Target-URI"] == "u Injected: x"
    data = b"".join(warc.serialize([(h.name, h.value) for h in r.headers], r.block.encode()) for r in got)
    assert [b.decode() for _, b in warc.parse(data)] == [r.block for r in got]
    assert warc.derivatives(df.limit(0)).count() == 0


def test_empty_and_unclosed_elements_lose_no_text():
    for page in (
        '<p>a</p><svg viewBox="0 0 1 1"/><p>b <a href=u>c</a></p>',
        '<p>a</p><script src="x.js" /><p>b <a href=u>c</a></p><script>no</script>',
        "<title/><p>a</p><p>b <a href=u>c</a></p><svg><title>no</title></svg>",
        *(f"<p>a</p><{name}><p>b <a href=u>c</a></p>" for name in ("svg", "noscript", "template", "textarea", "title")),
    ):
        assert warc.parse_html(page) == ("", "a\nb c", ["u"])
    assert warc.parse_html("a<script src=/x/>no</script>b<svg width=5/>no</svg>c<style>no")[1] == "abc"
    for name in ("svg", "title", "textarea"):
        warc.parse_html(f"<{name}>" * 100_000)
