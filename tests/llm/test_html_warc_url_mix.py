import duckdb
import pytest
from compare import differences
from pyspark.sql import functions as F
from tallyfield.llm import html_text, mixing, url_filter, warc
from tallyfield.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, QUERIES[name], ORACLE[name], SF) is None


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><header><h1>Site</h1></header><div id='cookie-notice'>We use cookies</div><div class=content><h1>T</h1><p>One, two &amp; three<br>x</p><p>Four, five</p><div class='comments'><p>nice, very, nice, good</p></div></div><aside>side, side</aside></body>", "T\nOne, two & three x\nFour, five"),
        ("<p>only text, here", "only text, here"),
        ("plain text no tags", "plain text no tags"),
        ("<nav><a href=x>menu</a></nav><footer>&copy; x</footer>", ""),
        ("<main><section><p>A one.</p></section><section><p>B two.</p><ul><li>i<li>j</ul></section></main><footer>f</footer>", "A one.\nB two.\ni\nj"),
        ("<article><p>a\n\t b&nbsp;c</p><script>var t='</p>';</script><style>p{}</style><form><p>mail, us, now</p></form><p>d &lt;e&gt; &#233;</p></article>", "a b c\nd <e> é"),
        ("<article><p>cut off</p><p class='x", "cut off"),
        ("<div class='content with-sidebar'><p>Long, long text, here</p></div><div class=sidebar><p>side, side</p></div>", "Long, long text, here"),
        ("<div class='page-header'><p>Site, name</p></div><article><div class='entry-header'><h1>T</h1></div><p>a, b</p></article>", "T\na, b"),
        ("", ""),
        (None, ""),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_main_text_of_long_and_deep_pages():
    assert len(html_text.main_text("<article>" + "<p>word, word</p>" * 50_000)) == 50_000 * 11 - 1
    assert html_text.main_text("<div>" * 30_000 + "<p>deep</p>") == "deep"


def test_extract_covers_all_rows(spark):
    got = {r["page_id"]: r for r in html_text.op3_tree_scored_text(spark, SF).collect()}
    rows = duckdb.sql(f"select page_id, html from '{SF}/pages.parquet'").fetchall()
    assert len(got) == len(rows) and all(got[i]["text"] == html_text.main_text(h) and got[i]["n_chars"] == len(got[i]["text"]) for i, h in rows)
    clash = spark.createDataFrame([(1, "<p>x</p>", "old", 9), (1, None, "old", 9)], "page_id int, html string, text string, n_chars int")
    assert sorted(r["text"] for r in html_text.extract(clash).collect()) == ["", "x"] and html_text.extract(clash.limit(0)).count() == 0


def test_archive_is_an_exact_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (2, "http://a/2", big), (3, None, "x"), (4, "http://a/4", "x"), (5, "u\r\nX: y", None), (None, "http://a/n", big), (6, "http://a/6", "")]
    records = warc.read_records(warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha256", F.lit(1)))).collect()
    assert len(records) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in records)
    assert kinds == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None)]
    for r in records:
        raw, html = bytes(r["record"]), next(h or "" for i, u, h in rows if i == r["page_id"])
        assert bytes(r["payload"]) == html.encode()
        assert raw == r["header"].encode() + (html.encode() if r["record_type"] == "response" else b"") + b"\r\n\r\n"
        head, _, block = raw.partition(b"\r\n\r\n")
        assert int(head.rpartition(b"Content-Length: ")[2]) == len(block) - 4 and b"\r\nX:" not in head
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_records(warc.write_archive(empty)).count() == 0


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/7", "http://a.b.example.com/en/8?x=/en/7", "http://example.net/de/8#a", "http://badexample.net/de/8", "http://example.com", "http://example.com?x://y/en/", "x://com/en/", "http://example.com/en", "http://example.com:80/en/7", "ftp://x.org/es/", "http://x.org/es/" + "a/" * 5000]


def test_trie_and_join_agree_with_a_plain_search(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, ("EXAMPLE.com", "/en/7", "allow"), ("", "/always", "block")], "host string, path string, verdict string")
    got = {r["page_id"]: tuple(r[c] for c in url_filter.ADDED) for r in url_filter.judge(pages, rules).collect()}
    assert got == {r["page_id"]: tuple(r[c] for c in url_filter.ADDED) for r in url_filter.judge(pages, rules, bound=1).collect()}
    for i, u in enumerate(URLS):
        host, path = url_filter.split_url(u)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert got[i] == got[i + len(URLS)] == (host, path, *(max(fit)[1:] if fit and "://" in (u or "") else (None, "allow")))
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0
    null = [(None, "/en/7", "block"), ("example.com", None, "block"), ("org", "/es/", None)]
    ways = [url_filter.judge(pages, null), url_filter.judge(pages, null, bound=1), url_filter.judge(pages, spark.createDataFrame(null, "host string, path string, verdict string"), bound=1)]
    first, *rest = ({r["page_id"]: tuple(r[c] for c in url_filter.ADDED) for r in way.collect()} for way in ways)
    assert all(x == first for x in rest) and first[3] == ("example.com", "/en/7", "example.com", "block") and first[13][2:] == (None, "allow")


def test_mix_meets_targets(spark):
    got = mixing.op10_fair_queue_mix(spark, "/root/testdata/sf0.01").collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    total, largest = sum(r["size"] for r in got), max(r["size"] for r in got)
    assert total - 20 * largest <= sum(r["taken"] for r in got) <= total


def test_mix_of_odd_rows(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "w " * 1000, None), (None, "p q", "y"), (5, " \t\n ", "z")]
    docs = spark.createDataFrame([(*r, 7, 7) for r in rows], "doc_id long, text string, source string, size int, key int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and sorted(r["size"] for r in got) == [0, 0, 0, 2, 3, 3, 1000]
    targets = {r["source"]: (r["source_size"], r["target"]) for r in got}
    assert targets["x"] == (6, 18.0) and targets["y"] == (2, 6.0) and targets["z"] == (0, 0.0) and targets[None] == (1000, 984.0)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_ranges_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    assert differences(spark, QUERIES["op10_fair_queue_mix"], ORACLE["op10_fair_queue_mix"], SF) is None


def test_last_of_the_order_within_the_room(spark):
    rows = [(i * 7 % 50, i % 5) for i in range(200)]
    edge = spark.createDataFrame(rows, "key int, size int").select("key", "size")
    for room in (0, 1, 57, 200, 399, 400, 1000):
        got = mixing._last_within(edge, ("key", "size"), room)
        fit = [x for x in sorted(set(rows)) if sum(y[1] for y in rows if y <= x) <= room]
        assert (tuple(got) if got else None) == (fit[-1] if fit else None)
