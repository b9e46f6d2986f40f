import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from replyforest.llm import line_dedup as ld


def brute(rows, ratio, least):
    pages, on = {}, {}
    for host, text in rows:
        pages[host] = pages.get(host, 0) + 1
        for line in set((text or "").split("\n")):
            on[host, line] = on.get((host, line), 0) + 1
    gone = lambda h, x: on[h, x] >= least and on[h, x] > ratio * pages[h]
    return ["\n".join(x for x in (t or "").split("\n") if not gone(h, x)) for h, t in rows]


def test_lines_of_sites(spark, clash):
    rng = random.Random(1)
    hosts = ["a.b", "c.d", "e.f", ""]
    rows = []
    for i in range(400):
        h = rng.choice(hosts + ["a.b"] * 4)
        text = "\n".join(rng.choice([f"menu {h}", f"own {i}", "everywhere", f"{rng.randrange(4)}", ""]) for _ in range(rng.randint(0, 12)))
        rows.append((i, f"HTTPS://u@{h.upper()}:80/x" if h else None, rng.choice([text, text, None]), h))
    frame = clash(spark.createDataFrame([r[:3] for r in rows], "page_id bigint, url string, text string"))
    found = ld.without_boilerplate(frame, ld.lines_of_text(F.col("text")), ratio=0.4, least_pages=3).collect()
    expected = brute([(h, t) for _, _, t, h in rows], 0.4, 3)
    assert {r.page_id: (r.host, "\n".join(r.kept_lines)) for r in found} == {i: (h, e) for (i, _, _, h), e in zip(rows, expected)}


@pytest.mark.parametrize("url,host", [("http://A.b/c", "a.b"), ("https://u:p@x.y:8/z?q#f", "x.y"), ("ftp://h", "h"), ("no address", ""), (None, ""), ("http:///x", "")])
def test_hosts(spark, url, host):
    row = spark.createDataFrame([(url,)], "url string").select(ld.host_of(F.col("url")).alias("h")).first()
    assert row.h == host


def test_lines_of_html(spark):
    html = "<!DOCTYPE html><title>T</title><script>var x='<p>';</script><style>p{}</style><!-- c\n --><P class='a'> one <b>two</b></p><br/>x<li>y</li>\n\n"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(ld.lines_of_html(F.col("h")).alias("l")).collect()
    assert row[0].l == ["T", "one two", "x", "y"] and row[1].l == []


PIECES = ["<!--", "-->", "<script>", "<SCRIPT a='>'", "</script>", "</Style>", "<style x", "<", ">", "</", "<p", "<p ", "</p>", "<br/>", "<b>", "<div\n>",
          "<h1/", "--", "!", "script", "\x01", "\x01e", "\x01m", "e", "m", "\n", " ", "word", "ü", "\U0001f600"]


def plain_lines(html):
    """The three replacements, one after the other, as Python's regular expressions make them."""
    seen = re.sub(r"<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "", html, flags=re.I | re.S | re.A)
    names = "p|div|br|li|ul|ol|nav|article|section|header|footer|title|head|body|html|table|tr|td|th|h[1-6]"
    seen = re.sub(rf"</?(?:{names})(?:\s[^>]*)?/?>", "\n", seen, flags=re.I | re.A)
    return [x.strip(" ") for x in re.sub("<[^>]*>", "", seen).split("\n") if x.strip(" ")]


def test_lines_of_any_html(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 25))) for _ in range(4000)]
    texts += ["<!-->", "<!--->", "<!-- <script>x</script>", "<script><!--</script>-->", "<!-- a --> <!-- b", "<script</script>a</script>"]
    rows = spark.createDataFrame([(t,) for t in texts], "h string").select("h", ld.lines_of_html(F.col("h")).alias("l")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.l == plain_lines(r.h), r.h


@pytest.mark.parametrize("opener", ["<!--", "<script>", "<script", "<style ", "<", "<p ", "<p", "</", "<!-->", "<!--</script>", "<script>-->", ">", "<b>"])
def test_openers_that_nothing_closes_take_linear_time(spark, opener):
    """200,000 of them; followed each to the end they would take minutes."""
    frame = spark.range(1).select(F.repeat(F.lit(opener), 200_000).alias("h"))
    started = time.monotonic()
    frame.select(F.size(ld.lines_of_html(F.col("h"))).alias("n")).collect()
    assert time.monotonic() - started < 10


def test_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "http://a", ""), (1, "http://a", "<p>" + "w " * 100_000)], "page_id bigint, url string, html string")
    assert ld.site_lines(rows.unionByName(rows)).count() == 6 and ld.site_lines(rows.limit(0)).count() == 0


def test_sql(spark):
    from compare import difference
    from replyforest.llm.registry import ORACLES

    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT i AS page_id, 'http://h' || i % 3 || '/x' AS url, '<p>menu ' || i % 3 || '</p><p>own ' || i || '</p>' AS html FROM range(60) r(i)")
    rows = con.sql("SELECT * FROM pages").fetchall()
    found = ld.site_lines(spark.createDataFrame(rows, "page_id bigint, url string, html string"))
    assert difference(found, con, ORACLES["op6_line_dedup"]) == "" and found.agg(F.sum("n_dropped")).first()[0] == 60
