import re
import time
from html.parser import HTMLParser

import pytest

from brindle.llm import extraction as X


def page(body: str, shell: str = "post-{n} main", n: int = 1) -> str:
    return f'<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><!-- <p>no --><nav><ul><li><a href="/">Home page of the site</a></ul></nav><div class="ad">{"buy this now and then " * 9}</div><div class="{shell.format(n=n)}">{body}</div><script>var t="</p><p>nothing of this";</script><footer>some words about the site and its owners</footer>'


TEXT = "<h1>A title</h1><p>First paragraph of the text, <b>with <i>some</i> markup</b> in it.<p>Second one &amp; the last&nbsp;one, which is not closed either<br>after a break"


def test_one_page():
    path, text = X.extract(page(TEXT), None)
    assert path == "body>div.main.post-#"
    assert text == "A title\nFirst paragraph of the text, with some markup in it.\nSecond one & the last one, which is not closed either\nafter a break"


def test_consensus_overrules_a_page(spark):
    odd = page("<p>short but real text of it</p>") + '<div class="promoted">' + "<p>a long piece that isn't the text at all, really, it is not</p>" * 20 + "</div>"
    assert X.extract(odd, None)[0] == "body>div.promoted"
    rows = [(i, f"https://Host.example/{i}?q", page(TEXT, n=i)) for i in range(5)] + [(9, "http://host.example/x", odd), (20, "http://other.example/", page(TEXT, "content"))]
    found = {r.page_id: r for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[9].path == "body>div.main.post-#" and found[9].text == "short but real text of it"
    assert found[20].path == "body>div.content" and found[20].host == "other.example" and found[3].host == "host.example"


def test_equals_brute_force_votes(spark):
    import pyarrow.parquet as pq
    from collections import Counter, defaultdict
    from urllib.parse import urlparse

    sf = "/root/testdata/sf0.001"
    rows = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    count = defaultdict(Counter)
    for r in rows:
        paths, texts = X.elements(r["html"])
        count[urlparse(r["url"]).hostname][X.best(X.scores(paths, X._paragraphs(texts)))] += 1
    found = spark.read.parquet(f"{sf}/pages.parquet")
    assert {(r.host, r.path): r.votes for r in X.votes(found).collect()} == {(h, p): n for h, c in count.items() for p, n in c.items()}
    texts = {r.page_id: r for r in X.extract_pages(found).collect()}
    assert len(texts) == len(rows)
    for r in rows:
        text = texts[r["page_id"]].text
        assert "©" not in text and "track(" not in text and text


class _Reader(HTMLParser):
    """Blocks of text inside the first element of a tag and classes, by the standard library's parser."""

    BLOCKS = set("p h1 h2 h3 h4 h5 h6 li div br article section ul ol table tr td th blockquote pre".split())
    SILENT = {"script", "style", "title"}
    ASIDE = {"nav", "footer", "aside", "header"}

    def __init__(self, tag, names):
        super().__init__(convert_charrefs=True)
        self.tag, self.names, self.depth, self.silent, self.run, self.blocks = tag, names, 0, 0, "", []
        self.aside: list[str] = []  # open elements from one on that is beside the text

    def flush(self):
        if text := " ".join(self.run.split()):
            self.blocks.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if self.depth and tag in self.BLOCKS | self.ASIDE:
            self.flush()
        self.silent += tag in self.SILENT
        names = {re.sub(r"\d+", "#", n) for n in (dict(attrs).get("class") or "").lower().split()}
        if self.depth and (self.aside or tag in self.ASIDE or names & {"ad", "menu", "sidebar"}):
            self.aside.append(tag)
        if self.depth:
            self.depth += tag == self.tag
        elif tag == self.tag and names == self.names:
            self.depth = 1

    def handle_endtag(self, tag):
        if self.depth and tag in self.BLOCKS | self.ASIDE | {self.tag}:
            self.flush()
        self.silent -= tag in self.SILENT
        if tag in self.aside:
            while self.aside.pop() != tag:
                pass
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth and not self.silent and not self.aside:
            self.run += data


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_texts_equal_those_of_another_parser(spark, sf):
    """What is extracted from the tables' pages is what html.parser finds in the element that the path names."""
    import pyarrow.parquet as pq

    pages = {r["page_id"]: r["html"] for r in pq.read_table(f"/root/testdata/sf{sf}/pages.parquet").to_pylist()}
    found = X.extract_pages(spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")).collect()
    assert len(found) == len(pages)
    for r in found:
        tag, *names = r.path.rpartition(">")[2].split(".")
        reader = _Reader(tag, set(names))
        reader.feed(pages[r.page_id])
        reader.close()
        reader.flush()
        assert r.text.split("\n") == reader.blocks, (r.page_id, r.path)


def test_defined_results(spark):
    rows = [(1, None, page(TEXT)), (2, "not a url", page(TEXT)), (3, "http://h.example/", None), (4, "http://h.example/", ""), (5, "http://h.example/", "only words"), (5, "http://h.example/", "only words"), (None, "http://i.example/", page(TEXT)), (6, "http://h.example/", "<div " * 2000), (7, "http://h.example/", "<p>" + "x " * 300_000), (8, "http://h.example/", '<div class="a"><a href="x>y" class=\'q\'>link</a> unclosed " quote <b>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text")
    found = X.extract_pages(pages).collect()
    assert len(found) == len(rows)
    by = {r.page_id: (r.path, r.text) for r in found}
    assert by[3] == by[4] == (None, "") and by[5] == ("body", "only words")
    assert by[1][0] == by[2][0] == by[None][0] == "body>div.main.post-#" and len(by[7][1]) == 599_999
    assert X.extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("size", [3_000, 10_000, 1_000_000])
@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("unit", ["abcdefgh", "ab > <p>"])
def test_long_attribute_values(size, quote, unit):
    value = quote + unit * (size // 8) + quote
    body = f'<div data-x={value} class="main"><p>First paragraph of the page</p><img alt="" src = {value}><p>Second paragraph of the page</p><p>Third <a href="/y">link</a> and more of it</p></div><footer>the end</footer>'
    assert X.extract(body, None) == ("body>div.main", "First paragraph of the page\nSecond paragraph of the page\nThird link and more of it")


def test_stray_quotes_and_tags_without_an_end():
    text = "words of the text " * 400
    assert X.extract(f'<p title="a"">{text}</p><p class=b">one "two" more</p><p don\'t>three</p>', None)[1] == f'{text.strip()}\none "two" more\nthree'
    assert X.extract('<p>one</p><a title="<b>two</b>', None)[1] == "one\ntwo"
    for unit in ("<a ", '<a x="', '<a x=">"', "<a x='"):
        start = time.perf_counter()
        sum(1 for _ in X._tokens(unit * 100_000))
        assert time.perf_counter() - start < 5


def test_a_hot_hosts_pages_are_split_over_tasks(spark):
    """Where winners aren't broadcast, adaptive execution splits the pages of a host that has most of them."""
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k, None) for k in own}
    rows = [(i, f"http://{'hot' if i % 10 else f'h{i}'}.example/{i}", page(TEXT + "".join(f"<p>{i} {k} word</p>" for k in range(150)), n=i)) for i in range(1500)]
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = X.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8))
        assert len(found.collect()) == 1500
        assert "skewed" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_ties_and_paths():
    assert X.best({"b": 2.0, "a": 2.0, "c": 1.0}) == "a" and X.best({}) is None
    assert X._segment("div", ' class="B2 a10 x1y2 A10"') == "div.a#.b#"
    paths, _ = X.elements("<ul><li><ul><li>x</ul><li>y</ul><p>z<div>q</div></p>")
    assert [p for p, _ in paths] == ["body", "body>ul", "body>ul>ul", "body>div"]
