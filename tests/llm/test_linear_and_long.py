"""Broken pages in linear time, exact text of articles, phrases at word boundaries, long labelled documents."""

import os
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from ampliflow.llm import html_extract, line_crf, quality_rules

DATA = "/root/testdata/sf0.01"
BLOCKS = set(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br img".split()
)


@pytest.mark.parametrize(
    "unit", ['<p class="x ', "<a ", "<div></section>", '<p class="x >', "<i>", "<div><li></li>", "<script></script ", "<", "<!-- ", "<b><p>x</b>", "<li><ul><div>", "</p>", "<td><tr>", "<p 'a\" >"]
)
def test_time_is_linear(unit):
    """A page of half a MB takes no more than a few times as long a character as one of a tenth of that."""

    def seconds(n):
        page = unit * (n // len(unit))
        began = time.process_time()
        html_extract.parse(page)
        return time.process_time() - began

    seconds(1000)
    assert seconds(500_000) < 0.3 + 25 * seconds(50_000) and seconds(2_000_000) < 20


def test_broken_pages_keep_their_text():
    def said(page):
        nodes = html_extract.parse(page)
        return [p for x in nodes for p in x.pieces if isinstance(p, str)]

    assert said("a < b and <b>c</b> <") == ["a < b and c <"]
    assert said('<p title="x > y">one</p>') == ["one"]
    assert said('<p title="x>one</p>') == ["one"]
    assert said("one <!-- two") == ["one"] and said("one <p two") == ["one <p two"]
    assert said("one <p two <!-- three") == ["one <p two"]
    assert said("<div><i>a</div>b</i>c") == ["a", "bc"]
    # After so many tags whose quotes don't pair up, tags end at their first sign; texts stay.
    page = "".join(f"<p title='{k}>" + f"t{k} </p>" for k in range(0, 41)) + "end"
    assert "end" in " ".join(said(page))


class _Article(HTMLParser):
    """Blocks of the text between article tags."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in BLOCKS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.blocks.append("")
        self.inside -= tag == "article" and self.inside > 0

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_exact_text_of_articles(spark):
    """White space included: one blank inside blocks and between them."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").repartition(4)
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_extract.op2_query(pages).collect()
    assert len(got) == len(html) > 100
    for r in got:
        article = _Article()
        article.feed(html[r["page_id"]])
        assert r["text"] == " ".join(x for x in (" ".join(b.split()) for b in article.blocks) if x)


def test_phrases_are_whole_words(spark):
    body = "This is a line that says something, and it goes on for a while until it ends here.\n" * 3
    lines = {"See the catalog in our shop, please.": True, "Please log in to see more.": False, "Log in": False, "You can backlog in peace.": True, "Blog in, log out.": True, "(log in)": False, "unsign up": True, "SIGN UP!": False}
    df = spark.createDataFrame([(k, body + line) for k, line in enumerate(lines)], "doc_id long, text string")
    got = {r["doc_id"]: r["qr_clean_text"] for r in quality_rules.quality_rules(df).collect()}
    assert {line: line in got[k] for k, line in enumerate(lines)} == lines


def test_long_documents_teach(spark):
    """Both labels are known from one document of over 200,000 characters each, in parts."""
    good = "The lake was calm this morning, and we walked along it for an hour.\n" * 3100
    bad = "### $$$ BUY NOW !!! *** %%% ### BUY BUY BUY ||| $$$\n" * 4100
    free = [r["id"] for r in spark.range(40).withColumn("out", line_crf.held_out("id")).where(~F.col("out")).limit(2).collect()]
    rows = [(free[0], good), (free[1], bad), (1001, good[:700]), (1002, bad[:700])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(free[0], 1, 0), (free[1], 0, 0)], "doc_id long, quality int, toxic int")
    for bounds in ({}, {"part_lines": 500, "max_lines": 4000}):
        crf = line_crf.train(docs, labels, **bounds)
        score = {r["doc_id"]: r["score"] for r in line_crf.score(docs, crf).collect()}
        if "max_lines" not in bounds:
            assert score[1001] > 0.7 > 0.3 > score[1002]
    assert line_crf.train(docs, labels, max_lines=10).scale == (0.0, 0.0)
